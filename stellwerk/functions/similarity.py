"""Sequence similarity: the one measure Spark has no built-in for."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1 << 16)  # the same pair of titles comes from many companies
def ratio(later: str, earlier: str) -> float:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return SequenceMatcher(None, later, earlier).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else ratio(a, b) for a, b in zip(later, earlier)],
        dtype="float64",
    )
