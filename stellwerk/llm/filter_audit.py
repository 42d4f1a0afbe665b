"""Interaction of five text filters, by contracting a contingency tensor.

Every document fails some of the filters A to E.  Spark counts the documents of each part by
their 32 patterns of failure; of one part these counts are a 2x2x2x2x2 tensor, one axis per
filter (0 passes, 1 fails).  What a filter does at a step of some order is a contraction of that
tensor with one vector per axis: pass, fail or all.  One ``einsum`` takes all steps of all orders.

* Filters A to D look at one text and are column expressions.  E asks whether a smaller id has an
  identical text anywhere in the table: each digest's smallest id is an aggregation that combines
  on the map side, and (digest, smallest id) is joined back on both columns, so a text that a third
  of all rows share does not meet in one task.
* A group of the last step is one part with at most 32 rows of counts.

Defined cases: a null text is empty (it fails A, and E if a smaller id has an empty text); a null
part is the part ''; a null id is neither smaller nor larger than another, so E never fails for
it, and it has no labels; rows that repeat both id and text pass or fail E together; of repeated
labels, 1 wins; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # hundredths of the words
MOST_CAPITALS = 2  # hundredths of the code points
MARKS = "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(documents: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, digest of the text, and ``mask``: bit i is set if filter i of A to D fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    counted = documents.select(
        "doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"), F.length(text).cast("long").alias("points"),
        (F.octet_length(text) - F.octet_length(F.translate(text, _CAPITALS, ""))).cast("long").alias("capitals"),
        text.rlike(MARKS).alias("marked"),
    )
    failed = (
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"),
        F.col("marked"),
    )
    bits = [f.cast("int") * (1 << i) for i, f in enumerate(failed)]
    return counted.select("doc_id", "part", "digest", (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask"))


def _join_key(row_id: F.Column, part: F.Column, digest: F.Column) -> F.Column:
    """Null ids match nothing; they get keys of their own, so that they don't meet in one task."""
    return F.when(row_id.isNotNull(), F.struct(row_id.alias("id"), F.lit(0).cast("long").alias("none"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("id"), F.xxhash64(part, digest, F.monotonically_increasing_id()).alias("none"))
    )


def pattern_counts(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask of the filters that fail (bit i for filter i), and the rows, good rows and toxic rows that have it."""
    judged = stored(failures(documents, part), "filter-failures")
    keyed = judged.withColumn("key", _join_key(F.col("doc_id").cast("long"), F.col("part"), F.col("digest"))).drop("doc_id")
    plain = F.struct(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("none"))
    firsts = (
        judged.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        .select(plain.alias("key"), "digest", F.lit(True).alias("is_first"))
    )
    marks = (
        labels.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .select(plain.alias("key"), "good", "toxic")
    )
    copies = F.col("key.id").isNotNull() & F.col("is_first").isNull()
    rows = keyed.join(marks, "key", "left").join(firsts, ["key", "digest"], "left")
    return (
        rows.select("part", (F.col("mask") + F.when(copies, 16).otherwise(0)).alias("mask"), "good", "toxic")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("rows"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )


# What a vector on one axis selects: documents that pass, that fail, or all.
_SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
PASS, FAIL, ALL = range(3)


def _steps(count: int = len(FILTERS)) -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """(order, step) of all steps, the filter of each, and per contraction the choice on every axis."""
    names, filters, before = [], [], []
    for order in permutations(range(count)):
        for step, axis in enumerate(order):
            names.append(("".join(FILTERS[i] for i in order), step + 1))
            filters.append(axis)
            before.append([i in order[:step] for i in range(count)])
    filters, before = np.array(filters), np.array(before)
    own = np.arange(count) == filters[:, None]
    earlier = np.where(before, PASS, ALL)
    return names, filters, {
        "kept": np.where(own, PASS, earlier),
        "removed": np.where(own, FAIL, earlier),
        "failing": np.where(own, FAIL, ALL),
        "unique_fails": np.where(own, FAIL, PASS),
    }


_NAMES, _OWN, _CHOICES = _steps()


def contract(tensors: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """For tensors (k, 2, 2, 2, 2, 2) and choices (steps, 5): the selected count of each, (k, steps)."""
    chosen = _SELECT[choice]  # steps, axes, 2
    return np.einsum("kabcde,sa,sb,sc,sd,se->ks", tensors, *(chosen[:, i] for i in range(len(FILTERS))), optimize=True)


def effects(counts: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders from the pattern counts of one part."""
    tensors = np.zeros((3, 1 << len(FILTERS)), np.int64)
    mask = counts["mask"].to_numpy()
    for channel, column in enumerate(("rows", "good", "toxic")):
        np.add.at(tensors[channel], mask, counts[column].to_numpy())
    # Bit i of the mask is filter i, so the last axis of the reshaped tensor is filter A.
    tensors = tensors.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
    removed = contract(tensors, _CHOICES["removed"])
    total = np.bincount(_OWN, weights=removed[0], minlength=len(FILTERS)).astype(np.int64)
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0],
            "filter_order": [order for order, _ in _NAMES],
            "step": np.array([step for _, step in _NAMES], np.int32),
            "kept": contract(tensors[:1], _CHOICES["kept"])[0],
            "removed": removed[0],
            "redundant": contract(tensors[:1], _CHOICES["failing"])[0] - removed[0],
            "unique_fails": contract(tensors[:1], _CHOICES["unique_fails"])[0],
            "good_lost": removed[1],
            "toxic_lost": removed[2],
            "shapley": total[_OWN],
        }
    )


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the measures, for every part and every step of all 120 orders."""
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    return pattern_counts(documents, labels, part).groupBy("part").applyInPandas(effects, f"part string, filter_order string, step int, {kinds}")
