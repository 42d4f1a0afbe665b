"""Texts for jobs that have none, from landed detail pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.operators.filters import backfill_candidates
from stellwerk.operators.maintenance import fill_texts
from stellwerk.session import cut_lineage
from stellwerk.sources.html_lists import detail_texts


@dataclass
class Backfill:
    """The next jobs, and what came of every candidate."""

    jobs: DataFrame
    candidates: DataFrame  # id, url, found


def backfill_texts(
    jobs: DataFrame, sources: DataFrame, details: DataFrame, source_name: str, as_of: Column | None = None,
    selectors: list[str] = K.TABLE_SELECTORS, limit: int | None = None,
) -> Backfill:
    """Candidates of one source, their pages' main text if it is long enough, and the filled jobs.

    ``details``: landed pages (search_key is the URL, payload).  Only pages of candidates are parsed.
    """
    wanted = cut_lineage(backfill_candidates(jobs, sources, source_name, limit).select("id", "url"))
    pages = details.join(wanted.select(F.col("url").alias("search_key")).distinct(), "search_key", "left_semi")
    texts = detail_texts(pages, selectors, strict=True).where(F.col("detail_text").isNotNull())
    per_url = cut_lineage(texts.groupBy("url").agg(F.min("detail_text").alias("text")))
    found = wanted.join(per_url, "url")
    tried = wanted.join(per_url.select("url", F.lit(True).alias("hit")), "url", "left")
    return Backfill(
        fill_texts(jobs, found.select("id", "text"), as_of),
        tried.select("id", "url", F.coalesce("hit", F.lit(False)).alias("found")),
    )
