"""Errors that stay where they happen: what a source's parser could not use.

A broken response costs its own postings only, an incomplete posting only itself; both become
rejects with their place, and count as errors of the run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.sources.encoded_pages import decode_page
from stellwerk.sources.landed import ORDER, collecting_incomplete
from stellwerk.sources.registry import parse_source

UNREADABLE, INCOMPLETE = "unreadable response", "incomplete posting"
REJECTS = ["source_name", *ORDER, "reason"]


def _is_json(payload: Column) -> Column:
    """A JSON object; other JSON holds no list of postings."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def _is_feed(payload: Column) -> Column:
    return F.from_xml(payload, "channel struct<title:string>", {"mode": "PERMISSIVE"})["channel"].isNotNull()


def _is_page(payload: Column) -> Column:
    return F.coalesce(payload.rlike("<[A-Za-z!]"), F.lit(False))


def _is_encoded(payload: Column) -> Column:
    return _is_json(decode_page(payload))


READABLE: dict[str, Callable[[Column], Column]] = {
    "service_bund": _is_feed,
    "stellenmarkt": _is_feed,
    "arbeitsagentur": _is_json,
    "arbeitnow": _is_json,
    "adzuna": _is_json,
    "jooble": _is_json,
    "interamt": _is_page,
    "jobboerse": _is_page,
    "kimeta": _is_encoded,
}


@dataclass
class Isolated:
    """What a source's responses gave, and what they could not give."""

    postings: DataFrame
    rejects: DataFrame  # source_name, search_key, page, position (NULL for a response), reason


def unreadable_responses(name: str, landed: DataFrame) -> DataFrame:
    """Responses that are not of the source's format; no response at all counts, too."""
    readable = F.coalesce(READABLE[name](F.col("payload")), F.lit(False))
    return landed.where(~readable).select(
        F.lit(name).alias("source_name"), "search_key", "page", F.lit(None).cast("bigint").alias("position"),
        F.lit(UNREADABLE).alias("reason"),
    )


def parse_isolated(
    name: str, landed: DataFrame, as_of: Column, max_days: int = K.MAX_AGE_DAYS, details: DataFrame | None = None
) -> Isolated:
    """Postings of the readable responses, and the rejects; each response is parsed once."""
    with collecting_incomplete() as incomplete:
        postings = parse_source(name, landed, as_of, max_days, details)
    bad = [rows.select("source_name", *ORDER, F.lit(INCOMPLETE).alias("reason")) for rows in incomplete]
    return Isolated(postings, reduce(DataFrame.unionByName, bad, unreadable_responses(name, landed)))


def with_errors(outcomes: DataFrame, rejects: DataFrame) -> DataFrame:
    """Outcomes (source_name, outcome) with one more row per reject, for ``run_stats``."""
    kind = F.when(F.col("reason") == UNREADABLE, "unreadable").otherwise("error")
    return outcomes.select("source_name", "outcome").unionByName(rejects.select("source_name", kind.alias("outcome")))


def failed_sources(landed: DataFrame, rejects: DataFrame) -> list[str]:
    """Sources none of whose responses could be read, by name: there are as many as parsers at most.

    ``landed`` has the source_name of every response.
    """
    sent = landed.groupBy("source_name").agg(F.count("*").alias("sent"))
    lost = rejects.where(F.col("reason") == UNREADABLE).groupBy("source_name").agg(F.count("*").alias("lost"))
    failed = sent.join(lost, "source_name").where(F.col("lost") >= F.col("sent"))
    return sorted(r.source_name for r in failed.select("source_name").collect())
