"""Row filters.  All are plain predicates, so Catalyst can push them to the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.dates import SECONDS_PER_DAY, is_recent
from stellwerk.functions.location import matches_targets
from stellwerk.functions.text import is_blank


def recent(rows: DataFrame, when: str, as_of: Column, max_days: int | None) -> DataFrame:
    return rows.where(is_recent(F.col(when).cast("timestamp"), as_of, max_days))


def newer_than(rows: DataFrame, when: str, as_of: Column, max_days: int) -> DataFrame:
    """Strict cutoff to the second: undated rows stay, a limit of 0 keeps only the future."""
    cutoff = F.unix_timestamp(as_of) - max_days * SECONDS_PER_DAY
    stamp = F.col(when).cast("timestamp")
    return rows.where(stamp.isNull() | (F.unix_timestamp(stamp) >= cutoff))


def in_targets(
    rows: DataFrame, location: str, remote: Column, targets: list[str] | None = None
) -> DataFrame:
    return rows.where(matches_targets(F.col(location), remote, targets or K.TARGET_LOCATIONS))


def required(rows: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all named fields filled, and the rejected rest."""
    complete = reduce(and_, [~is_blank(F.col(name)) for name in names])
    return rows.where(complete), rows.where(~complete)


def filled(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(~is_blank(F.col(name)))


def url_shape(rows: DataFrame, url: str, pattern: str = K.LISTING_URL_PATTERN) -> DataFrame:
    return rows.where(F.col(url).rlike(pattern))


def numeric_id(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col(name).rlike(r"^\d+$"))


def active_titles(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Titles of active jobs for the given ``company_id`` rows."""
    active = jobs.where("is_active").select("company_id", "title")
    return active.join(companies.select("company_id").distinct(), "company_id", "left_semi")


def is_expired(as_of: Column) -> Column:
    """Deadline passed, still active, and not in an application."""
    return (
        (F.col("deadline") < as_of)
        & F.col("is_active")
        & ~F.col("status").isin(K.IN_APPLICATION_STATUSES)
    )


def scoring_candidates(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Active jobs without a location status; a limit takes the lowest ids."""
    found = jobs.where(
        (F.col("location_status") == "unknown")
        & F.col("is_active")
        & ~F.col("status").isin(K.NOT_SCORED_STATUSES)
    )
    return found if limit is None else found.orderBy("id").limit(limit)


def address_candidates(companies: DataFrame, limit: int | None = None) -> DataFrame:
    found = companies.where(F.col("address_status") == "unknown").select("id", "name")
    return found if limit is None else found.orderBy("id").limit(limit)


def backfill_candidates(
    jobs: DataFrame, sources: DataFrame, source_name: str, limit: int | None = None
) -> DataFrame:
    """Distinct active jobs of a source without text, newest first."""
    links = sources.where(F.col("source_name") == source_name).select("job_id", "url")
    empty = jobs.where(F.col("is_active") & is_blank(F.col("raw_text"))).select(
        "id", "title", "first_seen_at"
    )
    found = (
        empty.join(links, empty["id"] == links["job_id"])
        .select("id", "title", "url", "first_seen_at")
        .distinct()
    )
    if limit is None:
        return found
    return found.orderBy(F.desc("first_seen_at"), "id", "url").limit(limit)
