"""Run statistics and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["fetched", "new", "duplicate", "skipped", "errors"]


def run_stats(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Outcome counts per given key columns (run, source, ...).

    A response that could not be read is an error, but nothing was fetched with it.
    """
    result = F.col("outcome")
    unreadable = F.coalesce(result == "unreadable", F.lit(False))
    return outcomes.groupBy(*keys).agg(
        F.count_if(~unreadable).alias("fetched"),
        F.count_if(result == "new").alias("new"),
        F.count_if(result == "duplicate").alias("duplicate"),
        F.count_if(result == "skipped").alias("skipped"),
        F.count_if((result == "error") | unreadable).alias("errors"),
    )


def run_status(failed_sources: Column, new: Column) -> Column:
    """Failed only if a source failed and nothing new came in."""
    return F.when((failed_sources > 0) & (new == 0), "failed").otherwise("finished")


def run_row(
    per_source: DataFrame, run_id: int, started_at: Column, finished_at: Column,
    expired: int, failures: list[str],
) -> DataFrame:
    """One run-log row from the per-source counts."""
    totals = per_source.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTERS],
        F.array_sort(F.collect_set("source_name")).alias("sources_run"),
    ).withColumn("expired", F.lit(expired).cast("bigint"))
    errors = F.array(*[F.lit(x) for x in failures]) if failures else F.lit(None)
    return totals.select(
        F.lit(run_id).cast("bigint").alias("id"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        run_status(F.lit(len(failures)), F.col("new")).alias("status"),
        "sources_run",
        F.struct(*COUNTERS, "expired").alias("stats"),
        errors.cast("array<string>").alias("error_log"),
    )
