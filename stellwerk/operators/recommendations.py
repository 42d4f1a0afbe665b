"""Threshold rules over the quality sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.text import python_list
from stellwerk.session import cut_lineage

_COLUMNS = ["category", "severity", "message", "affected_count", "affected_pct"]


def _level(low: Column, high: str, medium: Column | None = None) -> Column:
    chosen = F.when(low, high)
    return chosen if medium is None else chosen.when(medium, "medium")


def _rows(frame: DataFrame, category: str, severity: Column, message: Column, count: Column,
          pct: Column) -> DataFrame:
    return frame.select(
        F.lit(category).alias("category"),
        severity.alias("severity"),
        message.alias("message"),
        count.cast("bigint").alias("affected_count"),
        F.round(pct, 2).alias("affected_pct"),
    ).where(F.col("severity").isNotNull())


def _with_incomplete_sources(section: DataFrame, coverage: DataFrame, pct: str) -> DataFrame:
    """Attach the sorted names of sources below full coverage to a one-row section.

    The list has one entry per registered source, not per job.
    """
    names = coverage.agg(
        F.array_sort(F.collect_list(F.when(F.col(pct) < 100.0, F.col("source_name")))).alias(
            "sources"
        )
    )
    keyed = section.withColumn("one", F.lit(1))
    return keyed.join(names.withColumn("one", F.lit(1)), "one").drop("one")


def recommendations(
    location: DataFrame, work_model: DataFrame, salary: DataFrame, raw_text: DataFrame,
    companies: DataFrame, coverage: DataFrame,
) -> DataFrame:
    """Rules applied to the section frames, ordered by severity and category."""
    # One row per source, used four times below: the join behind it runs once.
    coverage = cut_lineage(coverage)
    pct = F.col("location_coverage_pct")
    located = _with_incomplete_sources(location, coverage, "location_coverage_pct")
    overall_location = _rows(
        located, "location",
        _level(pct < K.LOCATION_HIGH, "high", pct < K.LOCATION_MEDIUM),
        F.format_string(K.MSG_LOCATION, 100 - pct, python_list(F.col("sources"))),
        F.col("jobs_without_location"), 100 - pct,
    )
    source_location = _rows(
        coverage, "location",
        _level((pct == 0.0) & (F.col("total") > 0), "high"),
        F.format_string(K.MSG_LOCATION_SOURCE, F.col("source_name")),
        F.col("total"), F.lit(100.0),
    )

    missing = F.col("pct")
    models = _rows(
        work_model.where(F.col("work_model") == "null"), "work_model",
        _level(missing > K.WORK_MODEL_HIGH, "high", missing > K.WORK_MODEL_MEDIUM),
        F.lit(K.MSG_WORK_MODEL), F.col("job_count"), missing,
    )

    text_pct = F.col("raw_text_coverage_pct")
    texts = _with_incomplete_sources(raw_text, coverage, "text_coverage_pct")
    overall_text = _rows(
        texts, "raw_text",
        _level(text_pct < K.TEXT_HIGH, "high", text_pct < K.TEXT_MEDIUM),
        F.format_string(K.MSG_TEXT, python_list(F.col("sources"))),
        F.col("without_raw_text"), 100 - text_pct,
    )
    source_text = _rows(
        coverage, "raw_text",
        F.when((F.col("text_coverage_pct") == 0.0) & (F.col("total") > 0), "medium"),
        F.format_string(K.MSG_TEXT_SOURCE, F.col("source_name")),
        F.col("total"), F.lit(100.0),
    )

    salary_pct = F.col("salary_coverage_pct")
    salaries = _rows(
        salary, "salary", F.when(salary_pct < K.SALARY_LOW, "low"),
        F.format_string(K.MSG_SALARY, salary_pct), F.col("without_salary_raw"), 100 - salary_pct,
    )

    unresolved = F.try_divide(F.col("address_unknown"), F.col("total_companies")) * 100
    addresses = _rows(
        companies, "general", F.when(unresolved > K.ADDRESS_HIGH, "high"),
        F.lit(K.MSG_ADDRESS), F.col("address_unknown"), unresolved,
    )

    found = overall_location
    for part in (source_location, models, overall_text, source_text, salaries, addresses):
        found = found.unionByName(part)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.select(*_COLUMNS).orderBy(rank, "category", "message")
