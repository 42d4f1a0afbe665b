"""Assembly and storage of the full quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.operators import quality as Q
from stellwerk.operators.recommendations import recommendations


def quality_report(jobs: DataFrame, sources: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """All sections as frames; only the per-source coverage, which the rules share, runs at once."""
    location = Q.location_quality(jobs)
    coverage = Q.source_coverage(jobs, sources)
    models = Q.work_model_breakdown(jobs)
    salary = Q.salary_quality(jobs)
    raw_text = Q.raw_text_quality(jobs)
    company = Q.company_quality(companies)
    return {
        "general": Q.general_stats(jobs, sources, companies),
        "status": Q.status_breakdown(jobs),
        "sources": Q.source_breakdown(sources),
        "location": location,
        "top_locations": Q.top_locations(jobs),
        "coverage": coverage,
        "companies": company,
        "work_model": models,
        "salary": salary,
        "raw_text": raw_text,
        "duplicates": Q.duplicate_analysis(jobs, sources),
        "recommendations": recommendations(location, models, salary, raw_text, company, coverage),
    }


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The report in long form: one JSON object per section row."""
    frames = [
        frame.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("content"))
        for section, frame in report.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def write_report(report: dict[str, DataFrame], path: str, report_date: str) -> None:
    """Write the report as JSON below ``report_date=<date>``; a day's rerun replaces that day only."""
    rows = report_rows(report).withColumn("report_date", F.lit(report_date))
    (
        rows.coalesce(1)  # a few dozen summary rows
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_date")
        .json(path)
    )
