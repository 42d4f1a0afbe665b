"""Data-quality aggregates over jobs, source links and companies.

Each section reads its table once.  Wide text columns are reduced to flags
before any shuffle, so the only data that moves are keys, flags and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.dates import week_label
from stellwerk.functions.text import completeness_class, is_blank, percent, ratio


def _filled(name: str) -> Column:
    return ~is_blank(F.col(name))


def general_stats(jobs: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """One row: table sizes, distinct sources and the first and last sighting."""
    per_table = [
        jobs.agg(
            F.count("*").alias("total_jobs"),
            F.count_if("is_active").alias("total_active"),
            F.count_if(F.col("status") == "expired").alias("total_expired"),
            F.min("first_seen_at").alias("first_seen"),
            F.max("last_seen_at").alias("last_seen"),
        ),
        companies.agg(F.count("*").alias("total_companies")),
        sources.agg(F.count_distinct("source_name").alias("total_sources")),
    ]
    names = [
        "total_jobs", "total_active", "total_expired", "total_companies", "total_sources",
        "first_seen", "last_seen",
    ]
    stacked = per_table[0]
    for one in per_table[1:]:
        stacked = stacked.unionByName(one, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def status_breakdown(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("job_count"))


def source_breakdown(sources: DataFrame) -> DataFrame:
    """Distinct jobs and sighting range per source, largest first."""
    return (
        sources.groupBy("source_name")
        .agg(
            F.count_distinct("job_id").alias("job_count"),
            F.min("first_seen_at").alias("first_seen"),
            F.max("last_seen_at").alias("last_seen"),
        )
        .orderBy(F.desc("job_count"), "source_name")
    )


def location_quality(jobs: DataFrame) -> DataFrame:
    """Coverage and shape of the location text."""
    place = F.col("location_raw")
    remote = place.ilike("%remote%") | place.ilike("%homeoffice%") | place.ilike("%home office%")
    counts = jobs.agg(
        F.count("*").alias("total"),
        F.count_if(_filled("location_raw")).alias("jobs_with_location"),
        F.count_distinct("location_raw").alias("distinct_locations"),
        F.count_if(place.rlike("^[0-9]{5} ")).alias("plz_city_count"),
        F.count_if(remote).alias("remote_count"),
    )
    missing = F.col("total") - F.col("jobs_with_location")
    other = F.col("jobs_with_location") - F.col("plz_city_count") - F.col("remote_count")
    return counts.select(
        "jobs_with_location",
        missing.alias("jobs_without_location"),
        percent(F.col("jobs_with_location"), F.col("total")).alias("location_coverage_pct"),
        "distinct_locations",
        "plz_city_count",
        F.greatest(F.lit(0), other).alias("city_only_count"),
        "remote_count",
        missing.alias("unparseable_count"),
    )


def top_locations(jobs: DataFrame, n: int = K.TOP_LOCATIONS) -> DataFrame:
    """Most frequent location texts; the empty text counts, NULL does not."""
    return (
        jobs.where(F.col("location_raw").isNotNull())
        .groupBy(F.col("location_raw").alias("location"))
        .agg(F.count("*").alias("job_count"))
        .orderBy(F.desc("job_count"), "location")
        .limit(n)
    )


def source_coverage(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Location and text coverage of the distinct jobs of each source.

    Links are reduced to distinct (source, job) pairs before the join, so a
    source that owns most links neither multiplies rows nor loads one task:
    both aggregations combine on the map side.
    """
    flags = jobs.select(
        F.col("id").alias("job_id"),
        _filled("location_raw").alias("has_location"),
        _filled("raw_text").alias("has_text"),
    )
    pairs = sources.select("source_name", "job_id").distinct()
    counts = (
        pairs.join(flags, "job_id")
        .groupBy("source_name")
        .agg(
            F.count("*").alias("total"),
            F.count_if("has_location").alias("with_location"),
            F.count_if("has_text").alias("with_text"),
        )
    )
    return counts.select(
        "source_name", "total", "with_location", "with_text",
        percent(F.col("with_location"), F.col("total")).alias("location_coverage_pct"),
        percent(F.col("with_text"), F.col("total")).alias("text_coverage_pct"),
    )


def company_quality(companies: DataFrame) -> DataFrame:
    status = F.col("address_status")
    return companies.agg(
        F.count("*").alias("total_companies"),
        F.count_if(status == "found").alias("address_found"),
        F.count_if(status == "unknown").alias("address_unknown"),
        F.count_if(status == "failed").alias("address_failed"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("with_lat_lng"),
        F.count_if(F.col("remote_policy") != "unknown").alias("with_remote_policy"),
    )


def work_model_breakdown(jobs: DataFrame) -> DataFrame:
    """Jobs per work model with their share; jobs without one form the group 'null'.

    The total is a second, one-row aggregate of the few groups, not of the jobs.
    """
    groups = jobs.groupBy(F.coalesce("work_model", F.lit("null")).alias("work_model")).agg(
        F.count("*").alias("job_count")
    )
    return share_of_total(groups, "job_count", "pct", 2)


def share_of_total(groups: DataFrame, count: str, share: str, digits: int) -> DataFrame:
    """Add each group's percentage of the grand total to an already aggregated frame."""
    # The frame holds one row per group (a handful), so a single partition is enough.
    total = F.sum(count).over(Window.partitionBy(F.lit(1)))
    return groups.withColumn(share, percent(F.col(count), total, digits))


def salary_quality(jobs: DataFrame) -> DataFrame:
    counts = jobs.agg(
        F.count("*").alias("total"),
        F.count_if(_filled("salary_raw")).alias("with_salary_raw"),
        F.count("salary_min").alias("with_parsed_min_max"),
    )
    return counts.select(
        "with_salary_raw",
        (F.col("total") - F.col("with_salary_raw")).alias("without_salary_raw"),
        percent(F.col("with_salary_raw"), F.col("total")).alias("salary_coverage_pct"),
        "with_parsed_min_max",
    )


def raw_text_quality(jobs: DataFrame) -> DataFrame:
    counts = jobs.agg(
        F.count("*").alias("total"),
        F.count_if(_filled("raw_text")).alias("with_raw_text"),
        F.avg(F.when(_filled("raw_text"), F.length("raw_text"))).alias("mean_length"),
    )
    return counts.select(
        "with_raw_text",
        (F.col("total") - F.col("with_raw_text")).alias("without_raw_text"),
        percent(F.col("with_raw_text"), F.col("total")).alias("raw_text_coverage_pct"),
        F.round("mean_length", 1).alias("avg_text_length"),
    )


def duplicate_analysis(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Source links per job: overall ratio, jobs with several, and the maximum."""
    links = (
        sources.groupBy("job_id")
        .agg(F.count("*").alias("links"))
        .agg(
            F.coalesce(F.sum("links"), F.lit(0)).alias("total_source_entries"),
            F.count_if(F.col("links") > 1).alias("jobs_with_multiple_sources"),
            F.coalesce(F.max("links"), F.lit(0)).alias("max_sources_per_job"),
        )
    )
    totals = jobs.agg(F.count("*").alias("total_jobs"))
    both = links.unionByName(totals, allowMissingColumns=True).agg(
        *[
            F.max(name).alias(name)
            for name in (
                "total_jobs", "total_source_entries", "jobs_with_multiple_sources",
                "max_sources_per_job",
            )
        ]
    )
    return both.withColumn(
        "source_to_job_ratio", ratio(F.col("total_source_entries"), F.col("total_jobs"))
    )


# --- full-text diagnosis of one source --------------------------------------


def jobs_of_source(jobs: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    """Jobs joined to one source's links: a job with two URLs appears twice."""
    links = sources.where(F.col("source_name") == source_name).select("job_id")
    return jobs.join(links, jobs["id"] == links["job_id"]).drop("job_id")


def _with_text_class(jobs: DataFrame) -> DataFrame:
    """Text reduced to its class and a flag before it is shuffled."""
    return jobs.select(
        "id", "first_seen_at",
        completeness_class(F.col("raw_text")).alias("text_class"),
        _filled("raw_text").alias("has_text"),
    )


def text_coverage_by_week(
    jobs: DataFrame, sources: DataFrame, source_name: str, weeks: int = K.COVERAGE_WEEKS
) -> DataFrame:
    """Text coverage per week of first sighting, newest weeks first."""
    joined = jobs_of_source(_with_text_class(jobs), sources, source_name)
    counts = joined.groupBy(week_label(F.col("first_seen_at")).alias("week")).agg(
        F.count("*").alias("total"), F.count_if("has_text").alias("with_text")
    )
    return (
        counts.withColumn("coverage_pct", percent(F.col("with_text"), F.col("total"), 1))
        .orderBy(F.desc("week"))
        .limit(weeks)
    )


def text_status_share(jobs: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    """Completeness classes with their share, and a closing total row.

    ``rollup`` yields the classes and the grand total in one pass.
    """
    joined = jobs_of_source(_with_text_class(jobs), sources, source_name)
    groups = joined.rollup("text_class").agg(F.count("*").alias("job_count"))
    # Five rows at most from here on.
    total = F.max("job_count").over(Window.partitionBy(F.lit(1)))
    return groups.select(
        F.coalesce("text_class", F.lit(K.TEXT_TOTAL)).alias("status"),
        "job_count",
        percent(F.col("job_count"), total, 1).alias("share_pct"),
    )


def text_source_summary(jobs: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    joined = jobs_of_source(_with_text_class(jobs), sources, source_name)
    counts = joined.agg(
        F.count("*").alias("total"), F.count_if("has_text").alias("with_text")
    )
    coverage = F.when(F.col("total") > 0, F.col("with_text") / F.col("total") * 100).otherwise(0.0)
    return counts.select(
        "total", "with_text",
        (F.col("total") - F.col("with_text")).alias("without_text"),
        F.round(coverage, 1).alias("coverage_pct"),
        (coverage < K.COVERAGE_WARN).alias("is_low"),
    )


def location_stats(jobs: DataFrame, companies: DataFrame, cache: DataFrame) -> DataFrame:
    """State of the location scoring; 'failed' companies count in neither group."""
    job_status, address = F.col("location_status"), F.col("address_status")
    parts = [
        jobs.agg(
            F.count("*").alias("jobs_total"),
            F.count_if(job_status == "resolved").alias("jobs_resolved"),
            F.count_if(job_status == "unknown").alias("jobs_unknown"),
            F.count_if(job_status == "failed").alias("jobs_failed"),
        ),
        companies.agg(
            F.count("*").alias("companies_total"),
            F.count_if(address == "found").alias("companies_with_address"),
            F.count_if(address == "unknown").alias("companies_without_address"),
        ),
        cache.agg(F.count("*").alias("transit_cache_entries")),
    ]
    names = [name for part in parts for name in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in names])
