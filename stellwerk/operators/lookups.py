"""Keyed lookups between postings, jobs, links and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.text import blank_to_null, is_blank
from stellwerk.operators.identity import source_key
from stellwerk.operators.maintenance import valid_cache


def known_source_ids(sources: DataFrame, source_name: str) -> DataFrame:
    return (
        sources.where((F.col("source_name") == source_name) & F.col("source_job_id").isNotNull())
        .select("source_job_id")
        .distinct()
    )


def without_known_ids(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings whose source id is not stored yet (incremental option)."""
    def key(otherwise: Column) -> Column:
        return source_key(F.col("source_name"), F.col("source_job_id"), otherwise).alias("source_key")

    known = sources.where(~is_blank(F.col("source_job_id"))).select(key(F.col("url")))
    # Postings without an id get keys of their own, by their URL.
    return postings.withColumn("source_key", key(F.col("url"))).join(known, "source_key", "left_anti").drop("source_key")


def with_known_url(postings: DataFrame, sources: DataFrame) -> DataFrame:
    return postings.join(sources.select("url"), "url", "left_semi")


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Add ``company_name``; a missing company has a fixed label."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    joined = jobs.join(names, "company_id", "left")
    return joined.withColumn(
        "company_name", F.coalesce("company_name", F.lit(K.UNKNOWN_COMPANY_LABEL))
    )


def with_canonical_url(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_url``, the job's link marked as canonical (smallest if several)."""
    links = sources.where("is_canonical").groupBy(F.col("job_id").alias("id")).agg(
        F.min("url").alias("source_url")
    )
    return jobs.join(links, "id", "left")


def with_cached_minutes(
    jobs: DataFrame, cache: DataFrame, origin_hash: str, as_of: Column
) -> DataFrame:
    """Add ``cached_minutes`` of the job's company for one origin, unless expired."""
    hits = (
        valid_cache(cache, as_of)
        .where(F.col("origin_hash") == origin_hash)
        .select("company_id", F.col("transit_minutes").alias("cached_minutes"))
    )
    return jobs.join(hits, "company_id", "left")


def with_details(postings: DataFrame, details: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """Fill ``raw_text`` from landed detail texts (key, detail_text); blank texts do not count."""
    # Blank texts are left out by the aggregate: a filter would parse every page a second time.
    texts = details.groupBy(key).agg(F.max(blank_to_null(F.col("detail_text"))).alias("detail_text"))
    joined = postings.join(texts, key, "left")
    found = F.coalesce("detail_text", "raw_text")
    value = found if only is None else F.when(only, found).otherwise(F.col("raw_text"))
    return joined.withColumn("raw_text", value).drop("detail_text").select(*postings.columns)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Referential check: rows whose key has no parent; must be empty."""
    return rows.where(F.col(key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(key)), key, "left_anti"
    )
