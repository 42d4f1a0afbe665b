"""Next snapshots of the stored tables.  Every operator returns a new frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.dates import expires_at
from stellwerk.functions.text import blank_to_null, is_blank, normalize_text
from stellwerk.operators import identity as I
from stellwerk.operators.filters import is_expired
from stellwerk.session import cut_lineage


# Bits that a running number has for the place within its partition.
_PLACE_BITS = 33


def assign_ids(rows: DataFrame, order: str, start: Column | int = 0) -> DataFrame:
    """Consecutive ids in the given order without sorting in one task.

    Rows are range-partitioned and sorted, and their running number tells the
    partition and the place in it; a small frame of partition sizes gives each
    partition its offset.  So rows are shuffled once.
    """
    ranged = cut_lineage(
        rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", _PLACE_BITS)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per partition.
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    number = F.col("place") - F.shiftleft("part", _PLACE_BITS) + 1
    return (
        ranged.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("id", F.lit(start) + F.col("offset") + number)
        .drop("part", "place", "offset")
    )


def _next_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def _stamped(rows: DataFrame, changed: Column, as_of: Column | None) -> DataFrame:
    """Move ``updated_at`` on the rows that change; without a time nothing moves."""
    if as_of is None:
        return rows
    before = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None)
    moved = F.when(F.coalesce(changed, F.lit(False)), as_of).otherwise(before)
    return rows.withColumn("updated_at", moved.cast("timestamp"))


def upsert_companies(
    postings: DataFrame, companies: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Add employers not known yet; the first spelling of a name wins."""
    named = postings.select(
        "seq", F.col("company_name").alias("name"),
        normalize_text(F.col("company_name")).alias("name_normalized"),
    )
    first = named.groupBy("name_normalized").agg(
        F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name")
    )
    missing = first.join(companies, "name_normalized", "left_anti")
    added = assign_ids(missing, "seq", _next_id(companies)).select(
        "id", "name", "name_normalized",
        F.lit("unknown").alias("address_status"), F.lit("unknown").alias("remote_policy"),
        *([] if as_of is None else [as_of.alias("created_at"), as_of.alias("updated_at")]),
    )
    return companies.unionByName(added, allowMissingColumns=True)


@dataclass
class Resolution:
    """Outcome per posting and the next snapshots."""

    outcomes: DataFrame
    companies: DataFrame
    jobs: DataFrame
    sources: DataFrame


def _first_texts(hits: DataFrame, empty_jobs: DataFrame) -> DataFrame:
    """First non-blank text per job that has none; other jobs' texts are not moved."""
    return (
        hits.where(~is_blank(F.col("raw_text")))
        .select("job_key", "seq", "raw_text")
        .join(empty_jobs, "job_key", "left_semi")
        .groupBy("job_key")
        .agg(F.min_by("raw_text", "seq").alias("found_text"))
    )


def next_jobs(
    placed: DataFrame, jobs: DataFrame, companies: DataFrame, seen_at: Column
) -> DataFrame:
    """Insert new jobs, move last sightings, fill missing texts.

    ``placed`` are the postings with ``label``, ``canonical_id`` and ``job_key``.
    """
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name_normalized").alias("company_key")
    )
    fresh = placed.where(F.col("label") == I.NEW)
    added = assign_ids(fresh.join(names, "company_key", "left"), "seq", _next_id(jobs)).select(
        "id", "canonical_id", F.col("raw_title").alias("title"), "company_id", "location_raw",
        F.lit("unknown").alias("location_status"), "work_model", "salary_raw", "deadline",
        seen_at.alias("first_seen_at"), seen_at.alias("last_seen_at"),
        F.lit("new").alias("status"), F.lit(True).alias("is_active"), "raw_text", "sector",
        seen_at.alias("created_at"), seen_at.alias("updated_at"),
    )
    everything = jobs.unionByName(added, allowMissingColumns=True)
    hits = placed.where(F.col("label").isin(I.BY_SOURCE_ID, I.BY_HASH))
    touched = hits.groupBy("job_key").agg(F.max_by(seen_at, "seq").alias("seen_again"))
    empty = everything.where(is_blank(F.col("raw_text"))).select(
        F.col("canonical_id").alias("job_key")
    )
    texts = _first_texts(hits, empty)
    changes = touched.join(texts, "job_key", "left").withColumnRenamed("job_key", "canonical_id")
    return (
        everything.join(changes, "canonical_id", "left")
        .withColumn("last_seen_at", F.coalesce("seen_again", "last_seen_at"))
        .withColumn("updated_at", F.coalesce("seen_again", "updated_at"))
        .withColumn(
            "raw_text", F.coalesce(blank_to_null(F.col("raw_text")), "found_text", "raw_text")
        )
        .drop("seen_again", "found_text")
        .select(*everything.columns)
    )


def next_sources(placed: DataFrame, sources: DataFrame, jobs: DataFrame, seen_at: Column) -> DataFrame:
    """Upsert links by URL: a known URL only moves its last sighting."""
    linked = placed.where(F.col("label") != I.BY_TITLE)
    per_url = linked.groupBy("url").agg(
        F.min("seq").alias("seq"),
        F.min_by(
            F.struct("job_key", "source_name", "source_type", "source_job_id",
                     seen_at.alias("first_seen_at")), "seq",
        ).alias("first"),
        F.max_by(seen_at, "seq").alias("seen_again"),
    )
    known = sources.join(per_url.select("url", "seen_again"), "url", "left")
    moved = known.withColumn("last_seen_at", F.coalesce("seen_again", "last_seen_at")).select(
        *sources.columns
    )
    job_ids = jobs.select(F.col("id").alias("job_id"), F.col("canonical_id").alias("job_key"))
    fresh = (
        per_url.join(sources, "url", "left_anti")
        .select("seq", "url", "first.*", F.col("seen_again").alias("last_seen_at"))
        .join(job_ids, "job_key")
    )
    added = assign_ids(fresh, "seq", _next_id(sources)).select(
        "id", "job_id", "url", "source_name", "source_type", F.lit(False).alias("is_canonical"),
        "first_seen_at", "last_seen_at", "source_job_id",
    )
    return moved.unionByName(added, allowMissingColumns=True)


def resolve(
    postings: DataFrame, jobs: DataFrame, sources: DataFrame, companies: DataFrame,
    as_of: Column, threshold: float = K.FUZZY_THRESHOLD,
    slice_titles: int | None = None,
) -> Resolution:
    """One ingest run: companies, cascade, and the next jobs and sources."""
    all_companies = cut_lineage(upsert_companies(postings, companies, as_of))
    keys = I.posting_keys(postings)
    known = I.known_from_tables(jobs, sources, companies)
    labels = I.label_postings(keys, known, threshold, slice_titles).select(
        "seq", "canonical_id", "company_key", "label", "job_key"
    )
    placed = postings.withColumnRenamed("title", "raw_title").join(labels, "seq")
    fresh_jobs = cut_lineage(next_jobs(placed, jobs, all_companies, as_of))
    outcomes = placed.select(
        "seq", "source_name", I.outcome(F.col("label")).alias("outcome"),
        F.when(F.col("label") != I.NEW, F.col("label")).alias("matched_stage"), "job_key",
    )
    return Resolution(
        outcomes=outcomes,
        companies=all_companies,
        jobs=fresh_jobs,
        sources=next_sources(placed, sources, fresh_jobs, as_of),
    )


def expire(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Close jobs past their deadline; ``expired_now`` marks those closed by this call."""
    gone = F.coalesce(is_expired(as_of), F.lit(False))
    closed = (
        jobs.withColumn("expired_now", gone)
        .withColumn("status", F.when(F.col("expired_now"), "expired").otherwise(F.col("status")))
        .withColumn("is_active", F.col("is_active") & ~F.col("expired_now"))
    )
    return _stamped(closed, F.col("expired_now"), as_of)


# --- caches, addresses, status, texts ---------------------------------------


def upsert_cache(
    cache: DataFrame, fresh: DataFrame, as_of: Column, ttl_days: int = K.TRANSIT_TTL_DAYS
) -> DataFrame:
    """Replace cached minutes per (company_id, origin_hash); old rows of other keys stay."""
    key = ["company_id", "origin_hash"]
    stamped = fresh.select(
        *key, "transit_minutes", "api_used", as_of.alias("cached_at"),
        expires_at(as_of, F.lit(ttl_days)).alias("expires_at"),
    )
    return cache.join(stamped, key, "left_anti").unionByName(stamped)


def valid_cache(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > as_of)


def update_addresses(
    companies: DataFrame, resolved: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Apply resolved addresses (id, address struct or NULL for failed) to the companies."""
    joined = companies.join(resolved.select("id", "address", F.lit(True).alias("tried")), "id", "left")
    found = F.col("address").isNotNull()
    values = {
        "address_street": "street", "address_city": "city", "address_zip": "zip_code",
        "lat": "lat", "lng": "lng", "address_source": "source",
    }
    updated = {
        name: F.when(found, F.col(f"address.{field}")).otherwise(F.col(name))
        for name, field in values.items()
        if name in companies.columns
    }
    updated["address_status"] = (
        F.when(found, "found").when(F.col("tried"), "failed").otherwise(F.col("address_status"))
    )
    stamped = _stamped(joined.withColumns(updated), F.col("tried"), as_of)
    return stamped.select(*_columns(companies, as_of))


def _columns(rows: DataFrame, as_of: Column | None) -> list[str]:
    """A table's columns, with ``updated_at`` if it is kept."""
    added = [] if as_of is None or "updated_at" in rows.columns else ["updated_at"]
    return [*rows.columns, *added]


def update_location_status(
    jobs: DataFrame, scored: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Take over the status of scored jobs (id, status)."""
    fresh = scored.select("id", F.col("status").alias("fresh_status"))
    joined = jobs.join(fresh, "id", "left").withColumn(
        "location_status", F.coalesce("fresh_status", "location_status")
    )
    stamped = _stamped(joined, F.col("fresh_status").isNotNull(), as_of)
    return stamped.select(*_columns(jobs, as_of))


def fill_texts(jobs: DataFrame, texts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Fill blank texts from landed details (id, text); existing texts stay."""
    wanted = texts.where(~is_blank(F.col("text"))).groupBy("id").agg(
        F.min("text").alias("found_text")
    )
    joined = jobs.join(wanted, "id", "left")
    filled = is_blank(F.col("raw_text")) & F.col("found_text").isNotNull()
    stamped = _stamped(joined, filled, as_of).withColumn(
        "raw_text", F.coalesce(blank_to_null(F.col("raw_text")), "found_text", "raw_text")
    )
    return stamped.select(*_columns(jobs, as_of))
