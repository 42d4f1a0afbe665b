"""Identity resolution: which postings are new jobs and which repeat a known one.

The rule is sequential - a posting is compared with everything accepted before
it - but no batch runs row by row.  Facts against the stored tables are joins;
dependencies inside a batch are settled by ``operators/settling.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.text import canonical_id, is_blank, normalize_text
from stellwerk.operators.settling import BY_HASH, BY_SOURCE_ID, BY_TITLE, NEW, Settling, title_ranges
from stellwerk.operators.similar_titles import similar_to_stored
from stellwerk.session import cut_lineage

def source_key(source_name: Column, source_job_id: Column, otherwise: Column) -> Column:
    """Join key of a source's own id; rows without id get a key that matches nothing.

    A shared NULL key would send all such rows to one task.
    """
    return F.when(
        ~is_blank(source_job_id), F.concat_ws("\x1f", F.lit("id"), source_name, source_job_id)
    ).otherwise(F.concat_ws("\x1f", F.lit("none"), otherwise.cast("string")))


def posting_keys(postings: DataFrame) -> DataFrame:
    """The narrow frame identity works on: keys only, no texts."""
    title, company = F.col("title"), F.col("company_name")
    return postings.select(
        "seq",
        "url",
        (~is_blank(F.col("source_job_id"))).alias("has_source_id"),
        source_key(F.col("source_name"), F.col("source_job_id"), F.col("seq")).alias("source_key"),
        canonical_id(title, company, F.col("location_raw")).alias("canonical_id"),
        normalize_text(company).alias("company_key"),
        normalize_text(title).alias("title"),
    )


@dataclass
class Known:
    """Stored state reduced to the four lookups of the cascade."""

    source_ids: DataFrame  # source_key, job_key
    hashes: DataFrame  # canonical_id
    titles: DataFrame  # company_key, title (active jobs only)
    urls: DataFrame  # url


def known_from_tables(jobs: DataFrame, sources: DataFrame, companies: DataFrame) -> Known:
    job_keys = jobs.select(F.col("id").alias("job_id"), F.col("canonical_id").alias("job_key"))
    own_ids = sources.where(~is_blank(F.col("source_job_id"))).select(
        "id", "job_id",
        source_key(F.col("source_name"), F.col("source_job_id"), F.col("id")).alias("source_key"),
    )
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name_normalized").alias("company_key")
    )
    active = jobs.where("is_active").select(
        "company_id", normalize_text(F.col("title")).alias("title")
    )
    return Known(
        source_ids=own_ids.join(job_keys, "job_id")
        .groupBy("source_key")
        .agg(F.min_by("job_key", "id").alias("job_key")),
        hashes=jobs.select("canonical_id"),
        titles=active.join(names, "company_id").select("company_key", "title").distinct(),
        urls=sources.select("url").distinct(),
    )


def match_source_ids(keys: DataFrame, known: Known) -> DataFrame:
    """Stage 0: add ``stored_job``, the job already linked to the source's own id."""
    hits = known.source_ids.withColumnRenamed("job_key", "stored_job")
    return keys.join(hits, "source_key", "left")


def match_hashes(keys: DataFrame, known: Known) -> DataFrame:
    """Stage 1: add ``stored_hash``."""
    hits = known.hashes.distinct().withColumn("stored_hash", F.lit(True))
    return keys.join(hits, "canonical_id", "left").fillna(False, ["stored_hash"])


def match_urls(keys: DataFrame, known: Known) -> DataFrame:
    """Add ``stored_url``: a known link keeps its own id and registers nothing new."""
    hits = known.urls.withColumn("stored_url", F.lit(True))
    return keys.join(hits, "url", "left").fillna(False, ["stored_url"])


def match_titles(keys: DataFrame, known: Known, threshold: float) -> DataFrame:
    """Stage 2: add ``stored_title``."""
    hits = similar_to_stored(title_ranges(keys), known.titles, threshold)
    return keys.join(
        hits.withColumn("stored_title", F.lit(True)), ["company_key", "title"], "left"
    ).fillna(False, ["stored_title"])


def _match_all(keys: DataFrame, known: Known, threshold: float) -> DataFrame:
    return match_titles(
        match_urls(match_hashes(match_source_ids(keys, known), known), known), known, threshold
    )


def _registered(rows: DataFrame) -> DataFrame:
    """First row to register each source id, with its job.

    Only the first row of a URL that is not dropped creates a link, and only a
    link to a URL not stored before carries an id.
    """
    first_of_url = (
        rows.where(F.col("label") != BY_TITLE)
        .groupBy("url")
        .agg(F.min(F.struct("seq", "source_key", "canonical_id", "has_source_id", "stored_url"))
             .alias("first"))
        .select("first.*")
    )
    return (
        first_of_url.where(F.col("has_source_id") & ~F.col("stored_url"))
        .groupBy("source_key")
        .agg(F.min(F.struct("seq", "canonical_id")).alias("r"))
        .select(
            "source_key", F.col("r.seq").alias("id_seq"),
            F.col("r.canonical_id").alias("id_job"),
        )
    )


def label_postings(
    keys: DataFrame, known: Known, threshold: float = K.FUZZY_THRESHOLD, slice_titles: int | None = None
) -> DataFrame:
    """Label and job of every posting key.

    Adds ``label`` (how it was decided) and ``job_key`` (canonical id of the job
    it belongs to; NULL for similar titles, which are dropped without a trace).
    """
    # The keys feed every lookup: normalise and hash once, then read narrow rows.
    rows = cut_lineage(_match_all(cut_lineage(keys), known, threshold))
    labelled = cut_lineage(rows.join(Settling(rows, threshold, slice_titles).labels(), "seq"))
    # Only repeats of an id that this batch brought have to look up their job.
    from_batch = (F.col("label") == BY_SOURCE_ID) & F.col("stored_job").isNull()
    own = F.when(F.col("label") == BY_SOURCE_ID, F.col("stored_job")).when(F.col("label") != BY_TITLE, F.col("canonical_id"))
    repeats = labelled.where(from_batch).join(_registered(labelled), "source_key")
    return labelled.where(~from_batch).withColumn("job_key", own).unionByName(
        repeats.withColumnRenamed("id_job", "job_key").drop("id_seq")
    )


def outcome(label: Column) -> Column:
    return F.when(label == NEW, "new").otherwise("duplicate")
