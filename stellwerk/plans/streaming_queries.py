"""Registered queries: the streaming forms, run until the input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stellwerk.plans.adapters import VIEWS, Inputs
from stellwerk.plans.identity_queries import FIRST_RUN
from stellwerk.plans.registry import register
from stellwerk.session import checkpoint_dir, spread
from stellwerk.streaming import cache_timers as T
from stellwerk.streaming import incremental as S

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _folder(v) -> str:
    """A fresh folder in the shared checkpoint directory."""
    return f"{checkpoint_dir(v.spark)}/stream-{uuid.uuid4()}"


def _stream(v):
    return (
        v.spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    )


def _in_files(v, files: int) -> str:
    """The events as files of consecutive ids, written one after the other: one micro-batch each."""
    folder = f"{_folder(v)}/landed"
    ends = v.events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    part = F.least(F.floor((F.col("event_id") - F.col("low")) * files / (F.col("high") - F.col("low") + 1)), F.lit(files - 1))
    numbered = v.events.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("low", "high")  # one row of bounds
    for number in range(files):
        numbered.where(F.col("part") == number).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


@register(
    "incremental_ingest",
    FIRST_RUN + """
    SELECT row_number() OVER (ORDER BY seq) AS id, canonical_id, title FROM decided JOIN p USING (seq) WHERE label = 'new'
    """,
)
def incremental_ingest(v):
    """The row-by-row rule over all postings, in two micro-batches."""

    def prepare(batch):
        # A micro-batch lives in a session of its own; its partners must come from there.
        own = Inputs(batch.sparkSession, v.sf_dir)
        rows = own.spark.sql(
            VIEWS["v_postings"],
            events=spread(batch), part=own.part, supplier=own.supplier, nation=own.nation,
        )
        empty = ["work_model", "salary_raw", "sector"]
        return rows.withColumns(
            {
                **{name: F.lit(None).cast("string") for name in empty},
                "deadline": F.lit(None).cast("timestamp"),
            }
        )

    state = _folder(v)
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    landed = v.spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1).parquet(_in_files(v, 2))
    S.ingest_stream(landed, prepare, state, f"{state}/progress", as_of).awaitTermination()
    version = S.last_version(v.spark, state)
    return S.read_version(v.spark, state, "jobs", version).select("id", "canonical_id", "title")


@register(
    "redelivery_guard",
    "SELECT DISTINCT event_type AS source_name, user_id, props AS fetch FROM events",
)
def redelivery_guard(v):
    deliveries = _stream(v).select(
        F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_type").alias("source_name"),
        "user_id", F.col("props").alias("fetch"),
    )
    folder = _folder(v)
    (
        S.without_redelivery(deliveries, ["source_name", "user_id", "fetch"])
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return v.spark.read.parquet(f"{folder}/rows").select("source_name", "user_id", "fetch")


def _lookups(v):
    return _stream(v).select(
        F.col("user_id").alias("company_id"), F.col("event_type").alias("origin_hash"),
        F.floor("value").cast("int").alias("transit_minutes"), F.lit("db_rest").alias("api_used"),
        F.col("ts").cast("timestamp").alias("landed_at"),
    )


@register(
    "cache_stream",
    """
    SELECT user_id AS company_id, event_type AS origin_hash,
           CAST(floor(value) AS INT) AS transit_minutes FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1
    """,
)
def cache_stream(v):
    minutes = _lookups(v)
    state = _folder(v)
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    S.cache_stream(minutes, state, f"{state}/progress", as_of).awaitTermination()
    cache = v.spark.read.parquet(f"{state}/cache/version=1")
    return cache.select("company_id", "origin_hash", "transit_minutes")


@register(
    "cache_timers",
    """
    SELECT user_id AS company_id, event_type AS origin_hash, CAST(floor(value) AS INT) AS transit_minutes,
           CASE WHEN ts + INTERVAL 5 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'expired' ELSE 'kept' END AS change
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1
    """,
)
def cache_timers(v):
    """Newest lookup of every key, and whether its five days are over by the end of the stream."""
    state = _folder(v)
    minutes = _lookups(v)
    T.keep_cache(minutes, state, f"{state}/progress", ttl_days=5).awaitTermination()
    return T.latest_changes(T.read_changes(v.spark, state)).select("company_id", "origin_hash", "transit_minutes", "change")
