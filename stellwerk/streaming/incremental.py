"""Incremental ingest with Structured Streaming: the batch operators per micro-batch.

State is a sequence of table snapshots, one folder per version.  Micro-batch n
reads version n and writes version n+1, so a batch repeated after a failure
reads the same input and replaces its own half-written output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stellwerk import constants as K
from stellwerk import schemas
from stellwerk.operators.maintenance import expire, resolve, upsert_cache
from stellwerk.operators.runs import run_stats
from stellwerk.session import cut_lineage

TABLES = {
    "jobs": schemas.JOBS,
    "sources": schemas.JOB_SOURCES,
    "companies": schemas.COMPANIES,
}


def read_version(spark: SparkSession, state: str, table: str, version: int) -> DataFrame:
    """A snapshot; version 0 is the empty table."""
    schema = TABLES[table]
    if version == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/{table}/version={version}")


def _write_version(frame: DataFrame, state: str, table: str, version: int, schema: str) -> None:
    complete = frame.select(
        *[
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(schema)
        ]
    )
    complete.write.mode("overwrite").parquet(f"{state}/{table}/version={version}")


def ingest_batch(
    postings: DataFrame, state: str, version: int, as_of: Column,
    threshold: float = K.FUZZY_THRESHOLD,
) -> DataFrame:
    """Resolve one batch against a version, expire, and write the next one.

    Returns run statistics per source, with the number of expired jobs.
    """
    spark = postings.sparkSession
    tables = {name: read_version(spark, state, name, version) for name in TABLES}
    done = resolve(
        postings, tables["jobs"], tables["sources"], tables["companies"], as_of, threshold
    )
    jobs = expire(done.jobs, as_of)
    written = {"jobs": jobs, "sources": done.sources, "companies": done.companies}
    for name, frame in written.items():
        _write_version(frame, state, name, version + 1, TABLES[name])
    expired = jobs.agg(F.count_if("expired_now").alias("expired"))
    stats = run_stats(done.outcomes, "source_name")
    return stats.withColumn("one", F.lit(1)).join(expired.withColumn("one", F.lit(1)), "one").drop("one")


def ingest_stream(
    landed: DataFrame, prepare: Callable[[DataFrame], DataFrame], state: str, checkpoint: str,
    as_of: Column,
) -> StreamingQuery:
    """Start an available-now ingest of a stream.

    ``prepare`` turns a micro-batch of the stream into postings with ``seq``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        stats = ingest_batch(cut_lineage(prepare(batch)), state, batch_id, as_of)
        stats.withColumn("run_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{state}/run_stats/run={batch_id}"
        )

    return (
        landed.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_version(spark: SparkSession, state: str) -> int:
    """Highest version with run statistics, which are written last."""
    runs = spark.read.parquet(f"{state}/run_stats")
    return runs.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1


def without_redelivery(
    stream: DataFrame, keys: list[str], event_time: str = "fetched_at", delay: str = "1 day"
) -> DataFrame:
    """Drop repeated deliveries of the same fetch.

    The keys must name the fetch, not the source's own id: a later sighting of
    the same posting has to come through to move its last-seen time.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def cache_stream(
    minutes: DataFrame, state: str, checkpoint: str, as_of: Column,
    ttl_days: int = K.TRANSIT_TTL_DAYS,
) -> StreamingQuery:
    """Keep the travel-time cache current; expired rows age out by their own timestamp."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cache = (
            spark.createDataFrame([], schemas.TRANSIT_CACHE)
            if batch_id == 0
            else spark.read.schema(schemas.TRANSIT_CACHE).parquet(f"{state}/cache/version={batch_id}")
        )
        latest = batch.groupBy("company_id", "origin_hash").agg(
            F.max_by("transit_minutes", "landed_at").alias("transit_minutes"),
            F.max_by("api_used", "landed_at").alias("api_used"),
        )
        upsert_cache(cache, latest, as_of, ttl_days).write.mode("overwrite").parquet(
            f"{state}/cache/version={batch_id + 1}"
        )

    return (
        minutes.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
