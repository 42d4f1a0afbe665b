"""The travel-time cache as keyed state with timers: newest lookup per key, and the keys that expire.

Each key's state holds one lookup and one event-time timer at its expiry.  A micro-batch writes only
the keys it changed or expired; nothing rewrites the cache as a whole.  Time is the lookups' own
landing time, never the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stellwerk import constants as K

KEPT, EXPIRED = "kept", "expired"
_KEY = ["company_id", "origin_hash"]
_LOOKUP = "transit_minutes int, api_used string, cached_us bigint"
_CHANGE = f"company_id bigint, origin_hash string, {_LOOKUP}, expires_us bigint, change string"
CHANGES = (
    "company_id bigint, origin_hash string, transit_minutes int, api_used string, cached_at timestamp,"
    " expires_at timestamp, change string"
)
_DAY_US = 86_400_000_000


def cache_changes(minutes: DataFrame, ttl_days: int = K.TRANSIT_TTL_DAYS, delay: str = "1 day") -> DataFrame:
    """Stream of changes: a key's newest lookup, or the lookup that has expired.

    ``minutes`` is a stream of company_id, origin_hash, transit_minutes, api_used and landed_at;
    lookups later than ``delay`` are dropped, and of equally late ones the larger minutes win.
    """

    names = [field.split()[0] for field in _CHANGE.split(", ")]

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(lookup: tuple, change: str) -> pd.DataFrame:
            values = (*key, *lookup, int(lookup[2]) + ttl_days * _DAY_US, change)
            return pd.DataFrame({name: [value] for name, value in zip(names, values)})

        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield told(held, EXPIRED)
            return
        newest = held
        for batch in batches:
            # Most keys have few rows: a list per column costs less than a tuple type per batch.
            for minute, api, landed in zip(*(batch[name].tolist() for name in ("transit_minutes", "api_used", "landed_us"))):
                lookup = (int(minute), api, int(landed))
                if newest is None or (lookup[2], lookup[0]) > (newest[2], newest[0]):
                    newest = lookup
        expires_ms = (newest[2] + ttl_days * _DAY_US) // 1000
        if expires_ms < state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield told(newest, EXPIRED)
            return
        state.update(newest)
        # A timer must lie after the watermark.
        state.setTimeoutTimestamp(max(expires_ms, state.getCurrentWatermarkMs() + 1))
        if newest != held:
            yield told(newest, KEPT)

    timed = minutes.withWatermark("landed_at", delay).select(
        *_KEY, "transit_minutes", "api_used", "landed_at", F.unix_micros("landed_at").alias("landed_us")
    )
    changes = timed.groupBy(*_KEY).applyInPandasWithState(
        keep, _CHANGE, _LOOKUP, "update", GroupStateTimeout.EventTimeTimeout
    )
    return changes.select(
        *_KEY, "transit_minutes", "api_used", F.timestamp_micros("cached_us").alias("cached_at"),
        F.timestamp_micros("expires_us").alias("expires_at"), "change",
    )


def keep_cache(
    minutes: DataFrame, state: str, checkpoint: str, ttl_days: int = K.TRANSIT_TTL_DAYS, delay: str = "1 day"
) -> StreamingQuery:
    """Write the changes of each micro-batch to a folder of its own; a repeated batch replaces it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/changes/batch={batch_id}")

    return (
        cache_changes(minutes, ttl_days, delay)
        .writeStream.foreachBatch(run)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_changes(spark: SparkSession, state: str) -> DataFrame:
    """All changes, with the micro-batch that wrote them."""
    return spark.read.schema(f"{CHANGES}, batch int").parquet(f"{state}/changes")


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change of every key; the cache is what is kept there."""
    rest = [c for c in changes.columns if c not in _KEY]
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return changes.groupBy(*_KEY).agg(last).select(*_KEY, "last.*").drop("batch")
