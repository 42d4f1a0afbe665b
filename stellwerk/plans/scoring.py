"""Location scoring of a batch of jobs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions import location as L
from stellwerk.functions.dates import next_departure
from stellwerk.operators.filters import scoring_candidates
from stellwerk.operators.lookups import with_cached_minutes
from stellwerk.operators.maintenance import update_location_status


@dataclass
class Scored:
    """Scores with status, new cache rows, and lookups still to be landed."""

    scores: DataFrame
    fresh_minutes: DataFrame
    missing_lookups: DataFrame


def settle(jobs: DataFrame) -> DataFrame:
    """Jobs with work model, days and ``is_remote``; texts are dropped before anything is joined.

    Remote jobs need no minutes: they, and jobs without a company, get a company key of their
    own that no company has, instead of one shared NULL.
    """
    model = L.effective_work_model(F.col("work_model"), F.col("raw_text"))
    days = L.effective_hybrid_days(F.col("work_model"), F.col("raw_text"))
    settled = jobs.select(
        "id", "company_id", model.alias("model"), days.alias("days"),
        L.is_remote_place(F.col("location_raw")).alias("place_is_remote"),
    )
    remote = F.col("place_is_remote") | F.coalesce(F.col("model") == "remote", F.lit(False))
    return settled.withColumn("is_remote", remote).withColumn(
        "company_id", F.coalesce(F.when(~F.col("is_remote"), F.col("company_id")), -F.col("id") - 1)
    ).drop("place_is_remote")


def score_jobs(
    jobs: DataFrame, addresses: DataFrame, cache: DataFrame, transit: DataFrame, routes: DataFrame,
    as_of: Column, home: str = K.HOME_ADDRESS, max_commute: int = K.MAX_COMMUTE_MINUTES,
) -> Scored:
    """Score jobs against resolved addresses and landed minutes.

    ``addresses``: id, address.  ``transit``: company_id, primary_minutes,
    fallback_minutes.  ``routes``: company_id, car_minutes.
    """
    settled = settle(jobs)
    points = addresses.select(
        F.col("id").alias("company_id"), F.col("address.lat").alias("lat"),
        F.col("address.lng").alias("lng"),
    )
    # A coordinate of exactly 0 counts as missing.
    has_point = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0)
    origin = hashlib.sha256(home.encode()).hexdigest()
    placed = (
        with_cached_minutes(settled.join(points, "company_id", "left"), cache, origin, as_of)
        .join(transit, "company_id", "left")
        .join(routes, "company_id", "left")
    )
    landed = F.coalesce("primary_minutes", "fallback_minutes")
    timed = placed.select(
        "id", "company_id", "model", "days", "is_remote", "lat", "lng", has_point.alias("has_point"),
        F.when(has_point, F.coalesce("cached_minutes", landed)).alias("public"),
        F.when(has_point, F.col("car_minutes")).alias("car"),
        (has_point & F.col("cached_minutes").isNull() & landed.isNotNull()).alias("is_fresh"),
        F.when(F.col("primary_minutes").isNotNull(), "db_rest").otherwise("transport_rest").alias(
            "api_used"
        ),
    )
    public, car = F.col("public"), F.col("car")
    remote = F.col("is_remote")
    model = F.when(remote, "remote").otherwise(F.col("model"))
    days = F.when(~remote, F.col("days"))
    scores = timed.select(
        "id",
        L.location_score(public, car, model, days, max_commute).alias("s"),
        F.when(remote, "resolved").otherwise(L.location_status(public, car)).alias("status"),
    ).select("id", "s.*", "status")
    fresh = timed.where("is_fresh").groupBy("company_id").agg(
        F.max("public").alias("transit_minutes"), F.max("api_used").alias("api_used")
    ).withColumn("origin_hash", F.lit(origin))
    departure = next_departure(as_of, K.DEPARTURE_WEEKDAY, K.DEPARTURE_TIME)
    missing = (
        timed.where(has_point & (public.isNull() | car.isNull()))
        .groupBy("company_id")
        .agg(
            F.first("lat").alias("lat"), F.first("lng").alias("lng"),
            F.bool_or(public.isNull()).alias("needs_transit"),
            F.bool_or(car.isNull()).alias("needs_route"),
        )
        .withColumn("departure", departure)
    )
    return Scored(scores, fresh, missing)


def score_batch(
    jobs: DataFrame, addresses: DataFrame, cache: DataFrame, transit: DataFrame, routes: DataFrame,
    as_of: Column, limit: int | None = None,
) -> tuple[Scored, DataFrame]:
    """Score the jobs without a location status, and write their status.

    Returns the scores and the next jobs: candidates that could be placed are resolved, the
    others failed; all other jobs stay as they are.
    """
    scored = score_jobs(scoring_candidates(jobs, limit), addresses, cache, transit, routes, as_of)
    return scored, update_location_status(jobs, scored.scores.select("id", "status"), as_of)


def batch_view(scores: DataFrame) -> DataFrame:
    """Result columns of a scoring batch."""
    return scores.select(
        F.col("id").alias("job_id"), "score", "effective_minutes",
        F.col("transit_minutes_public").alias("transit_public"),
        F.col("transit_minutes_car").alias("transit_car"), "work_model", "is_remote",
    )
