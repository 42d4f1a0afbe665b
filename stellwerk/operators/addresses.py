"""Company addresses from four sources in order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.location import display_name_city, display_name_postal_code
from stellwerk.functions.text import base_url, is_blank
from stellwerk.sources.lookup_payloads import geocode_hit, with_imprint_address
from stellwerk import constants as K


def _address(street, city, zip_code, lat, lng, source: str) -> Column:
    return F.struct(
        street.cast("string").alias("street"), city.cast("string").alias("city"),
        zip_code.cast("string").alias("zip_code"), lat.cast("double").alias("lat"),
        lng.cast("double").alias("lng"), F.lit(source).alias("source"),
        F.lit("found").alias("status"),
    )


def geocoded(landed: DataFrame) -> DataFrame:
    """Landed geocoder answers: query text and first hit; empty answers drop out."""
    hits = landed.select(F.col("search_key").alias("query"), geocode_hit(F.col("payload")).alias("hit"))
    return hits.where(F.col("hit").isNotNull()).groupBy("query").agg(F.max("hit").alias("hit"))


def address_query(street: Column, zip_code: Column, city: Column) -> Column:
    """Text a found address is geocoded with."""
    place = F.concat_ws(" ", zip_code, city)
    return F.when(is_blank(street), place).otherwise(F.concat(street, F.lit(", "), place))


def imprint_requests(wanted: DataFrame) -> DataFrame:
    """Imprint pages to land for jobs with a source URL, in order of preference."""
    paths = F.array(*[F.lit(path) for path in K.IMPRINT_PATHS])
    sites = wanted.where(F.col("source_url").isNotNull()).select(
        "company_id", base_url(F.col("source_url")).alias("site")
    ).distinct()
    return sites.select("company_id", F.posexplode(paths).alias("rank", "path"), "site").select(
        "company_id", "rank", F.concat("site", "path").alias("url")
    )


def page_addresses(pages: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """First address per company over its landed pages (company_id, rank, payload), geocoded."""
    # Pages without an address have no rank: a filter would parse every page a second time.
    rank = F.when(F.col("address").isNotNull(), F.col("rank"))
    first = with_imprint_address(pages).groupBy("company_id").agg(F.min_by("address", rank).alias("a"))
    first = first.where(F.col("a").isNotNull())
    asked = first.withColumn(
        "query", address_query(F.col("a.street"), F.col("a.zip_code"), F.col("a.city"))
    )
    return asked.join(points, "query", "left").select(
        "company_id",
        _address(
            F.col("a.street"), F.col("a.city"), F.col("a.zip_code"), F.col("hit.lat"),
            F.col("hit.lng"), source,
        ).alias(source),
    )


def resolve_addresses(
    wanted: DataFrame, companies: DataFrame, imprint_pages: DataFrame, search_pages: DataFrame,
    geocodes: DataFrame,
) -> DataFrame:
    """Address per company that a job needs one for.

    ``wanted``: company_id and location_raw of the jobs to place.  The order is
    the stored address, imprint, web result, then the geocoded location text;
    companies none of them can place come back with a NULL address.
    """
    known = companies.where(F.col("address_status") == "found").select(
        F.col("id").alias("company_id"),
        _address(
            F.col("address_street"), F.col("address_city"), F.col("address_zip"), F.col("lat"),
            F.col("lng"), "db",
        ).alias("db"),
    )
    points = geocoded(geocodes)
    places = wanted.where(~is_blank(F.col("location_raw"))).select(
        "company_id", F.col("location_raw").alias("query")
    ).distinct()
    name = F.col("hit.display_name")
    by_text = (
        places.join(points, "query")
        .groupBy("company_id")
        .agg(F.min_by("hit", "query").alias("hit"))
        .select(
            "company_id",
            _address(
                F.lit(None), display_name_city(name), display_name_postal_code(name),
                F.col("hit.lat"), F.col("hit.lng"), "nominatim",
            ).alias("nominatim"),
        )
    )
    stages = [
        known,
        page_addresses(imprint_pages, points, "impressum"),
        page_addresses(search_pages, points, "searxng"),
        by_text,
    ]
    placed = wanted.select("company_id").where(F.col("company_id").isNotNull()).distinct()
    for stage in stages:
        placed = placed.join(stage, "company_id", "left")
    order = ["db", "impressum", "searxng", "nominatim"]
    return placed.select(F.col("company_id").alias("id"), F.coalesce(*order).alias("address"))
