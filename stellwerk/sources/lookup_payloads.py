"""Answers of lookup services and imprint pages as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.html import html_lines
from stellwerk.functions.text import extract, strip

JOURNEYS = "journeys array<struct<legs:array<struct<departure:string,arrival:string>>>>"
ROUTE = "code string, routes array<struct<duration:double,distance:double>>"
GEOCODE = "array<struct<lat:string,lon:string,display_name:string>>"
ADDRESS = "struct<street string, zip_code string, city string>"


def journey_minutes(payload: Column) -> Column:
    """Shortest journey in whole minutes; journeys without legs do not count."""
    journeys = F.filter(
        F.from_json(payload, JOURNEYS)["journeys"], lambda j: F.size(j["legs"]) > 0
    )

    def minutes(journey: Column) -> Column:
        start = F.get(journey["legs"], F.lit(0))["departure"]
        end = F.try_element_at(journey["legs"], F.lit(-1))["arrival"]
        seconds = F.unix_timestamp(end.try_cast("timestamp")) - F.unix_timestamp(
            start.try_cast("timestamp")
        )
        return (seconds / 60).cast("int")

    return F.array_min(F.transform(journeys, minutes))


def route_minutes(payload: Column) -> Column:
    """First route in whole minutes if the answer is fine."""
    route = F.from_json(payload, ROUTE)
    first = F.get(route["routes"], F.lit(0))
    return F.when(route["code"] == "Ok", (first["duration"] / 60).cast("int"))


def geocode_hit(payload: Column) -> Column:
    """First hit as (lat, lng, display_name), NULL when there is none."""
    hit = F.get(F.from_json(payload, GEOCODE), F.lit(0))
    lat, lng = hit["lat"].try_cast("double"), hit["lon"].try_cast("double")
    point = F.struct(lat.alias("lat"), lng.alias("lng"), hit["display_name"].alias("display_name"))
    return F.when(lat.isNotNull() & lng.isNotNull() & hit["display_name"].isNotNull(), point)


def with_imprint_address(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``address``: postal code and place of an imprint page, and the street just above."""
    lined = pages.withColumn("lines", html_lines(payload))
    return lined.withColumn("address", address_in_lines(F.col("lines"))).drop("lines")


def address_in_lines(lines: Column) -> Column:
    """First postal code with place, and the first street in that line or the three above."""
    zip_code = extract(lines, K.IMPRINT_PLACE, 1)
    city = strip(extract(lines, K.IMPRINT_PLACE, 2))
    rows = F.split(lines, "\n", -1)
    # Place names can run over a line break; then no line holds it and there is no street.
    holding = F.transform(rows, lambda r: r.contains(zip_code) & r.contains(city))
    index = F.array_position(holding, F.lit(True)).cast("int")
    near = F.slice(
        rows, F.greatest(index - 3, F.lit(1)), F.least(index, F.lit(4))
    )
    streets = F.filter(
        F.transform(near, lambda r: extract(r, K.IMPRINT_STREET, 1)), lambda s: s.isNotNull()
    )
    street = F.when(index > 0, strip(F.get(streets, F.lit(0))))
    return F.when(
        zip_code.isNotNull(),
        F.struct(street.alias("street"), zip_code.alias("zip_code"), city.alias("city")),
    )
