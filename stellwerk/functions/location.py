"""Location text, work model and score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.text import blank_to_null, contains_any, extract, strip

# (?d): only \n ends a line for '.', as in Python.
_POSTAL_CITY = rf"(?d)^(\p{{Nd}}{{5}}){K.WS}+(.+)$"


def _federal_state(name: Column) -> Column:
    """Canonical spelling of a federal state, NULL for other names."""
    states = F.create_map([F.lit(x) for s in K.FEDERAL_STATES for x in (s.lower(), s)])
    return F.try_element_at(states, F.lower(name))


def _location(raw, pattern_type, city=None, postal=None, region=None, remote=False) -> Column:
    def text(value):
        return (F.lit(None) if value is None else value).cast("string")

    return F.struct(
        text(raw).alias("raw"),
        text(city).alias("city"),
        text(postal).alias("postal_code"),
        text(region).alias("region"),
        F.lit(pattern_type).alias("pattern_type"),
        F.lit(remote).alias("is_remote"),
    )


def parse_location(location: Column) -> Column:
    """Classify a location text; the first rule that holds decides."""
    raw = strip(F.coalesce(location, F.lit("")))
    before_comma = strip(F.substring_index(raw, ",", 1))
    after_comma = strip(F.regexp_extract(raw, r"(?s)^[^,]*,(.*)$", 1))
    verbatim_region = F.coalesce(_federal_state(after_comma), blank_to_null(after_comma))

    rest = strip(F.regexp_extract(raw, _POSTAL_CITY, 2))
    rest_state = F.when(
        rest.contains(","), _federal_state(strip(F.regexp_extract(rest, r"^[^,]*,(.*)$", 1)))
    )
    rest_city = F.when(rest_state.isNotNull(), strip(F.substring_index(rest, ",", 1))).otherwise(
        rest
    )
    return (
        F.when(raw == "", _location(F.lit(""), "unparseable"))
        .when(
            contains_any(F.lower(raw), K.REMOTE_KEYWORDS), _location(raw, "remote", remote=True)
        )
        .when(
            raw.rlike(_POSTAL_CITY),
            _location(
                raw, "plz_city", rest_city, F.regexp_extract(raw, _POSTAL_CITY, 1), rest_state
            ),
        )
        .when(
            raw.contains(",") & before_comma.rlike(_POSTAL_CITY),
            _location(
                raw, "plz_city",
                strip(F.regexp_extract(before_comma, _POSTAL_CITY, 2)),
                F.regexp_extract(before_comma, _POSTAL_CITY, 1),
                blank_to_null(after_comma),
            ),
        )
        .when(
            raw.contains(","), _location(raw, "city_only", before_comma, region=verbatim_region)
        )
        .when(
            _federal_state(raw).isNotNull(), _location(raw, "region", region=_federal_state(raw))
        )
        .when(~raw.rlike(r"[\p{Nd}²³¹]"), _location(raw, "city_only", raw))
        .otherwise(_location(raw, "unparseable"))
    )


def is_remote_place(location: Column) -> Column:
    """Whether a location text stands for work from anywhere; the parser's rule alone."""
    return contains_any(F.lower(F.coalesce(location, F.lit(""))), K.REMOTE_KEYWORDS)


def matches_targets(location: Column, remote: Column, targets: list[str]) -> Column:
    """Remote postings, or a configured place anywhere in the location text."""
    lowered = F.lower(F.coalesce(location, F.lit("")))
    return F.coalesce(remote, F.lit(False)) | contains_any(lowered, targets)


def detect_work_model(text: Column) -> Column:
    """Hybrid before remote before onsite; NULL when no keyword occurs."""
    lowered = F.lower(text)
    return (
        F.when(contains_any(lowered, K.HYBRID_KEYWORDS), "hybrid")
        .when(contains_any(lowered, K.REMOTE_KEYWORDS), "remote")
        .when(contains_any(lowered, K.ONSITE_KEYWORDS), "onsite")
    )


def hybrid_days(text: Column) -> Column:
    """Office days per week: mean of a range rounded down, else the single number."""
    low = extract(text, K.HYBRID_RANGE, 1).cast("int")
    high = extract(text, K.HYBRID_RANGE, 2).cast("int")
    return F.coalesce(
        F.floor((low + high) / 2).cast("int"),
        extract(text, K.HYBRID_SINGLE, 1).cast("int"),
        extract(text, K.HYBRID_PER_WEEK, 1).cast("int"),
    )


def work_model_weight(model: Column, days: Column) -> Column:
    return (
        F.when(model == "remote", K.WEIGHT_REMOTE)
        .when((model == "hybrid") & (days <= 1), K.WEIGHT_HYBRID_1)
        .when((model == "hybrid") & (days > 3), K.WEIGHT_HYBRID_4_5)
        .when(model == "hybrid", K.WEIGHT_HYBRID_2_3)
        .when(model == "onsite", K.WEIGHT_ONSITE)
        .otherwise(K.WEIGHT_UNKNOWN)
    )


def effective_work_model(work_model: Column, raw_text: Column) -> Column:
    """The stored model, or the one found in a non-blank text."""
    return F.coalesce(work_model, F.when(raw_text != "", detect_work_model(raw_text)))


def effective_hybrid_days(work_model: Column, raw_text: Column) -> Column:
    """Days are read only where the model is missing or says hybrid."""
    wanted = (work_model.isNull() | (work_model == "hybrid")) & (raw_text != "")
    return F.when(wanted, hybrid_days(raw_text))


def location_score(
    public: Column, car: Column, model: Column, days: Column, max_commute: int | None = None
) -> Column:
    """Score struct from travel minutes and work model."""
    limit = K.MAX_COMMUTE_MINUTES if max_commute is None else max_commute
    weight = work_model_weight(model, days)
    shortest = F.least(public, car)
    effective = (shortest * weight).cast("int")
    near = 1.0 - (effective / limit) * 0.3
    far = F.greatest(F.lit(0.0), 0.7 - (effective - limit) / 60 * 0.5)
    known = F.round(F.when(effective <= limit, near).otherwise(far), 3)
    remote = weight == 0.0
    return F.struct(
        F.when(remote, 1.0)
        .when(shortest.isNull(), K.SCORE_WITHOUT_MINUTES)
        .otherwise(known)
        .alias("score"),
        F.when(remote | shortest.isNull(), 0).otherwise(effective).alias("effective_minutes"),
        public.cast("int").alias("transit_minutes_public"),
        car.cast("int").alias("transit_minutes_car"),
        F.coalesce(model, F.lit("unknown")).alias("work_model"),
        weight.alias("work_model_weight"),
        days.cast("int").alias("hybrid_days"),
        remote.alias("is_remote"),
    )


def display_name_city(display_name: Column) -> Column:
    return strip(F.get(F.split(display_name, ","), F.lit(0)))


def display_name_postal_code(display_name: Column) -> Column:
    parts = F.transform(F.split(display_name, ","), strip)
    return F.get(F.filter(parts, lambda p: p.rlike(r"^\d{5}$")), F.lit(0))


def location_status(public: Column, car: Column) -> Column:
    """Resolved when either way takes a non-zero number of minutes."""
    known = (F.coalesce(public, F.lit(0)) != 0) | (F.coalesce(car, F.lit(0)) != 0)
    return F.when(known, "resolved").otherwise("failed")
