"""Date and time functions.  The clock is always a parameter (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.constants import ZONE_OFFSETS
from stellwerk.functions.text import once, strip

SECONDS_PER_DAY = 86_400


def rfc2822_timestamp(text: Column) -> Column:
    """Feed dates such as 'Mon, 01 Dec 2025 08:00:00 +0100'."""
    zones = F.create_map([F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])

    def numeric(bare: Column) -> Column:
        named = F.concat(F.regexp_replace(bare, r"[A-Z]+$", ""), F.coalesce(F.try_element_at(zones, _zone(bare)), F.lit("+0000")))
        return F.when(bare.rlike(r"[A-Z]$"), named).otherwise(bare)

    def parsed(written: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(written, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(written, F.lit("d MMM yyyy HH:mm Z")),
        )

    return once(F.regexp_replace(strip(text), r"^\w+,\s*", ""), lambda bare: once(numeric(bare), parsed))


def _zone(bare: Column) -> Column:
    return F.regexp_extract(bare, r"([A-Z]+)$", 1)


def german_date(text: Column) -> Column:
    """'dd.MM.yyyy' as midnight UTC, NULL for anything else."""
    bare = strip(text)
    return F.when(
        bare.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_timestamp(bare, F.lit("d.M.yyyy"))
    )


def german_timestamp(text: Column) -> Column:
    """'dd.MM.yyyy HH:mm' or 'dd.MM.yyyy'."""
    bare = strip(text)
    with_time = F.when(
        bare.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$"),
        F.try_to_timestamp(bare, F.lit("d.M.yyyy H:m")),
    )
    return F.coalesce(with_time, german_date(bare))


def iso_timestamp(text: Column) -> Column:
    """Date-time cut to seconds, or a bare date."""
    head = F.substring(text, 1, 19)
    return F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd")),
    )


def any_timestamp(text: Column) -> Column:
    """ISO text with or without zone; a bare date is midnight."""
    return text.try_cast("timestamp")


def age_days(when: Column, as_of: Column) -> Column:
    """Whole days between two instants, rounded down (a future date is -1)."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(when)
    return F.floor(seconds / SECONDS_PER_DAY)


def is_recent(when: Column, as_of: Column, max_days: int | None) -> Column:
    """Keep undated rows; with no limit (NULL or <= 0) keep every row."""
    if max_days is None or max_days <= 0:
        return F.lit(True)
    return F.coalesce(age_days(when, as_of) <= max_days, F.lit(True))


def week_label(when: Column) -> Column:
    """'YYYY-Www' with weeks starting on Monday, days before the first Monday in week 00."""
    number = F.floor((F.dayofyear(when) - 1 + 7 - F.weekday(when)) / 7)
    return F.concat(
        F.date_format(when, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0")
    )


def next_departure(as_of: Column, weekday: str, time: str) -> Column:
    """Next strictly later given weekday at HH:MM."""
    day = F.next_day(F.to_date(as_of), weekday[:3].upper())
    return F.to_timestamp(
        F.concat(day.cast("string"), F.lit(f" {time}:00")), "yyyy-MM-dd HH:mm:ss"
    )


def expires_at(cached_at: Column, ttl_days: Column) -> Column:
    return cached_at + F.make_dt_interval(days=ttl_days)
