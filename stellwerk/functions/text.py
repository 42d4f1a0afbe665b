"""Text functions: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.constants import DEFAULT_COMPANY, NON_WORD, PUBLIC_SECTOR_VALUES, SECTOR_PUBLIC, WS


# What ``WS`` matches, as characters: trimming by them costs a fraction of a pattern.
_WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also in a filter, where Spark shares no common parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(_WS_CHARS))


def collapse(text: Column) -> Column:
    """Trim, and turn every run of whitespace into one blank."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def nfc(text: Column) -> Column:
    """Unicode composition.

    Characters below U+0300 are always composed, so only rows holding a higher
    one pay for the call; it goes to the ICU library Spark itself ships.
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), composed).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Compose, lower, strip, drop punctuation, collapse blanks - in this order."""
    stripped = strip(F.lower(nfc(text)))
    return F.regexp_replace(F.regexp_replace(stripped, NON_WORD, ""), f"{WS}+", " ")


def strip_postal_prefix(location: Column) -> Column:
    return F.regexp_replace(location, rf"^\p{{Nd}}{{4,5}}{WS}+", "")


def canonical_id(title: Column, company: Column, location: Column) -> Column:
    """SHA-256 over normalised title, company and location without postal code."""
    place = strip_postal_prefix(F.coalesce(location, F.lit("")))
    return F.sha2(
        F.concat(
            normalize_text(title), F.lit("|"), normalize_text(company), F.lit("|"),
            normalize_text(place),
        ),
        256,
    )


def origin_hash(address: Column) -> Column:
    return F.sha2(address, 256)


def default_company(name: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(DEFAULT_COMPANY))


def split_title_company(title: Column) -> tuple[Column, Column]:
    """Split at the last ' - '; without one the company is the default."""
    pattern = r"(?s)^(.*) - (.*)$"
    has_company = title.contains(" - ")
    return (
        F.when(has_company, strip(F.regexp_extract(title, pattern, 1))).otherwise(title),
        F.when(has_company, strip(F.regexp_extract(title, pattern, 2))).otherwise(
            F.lit(DEFAULT_COMPANY)
        ),
    )


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_segment_digits(url: Column) -> Column:
    """First digits of the last path segment, trailing slashes ignored."""
    segment = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    return blank_to_null(F.regexp_extract(segment, r"(\d+)", 1))


def url_from_template(template: str, key: Column) -> Column:
    head, tail = template.split("{id}")
    return F.concat(F.lit(head), key, F.lit(tail))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def base_url(url: Column) -> Column:
    """Scheme and host."""
    return F.concat(
        F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"),
        F.try_parse_url(url, F.lit("AUTHORITY")),
    )


def salary_text(low: Column, high: Column) -> Column:
    """'55.000 – 75.000 EUR' from two numbers, NULL when one is missing."""
    def euros(value: Column) -> Column:
        whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
        return F.translate(F.format_number(whole, 0), ",", ".")

    return F.concat(euros(low), F.lit(" – "), euros(high), F.lit(" EUR"))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Whether an already lower-cased text contains one of the words."""
    return reduce(or_, [lowered.contains(word.lower()) for word in words], F.lit(False))


def completeness_class(text: Column) -> Column:
    from stellwerk import constants as K

    return (
        F.when(text.isNull(), K.TEXT_NULL)
        .when(text == "", K.TEXT_EMPTY)
        .when(F.length(text) < K.SHORT_TEXT_CHARS, K.TEXT_SHORT)
        .otherwise(K.TEXT_OK)
    )


def sector_norm(sector: Column) -> Column:
    """Public-sector spellings become one value, everything else is unknown."""
    return F.when(F.lower(sector).isin(PUBLIC_SECTOR_VALUES), SECTOR_PUBLIC)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent, 0.0 for an empty total."""
    return F.when(total > 0, F.round(part / total * 100, digits)).otherwise(F.lit(0.0))


def ratio(part: Column, total: Column, digits: int = 2) -> Column:
    return F.when(total > 0, F.round(part / total, digits)).otherwise(F.lit(0.0))


def python_list(names: Column) -> Column:
    """Array of names as a bracketed, quoted list for report messages."""
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
