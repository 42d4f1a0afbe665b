"""All sources by name, and their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame

from stellwerk import constants as K
from stellwerk.sources import encoded_pages, feeds, html_lists, json_lists

# name -> parse(landed, as_of, max_days, details)
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "service_bund": lambda landed, as_of, days, details: feeds.parse_labelled_feed(
        feeds.feed_items(landed), as_of, days
    ),
    "arbeitsagentur": lambda landed, as_of, days, details: json_lists.parse_agency(
        landed, details
    ),
    "interamt": lambda landed, as_of, days, details: html_lists.parse_table_pages(
        landed, as_of, days, details
    ),
    "arbeitnow": lambda landed, as_of, days, details: json_lists.parse_open_board(
        landed, as_of, days
    ),
    "stellenmarkt": lambda landed, as_of, days, details: feeds.parse_category_feeds(
        feeds.feed_items(landed), as_of, days
    ),
    "adzuna": lambda landed, as_of, days, details: json_lists.parse_paged_search(landed),
    "jooble": lambda landed, as_of, days, details: json_lists.parse_snippets(
        landed, as_of, days or 7
    ),
    "jobboerse": lambda landed, as_of, days, details: html_lists.parse_listings(landed, details),
    "kimeta": lambda landed, as_of, days, details: encoded_pages.parse_encoded_pages(
        landed, as_of, days or 7, details
    ),
}


def parse_source(
    name: str, landed: DataFrame, as_of: Column, max_days: int = K.MAX_AGE_DAYS,
    details: DataFrame | None = None,
) -> DataFrame:
    return PARSERS[name](landed, as_of, max_days, details)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
