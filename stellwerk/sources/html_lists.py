"""Sources whose result lists are HTML, and the texts of their detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions import dates as D
from stellwerk.functions import text as X
from stellwerk.functions.html import html_listings, html_table_rows, main_text
from stellwerk.operators.filters import numeric_id, url_shape
from stellwerk.operators.lookups import with_details
from stellwerk.sources.landed import ORDER, as_postings, exploded, first_url


def detail_texts(details: DataFrame, selectors: list[str], strict: bool = False) -> DataFrame:
    """Main text of landed detail pages, keyed by URL."""
    return details.select(
        F.col("search_key").alias("url"),
        main_text(selectors, strict)("payload").alias("detail_text"),
    )


def parse_listings(landed: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Listing containers; the searched place stands in for a missing one."""
    items = exploded(landed, html_listings("payload"))
    linked = items.withColumn("url", X.absolute_url(F.col("href"), K.LISTING_BASE_URL))
    postings = as_postings(
        url_shape(linked, "url").select(
            *ORDER,
            "title",
            X.default_company(F.col("company")).alias("company_name"),
            F.coalesce(X.blank_to_null(F.col("location")), "search_key").alias("location_raw"),
            "url",
            F.regexp_extract("url", K.LISTING_URL_PATTERN, 1).alias("source_job_id"),
        ),
        "jobboerse",
    )
    first = first_url(postings)
    if details is None:
        return first
    return with_details(first, detail_texts(details, K.LISTING_SELECTORS), "url")


def parse_table_pages(
    landed: DataFrame, as_of: Column, max_days: int | None, details: DataFrame | None = None
) -> DataFrame:
    """Result-table rows with a numeric id."""
    rows = numeric_id(exploded(landed, html_table_rows("payload")), "row_id")
    published = D.german_date(F.col("published"))
    postings = as_postings(
        rows.select(
            *ORDER,
            "title",
            X.default_company(F.col("company")).alias("company_name"),
            X.blank_to_null(F.col("location")).alias("location_raw"),
            X.url_from_template(K.TABLE_JOB_URL, F.col("row_id")).alias("url"),
            published.alias("published_at"),
            D.german_date(F.col("deadline")).alias("deadline"),
            F.col("row_id").alias("source_job_id"),
            F.lit(K.SECTOR_PUBLIC_LABEL).alias("sector"),
        ),
        "interamt",
    )
    first = first_url(postings).where(D.is_recent(F.col("published_at"), as_of, max_days))
    if details is None:
        return first
    return with_details(first, detail_texts(details, K.TABLE_SELECTORS), "url")
