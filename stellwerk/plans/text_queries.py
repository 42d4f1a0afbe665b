"""Registered queries: text, date and location functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions import dates as D
from stellwerk.functions import location as L
from stellwerk.functions import text as X
from stellwerk.operators import filters as W
from stellwerk.plans.registry import register

_WS = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"


def sql_normalize(text: str) -> str:
    """Checking SQL of the text normalisation."""
    lowered = f"regexp_replace(lower(nfc_normalize({text})), '^{_WS}+|{_WS}+$', '', 'g')"
    kept = rf"regexp_replace({lowered}, '[^\p{{L}}\p{{N}}_\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]', '', 'g')"
    return f"regexp_replace({kept}, '{_WS}+', ' ', 'g')"


def sql_canonical_id(title: str, company: str, location: str) -> str:
    place = rf"regexp_replace(coalesce({location}, ''), '^\d{{4,5}}\s+', '')"
    return (
        f"sha256({sql_normalize(title)} || '|' || {sql_normalize(company)} || '|' || "
        f"{sql_normalize(place)})"
    )


@register(
    "normalize_text",
    f"SELECT doc_id, sha256({sql_normalize('text')}) AS text_hash,"
    f" length({sql_normalize('text')}) AS n FROM documents",
)
def normalize_text(v):
    clean = v.documents.select("doc_id", X.normalize_text(F.col("text")).alias("clean"))
    return clean.select(
        "doc_id", F.sha2("clean", 256).alias("text_hash"), F.length("clean").cast("bigint").alias("n")
    )


@register(
    "canonical_id",
    f"""
    SELECT order_id, line, part_id, {sql_canonical_id('title', 'company_name', 'location_raw')}
           AS canonical_id
    FROM v_offers
    """,
)
def canonical_id(v):
    ident = X.canonical_id(F.col("title"), F.col("company_name"), F.col("location_raw"))
    return v.v_offers.select("order_id", "line", "part_id", ident.alias("canonical_id"))


@register(
    "duplicate_texts",
    f"""
    SELECT sha256({sql_normalize('text')}) AS text_hash, count(*) AS copies,
           min(doc_id) AS first_doc
    FROM documents GROUP BY 1 HAVING count(*) > 1
    """,
)
def duplicate_texts(v):
    hashed = v.documents.select(
        "doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("text_hash")
    )
    return (
        hashed.groupBy("text_hash")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
        .where(F.col("copies") > 1)
    )


@register(
    "origin_hash",
    "SELECT c_custkey, sha256(c_name || ', ' || n_name) AS origin_hash"
    " FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def origin_hash(v):
    joined = v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    address = F.concat("c_name", F.lit(", "), "n_name")
    return joined.select("c_custkey", X.origin_hash(address).alias("origin_hash"))


@register(
    "strip_postal_prefix",
    "SELECT location_raw, regexp_replace(location_raw, '^[0-9]{4,5} +', '') AS place,"
    " count(*) AS offers FROM v_offers GROUP BY 1, 2",
)
def strip_postal_prefix(v):
    place = X.strip_postal_prefix(F.col("location_raw"))
    return v.v_offers.groupBy("location_raw", place.alias("place")).agg(
        F.count("*").alias("offers")
    )


@register(
    "date_formats",
    """
    SELECT order_id, line, part_id, strftime(shipped_at, '%Y-%m-%d %H:%M:%S') AS german,
           strftime(shipped_at + INTERVAL 605 MINUTE, '%Y-%m-%d %H:%M:%S') AS german_time,
           strftime(shipped_at - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS feed,
           strftime(shipped_at, '%Y-%m-%d %H:%M:%S') AS iso,
           CAST(NULL AS VARCHAR) AS unreadable
    FROM v_offers
    """,
)
def date_formats(v):
    ts = F.col("shipped_at").cast("timestamp")

    def shown(when):
        return F.date_format(when, "yyyy-MM-dd HH:mm:ss")

    return v.v_offers.select(
        "order_id", "line", "part_id",
        shown(D.german_date(F.date_format(ts, "dd.MM.yyyy"))).alias("german"),
        shown(D.german_timestamp(F.concat(F.date_format(ts, "dd.MM.yyyy"), F.lit(" 10:05"))))
        .alias("german_time"),
        shown(D.rfc2822_timestamp(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0100'")))
        .alias("feed"),
        shown(D.iso_timestamp(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.0000000'"))).alias("iso"),
        shown(D.german_timestamp(F.col("title"))).alias("unreadable"),
    )


@register(
    "week_label",
    "SELECT strftime(o_orderdate, '%Y-W%W') AS week, count(*) AS jobs FROM orders GROUP BY 1",
)
def week_label(v):
    return v.orders.groupBy(D.week_label(F.col("o_orderdate")).alias("week")).agg(
        F.count("*").alias("jobs")
    )


@register(
    "next_departure",
    """
    SELECT event_id, strftime(date_trunc('day', ts)
             + to_days(CAST(CASE WHEN isodow(ts) < 2 THEN 2 - isodow(ts)
                                 ELSE 9 - isodow(ts) END AS INTEGER))
             + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS departure
    FROM events
    """,
)
def next_departure(v):
    departure = D.next_departure(F.col("ts"), K.DEPARTURE_WEEKDAY, K.DEPARTURE_TIME)
    return v.events.select(
        "event_id", F.date_format(departure, "yyyy-MM-dd HH:mm:ss").alias("departure")
    )


@register(
    "completeness_class",
    """
    SELECT source, CASE WHEN text IS NULL THEN 'NULL' WHEN text = '' THEN 'leer'
                        WHEN length(text) < 50 THEN 'sehr_kurz (<50)' ELSE 'ok' END AS class,
           count(*) AS texts
    FROM documents GROUP BY 1, 2
    """,
)
def completeness_class(v):
    return v.documents.groupBy(
        "source", X.completeness_class(F.col("text")).alias("class")
    ).agg(F.count("*").alias("texts"))


@register(
    "title_company_split",
    """
    SELECT order_id, line, part_id, title || ' - ' || flag AS title, company_name
    FROM v_offers
    """,
)
def title_company_split(v):
    joined = F.concat("title", F.lit(" - "), "flag", F.lit(" - "), "company_name")
    title, company = X.split_title_company(joined)
    return v.v_offers.select(
        "order_id", "line", "part_id", title.alias("title"), company.alias("company_name")
    )


@register(
    "url_parts",
    """
    SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base,
           nullif(regexp_extract(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1),
                                 '([0-9]+)', 1), '') AS segment_id,
           'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || page_id AS detail_url
    FROM pages
    """,
)
def url_parts(v):
    url = F.col("url")
    return v.pages.select(
        "page_id", X.base_url(url).alias("base"), X.last_segment_digits(url).alias("segment_id"),
        X.url_from_template(K.AGENCY_JOB_URL, F.col("page_id").cast("string")).alias("detail_url"),
    )


@register(
    "salary_text",
    """
    SELECT o_orderkey,
           replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') || ' – '
           || replace(format('{:,}', CAST(floor(o_totalprice * 2) AS BIGINT)), ',', '.')
           || ' EUR' AS salary
    FROM orders
    """,
)
def salary_text(v):
    low = F.col("o_totalprice")
    return v.orders.select("o_orderkey", X.salary_text(low, low * 2).alias("salary"))


@register(
    "parse_location",
    """
    WITH raw AS (SELECT id, trim(coalesce(location_raw, '')) AS raw FROM v_jobs),
    parts AS (
      SELECT id, raw, regexp_matches(lower(raw), 'remote|homeoffice|home office') AS remote,
             regexp_extract(raw, '^([0-9]{5}) +(.+)$', 1) AS plz,
             trim(regexp_extract(raw, '^([0-9]{5}) +(.+)$', 2)) AS rest,
             trim(split_part(raw, ',', 1)) AS lft,
             trim(regexp_extract(raw, '^[^,]*,(.*)$', 1)) AS rgt
      FROM raw)
    SELECT id,
           CASE WHEN raw = '' THEN 'unparseable' WHEN remote THEN 'remote'
                WHEN plz <> '' THEN 'plz_city' WHEN contains(raw, ',') THEN 'city_only'
                WHEN raw = 'sachsen' THEN 'region'
                WHEN NOT regexp_matches(raw, '[0-9]') THEN 'city_only'
                ELSE 'unparseable' END AS pattern_type,
           CASE WHEN raw = '' OR remote THEN NULL
                WHEN plz <> '' THEN CASE WHEN rgt = 'hessen' THEN split_part(rest, ',', 1)
                                         ELSE rest END
                WHEN contains(raw, ',') THEN lft
                WHEN raw <> 'sachsen' AND NOT regexp_matches(raw, '[0-9]') THEN raw END AS city,
           CASE WHEN raw <> '' AND NOT remote THEN nullif(plz, '') END AS postal_code,
           CASE WHEN raw = '' OR remote THEN NULL
                WHEN plz <> '' THEN CASE WHEN rgt = 'hessen' THEN 'Hessen' END
                WHEN contains(raw, ',') THEN CASE WHEN rgt = 'bayern' THEN 'Bayern'
                                                  ELSE nullif(rgt, '') END
                WHEN raw = 'sachsen' THEN 'Sachsen' END AS region,
           raw <> '' AND remote AS is_remote
    FROM parts
    """,
)
def parse_location(v):
    parsed = v.v_jobs.select("id", L.parse_location(F.col("location_raw")).alias("p"))
    return parsed.select(
        "id", "p.pattern_type", "p.city", "p.postal_code", "p.region", "p.is_remote"
    )


def _words(keywords: list[str]) -> str:
    return "'" + "|".join(keywords) + "'"


def _pattern(pattern: str) -> str:
    """A pattern as DuckDB writes it: letters are Unicode there anyway."""
    return "'" + pattern.replace("(?iu)", "(?i)") + "'"


_MODEL = f"""
    CASE WHEN regexp_matches(lower({{0}}), {_words(K.HYBRID_KEYWORDS)}) THEN 'hybrid'
         WHEN regexp_matches(lower({{0}}), {_words(K.REMOTE_KEYWORDS)}) THEN 'remote'
         WHEN regexp_matches(lower({{0}}), {_words(K.ONSITE_KEYWORDS)}) THEN 'onsite' END
"""
_RANGE, _SINGLE, _PER_WEEK = map(_pattern, (K.HYBRID_RANGE, K.HYBRID_SINGLE, K.HYBRID_PER_WEEK))
_DAYS = f"""
    CASE WHEN regexp_matches({{0}}, {_RANGE})
         THEN CAST(floor((CAST(regexp_extract({{0}}, {_RANGE}, 1) AS INT) + CAST(regexp_extract({{0}}, {_RANGE}, 2) AS INT)) / 2) AS INT)
         WHEN regexp_matches({{0}}, {_SINGLE}) THEN CAST(regexp_extract({{0}}, {_SINGLE}, 1) AS INT)
         WHEN regexp_matches({{0}}, {_PER_WEEK}) THEN CAST(regexp_extract({{0}}, {_PER_WEEK}, 1) AS INT) END
"""


@register(
    "detect_work_model",
    f"SELECT id, {_MODEL.format('raw_text')} AS work_model, {_DAYS.format('raw_text')} AS days"
    " FROM v_texts",
)
def detect_work_model(v):
    text = F.col("raw_text")
    return v.v_texts.select(
        "id", L.detect_work_model(text).alias("work_model"), L.hybrid_days(text).alias("days")
    )


@register(
    "work_model_weight",
    """
    SELECT model, days, count(*) AS rows,
           CASE WHEN model = 'remote' THEN 0.0
                WHEN model = 'hybrid' AND days <= 1 THEN 0.2
                WHEN model = 'hybrid' AND days > 3 THEN 0.8
                WHEN model = 'hybrid' THEN 0.5
                WHEN model = 'onsite' THEN 1.0 ELSE 0.6 END::DOUBLE AS weight
    FROM v_commute GROUP BY model, days
    """,
)
def work_model_weight(v):
    return (
        v.v_commute.groupBy("model", "days")
        .agg(F.count("*").alias("rows"))
        .withColumn("weight", L.work_model_weight(F.col("model"), F.col("days")))
    )


@register(
    "location_score",
    """
    WITH weighted AS (
      SELECT *, CASE WHEN model = 'remote' THEN 0.0
                     WHEN model = 'hybrid' AND days <= 1 THEN 0.2
                     WHEN model = 'hybrid' AND days > 3 THEN 0.8
                     WHEN model = 'hybrid' THEN 0.5
                     WHEN model = 'onsite' THEN 1.0 ELSE 0.6 END::DOUBLE AS weight,
             least(public, car) AS minutes FROM v_commute),
    timed AS (SELECT *, CAST(trunc(minutes * weight) AS INT) AS eff FROM weighted)
    SELECT order_id, line, part_id,
           CASE WHEN weight = 0 THEN 1.0 WHEN minutes IS NULL THEN 0.5
                WHEN eff <= 60 THEN round(1.0::DOUBLE - (eff / 60) * 0.3::DOUBLE, 3)
                ELSE round(greatest(0.0::DOUBLE, 0.7::DOUBLE - (eff - 60) / 60 * 0.5::DOUBLE), 3)
           END::DOUBLE AS score,
           CASE WHEN weight = 0 OR minutes IS NULL THEN 0 ELSE eff END AS effective_minutes,
           weight = 0 AS is_remote,
           CASE WHEN coalesce(public, 0) <> 0 OR coalesce(car, 0) <> 0 THEN 'resolved'
                ELSE 'failed' END AS status
    FROM timed
    """,
)
def location_score(v):
    minutes = F.col("public"), F.col("car")
    scored = v.v_commute.withColumn(
        "s", L.location_score(*minutes, F.col("model"), F.col("days"))
    )
    return scored.select(
        "order_id", "line", "part_id", "s.score", "s.effective_minutes", "s.is_remote",
        L.location_status(*minutes).alias("status"),
    )


AS_OF = "2001-07-01 06:30:00"


@register(
    "filter_recent",
    f"""
    SELECT o_orderkey FROM orders
    WHERE floor((epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400) <= 30
    """,
)
def filter_recent(v):
    as_of = F.lit(AS_OF).cast("timestamp")
    return W.recent(v.orders, "o_orderdate", as_of, 30).select("o_orderkey")


@register(
    "filter_cutoff",
    f"SELECT event_id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-30') - 7 * 86400",
)
def filter_cutoff(v):
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return W.newer_than(v.events, "ts", as_of, 7).select("event_id")


@register(
    "filter_targets",
    """
    SELECT id FROM v_jobs WHERE coalesce(work_model = 'remote', false)
       OR contains(lower(coalesce(location_raw, '')), 'asia')
       OR contains(lower(coalesce(location_raw, '')), 'remote')
    """,
)
def filter_targets(v):
    return W.in_targets(
        v.v_jobs, "location_raw", F.col("work_model") == "remote", ["Asia", "Remote"]
    ).select("id")


@register(
    "filter_required",
    "SELECT id FROM v_jobs WHERE title <> '' AND location_raw <> '' AND raw_text <> ''",
)
def filter_required(v):
    return W.required(v.v_jobs, "title", "location_raw", "raw_text")[0].select("id")


@register(
    "filter_required_rejects",
    "SELECT id FROM v_jobs WHERE NOT (coalesce(title, '') <> '' AND coalesce(location_raw, '') <> ''"
    " AND coalesce(raw_text, '') <> '')",
)
def filter_required_rejects(v):
    return W.required(v.v_jobs, "title", "location_raw", "raw_text")[1].select("id")


@register(
    "filter_posting_urls",
    r"SELECT page_id FROM pages WHERE regexp_matches(url, '/en/[0-9]+')",
)
def filter_posting_urls(v):
    return W.url_shape(v.pages, "url", r"/en/\d+").select("page_id")


@register(
    "filter_numeric_ids",
    "SELECT seq FROM v_postings WHERE regexp_matches(coalesce(source_job_id, ''), '^[0-9]+$')"
    " OR source_job_id IS NULL",
)
def filter_numeric_ids(v):
    missing = v.v_postings.where(F.col("source_job_id").isNull())
    return W.numeric_id(v.v_postings, "source_job_id").unionByName(missing).select("seq")


@register(
    "filter_active_titles",
    """
    SELECT DISTINCT c.id AS company_id, j.title
    FROM v_jobs j JOIN v_companies c ON c.id = j.company_id WHERE j.is_active
    """,
)
def filter_active_titles(v):
    companies = v.v_companies.select(F.col("id").alias("company_id"))
    return W.active_titles(v.v_jobs, companies).distinct()


@register(
    "filter_expired",
    f"""
    SELECT id FROM v_jobs WHERE deadline < TIMESTAMP '{AS_OF}' AND is_active
      AND status NOT IN ('applying', 'applied', 'interview', 'offer')
    """,
)
def filter_expired(v):
    return v.v_jobs.where(W.is_expired(F.lit(AS_OF).cast("timestamp"))).select("id")


@register(
    "scoring_candidates",
    """
    SELECT id, title FROM v_jobs WHERE location_status = 'unknown' AND is_active
      AND status NOT IN ('expired', 'ignored')
    """,
)
def scoring_candidates(v):
    return W.scoring_candidates(v.v_jobs).select("id", "title")


@register(
    "scoring_candidates_all",
    """
    SELECT id FROM v_jobs WHERE location_status = 'unknown' AND is_active
      AND status NOT IN ('expired', 'ignored')
    """,
)
def scoring_candidates_all(v):
    return W.scoring_candidates(v.v_jobs).select("id")


@register(
    "address_candidates",
    "SELECT id, name FROM v_companies WHERE address_status = 'unknown'",
)
def address_candidates(v):
    return W.address_candidates(v.v_companies)


@register(
    "backfill_candidates",
    """
    SELECT DISTINCT j.id, j.title, s.url, strftime(j.first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen
    FROM v_jobs j JOIN v_sources s ON s.job_id = j.id
    WHERE s.source_name = 'AF' AND coalesce(j.raw_text, '') = '' AND j.is_active
    """,
)
def backfill_candidates(v):
    seen = F.date_format(F.col("first_seen_at"), "yyyy-MM-dd HH:mm:ss").alias("first_seen")
    return W.backfill_candidates(v.v_jobs, v.v_sources, "AF").select("id", "title", "url", seen)


@register(
    "backfill_candidates_all",
    """
    SELECT DISTINCT j.id, j.title, s.url FROM v_jobs j JOIN v_sources s ON s.job_id = j.id
    WHERE s.source_name = 'AF' AND coalesce(j.raw_text, '') = '' AND j.is_active
    """,
)
def backfill_candidates_all(v):
    return W.backfill_candidates(v.v_jobs, v.v_sources, "AF").select("id", "title", "url")


@register(
    "location_patterns",
    """
    SELECT location_raw, count(*) AS jobs, location_raw GLOB '[0-9][0-9][0-9][0-9][0-9] *' AS plz,
           location_raw ILIKE '%remote%' OR location_raw ILIKE '%home office%' AS remote
    FROM v_jobs WHERE location_raw IS NOT NULL AND location_raw <> '' GROUP BY location_raw
    """,
)
def location_patterns(v):
    filled = W.filled(v.v_jobs, "location_raw").groupBy("location_raw").agg(
        F.count("*").alias("jobs")
    )
    place = F.col("location_raw")
    return filled.select(
        "location_raw", "jobs", place.rlike("^[0-9]{5} ").alias("plz"),
        (place.ilike("%remote%") | place.ilike("%home office%")).alias("remote"),
    )


@register(
    "sector_norm",
    "SELECT sector, count(*) AS jobs, CAST(NULL AS VARCHAR) AS sector_norm FROM v_jobs GROUP BY 1",
)
def sector_norm(v):
    return (
        v.v_jobs.groupBy("sector")
        .agg(F.count("*").alias("jobs"))
        .withColumn("sector_norm", X.sector_norm(F.col("sector")))
    )
