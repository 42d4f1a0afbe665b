"""Registered queries: address cascade and location scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions import location as L
from stellwerk.functions.text import origin_hash
from stellwerk.operators.addresses import imprint_requests, resolve_addresses
from stellwerk.operators.filters import scoring_candidates
from stellwerk.operators.lookups import with_canonical_url
from stellwerk.plans.registry import register
from stellwerk.plans.scoring import batch_view, score_batch, score_jobs, settle
from stellwerk.plans.text_queries import _DAYS, _MODEL
from stellwerk.session import spread

AS_OF = "1998-06-01 00:00:00"

# Settled work model and days per job, as SQL.
_SETTLED = f"""
    WITH settled AS (
      SELECT id, company_id, trim(location_raw) AS place,
             regexp_matches(lower(coalesce(location_raw, '')), 'remote|homeoffice|home office') AS place_remote,
             coalesce(work_model, CASE WHEN raw_text <> '' THEN {_MODEL.format('raw_text')} END) AS model,
             CASE WHEN (work_model IS NULL OR work_model = 'hybrid') AND raw_text <> ''
                  THEN {_DAYS.format('raw_text')} END AS days
      FROM v_jobs)
"""


@register(
    "settled_work_model",
    _SETTLED + "SELECT id, model, days, place_remote OR coalesce(model = 'remote', false) AS is_remote FROM settled",
)
def settled_work_model(v):
    return settle(v.v_jobs).select("id", "model", "days", "is_remote")


def _landed(v):
    """Imprint pages per supplier, web pages per part, geocoder answers per region."""
    number = F.col("s_suppkey").cast("string")
    place = F.concat(F.lpad(number, 5, "0"), F.lit(" Musterstadt"))
    imprint = spread(v.supplier).select(
        F.col("s_suppkey").alias("company_id"), F.lit(0).alias("rank"),
        F.when(
            F.col("s_acctbal") > 0,
            F.concat(F.lit("<p>Ringstraße 5</p><p>"), place, F.lit("</p>")),
        ).otherwise(F.lit("<p>nichts</p>")).alias("payload"),
    )
    search = spread(v.part).select(
        F.col("p_partkey").alias("company_id"), F.lit(0).alias("rank"),
        F.when(
            F.col("p_size") > 40,
            F.concat(F.lit("<p>"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(" Neustadt</p>")),
        ).otherwise(F.lit("<p>nichts</p>")).alias("payload"),
    )
    def answer(query, lat, name):
        hit = F.struct(lat.cast("string").alias("lat"), F.lit("9.25").alias("lon"), name.alias("display_name"))
        return [query.alias("search_key"), F.to_json(F.array(hit)).alias("payload")]

    regions = v.region.select(
        *answer(F.col("r_name"), F.col("r_regionkey") + 50.5,
                F.concat("r_name", F.lit(", Kreis, 6031"), "r_regionkey", F.lit(", Deutschland")))
    )
    imprint_points = v.supplier.select(
        *answer(F.concat(F.lit("Ringstraße 5, "), place), F.col("s_suppkey") + 0.5, F.lit("x"))
    )
    return imprint, search, regions.unionByName(imprint_points)


def _wanted(v):
    return v.v_jobs.select("company_id", F.trim("location_raw").alias("location_raw"))


def _resolved(v):
    imprint, search, geocodes = _landed(v)
    companies = v.v_companies.withColumns(
        {"address_street": F.lit(None).cast("string"), "address_zip": F.lit(None).cast("string")}
    )
    return resolve_addresses(_wanted(v), companies, imprint, search, geocodes)


_ADDRESS = """
    placed AS (
      SELECT DISTINCT j.company_id AS id, c.address_status, c.address_city, c.lat, c.lng
      FROM v_jobs j JOIN v_companies c ON c.id = j.company_id),
    text_points AS (SELECT j.company_id AS id, min(r.r_name) AS r_name,
                           arg_min(r.r_regionkey, r.r_name) AS r_regionkey
                    FROM v_jobs j JOIN region r ON r.r_name = trim(j.location_raw) GROUP BY 1),
    addresses AS (
      SELECT p.id,
        CASE WHEN p.address_status = 'found' THEN 'db' WHEN s.s_acctbal > 0 THEN 'impressum'
             WHEN w.p_size > 40 THEN 'searxng' WHEN t.r_name IS NOT NULL THEN 'nominatim' END AS source,
        CASE WHEN p.address_status = 'found' THEN p.address_city WHEN s.s_acctbal > 0 THEN 'Musterstadt'
             WHEN w.p_size > 40 THEN 'Neustadt' ELSE t.r_name END AS city,
        CASE WHEN p.address_status = 'found' THEN NULL
             WHEN s.s_acctbal > 0 OR w.p_size > 40 THEN lpad(CAST(p.id AS VARCHAR), 5, '0')
             ELSE '6031' || t.r_regionkey END AS zip_code,
        CASE WHEN p.address_status <> 'found' AND s.s_acctbal > 0 THEN 'Ringstraße 5' END AS street,
        CASE WHEN p.address_status = 'found' THEN p.lat WHEN s.s_acctbal > 0 THEN p.id + 0.5
             WHEN w.p_size > 40 THEN NULL ELSE t.r_regionkey + 50.5 END::DOUBLE AS lat,
        CASE WHEN p.address_status = 'found' THEN p.lng WHEN s.s_acctbal > 0 THEN 9.25
             WHEN w.p_size > 40 THEN NULL WHEN t.r_name IS NOT NULL THEN 9.25 END::DOUBLE AS lng
      FROM placed p LEFT JOIN supplier s ON s.s_suppkey = p.id LEFT JOIN part w ON w.p_partkey = p.id
           LEFT JOIN text_points t ON t.id = p.id)
"""


@register(
    "resolve_addresses",
    f"WITH {_ADDRESS} SELECT id, source, city, zip_code, street, lat, lng FROM addresses",
)
def resolved_addresses(v):
    a = F.col("address")
    return _resolved(v).select(
        "id", *[a[name].alias(name) for name in ("source", "city", "zip_code", "street", "lat", "lng")]
    )


@register(
    "imprint_requests",
    """
    SELECT DISTINCT j.company_id, 'https://jobs.example' || p.path AS url, p.rank
    FROM v_jobs j JOIN v_sources s ON s.job_id = j.id AND s.is_canonical,
         (VALUES ('/impressum', 0), ('/imprint', 1), ('/about/impressum', 2)) p(path, rank)
    """,
)
def imprint_pages_to_land(v):
    return imprint_requests(with_canonical_url(v.v_jobs, v.v_sources)).select("company_id", "url", "rank")


def _minutes(v):
    """Cache from early orders, journeys and routes per customer, as the scoring expects them."""
    stamp = F.col("o_orderdate").cast("timestamp")
    home = origin_hash(F.lit(K.HOME_ADDRESS))
    cache = v.orders.where(F.col("o_orderpriority") == "2-HIGH").groupBy(
        F.col("o_custkey").alias("company_id")
    ).agg(
        (F.floor(F.max("o_totalprice") / 10000)).cast("int").alias("transit_minutes"),
        (F.max(stamp) + F.make_dt_interval(days=F.lit(90))).alias("expires_at"),
    ).withColumn("origin_hash", home)
    customers = v.customer.select(F.col("c_custkey").alias("company_id"), "c_acctbal", "c_nationkey")
    transit = customers.select(
        "company_id",
        F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") / 100).cast("int")).alias("primary_minutes"),
        F.when(F.col("c_acctbal") > 2000, F.floor(F.col("c_acctbal") / 90).cast("int")).alias("fallback_minutes"),
    )
    routes = customers.select(
        "company_id", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") * 3).alias("car_minutes")
    )
    return cache, transit, routes


_TIMED = f"""
    cache AS (SELECT o_custkey AS company_id, CAST(floor(max(o_totalprice) / 10000) AS INT) AS minutes
              FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1
              HAVING max(o_orderdate) + INTERVAL 90 DAY > TIMESTAMP '{AS_OF}'),
    timed AS (
      SELECT s.*, coalesce(a.lat, 0) <> 0 AND coalesce(a.lng, 0) <> 0 AS pointed,
             c.minutes AS cached,
             coalesce(CASE WHEN k.c_acctbal > 5000 THEN CAST(floor(k.c_acctbal / 100) AS INT) END,
                      CASE WHEN k.c_acctbal > 2000 THEN CAST(floor(k.c_acctbal / 90) AS INT) END) AS landed,
             CASE WHEN k.c_nationkey > 5 THEN k.c_nationkey * 3 END AS route
      FROM settled s JOIN addresses a ON a.id = s.company_id JOIN customer k ON k.c_custkey = s.company_id
           LEFT JOIN cache c ON c.company_id = s.company_id
      WHERE NOT (place_remote OR coalesce(model = 'remote', false))),
    mins AS (SELECT *, CASE WHEN pointed THEN coalesce(cached, landed) END AS pub,
                    CASE WHEN pointed THEN route END AS car FROM timed),
    weighted AS (SELECT *, least(pub, car) AS shortest,
                   CASE WHEN model = 'hybrid' AND days <= 1 THEN 0.2 WHEN model = 'hybrid' AND days > 3 THEN 0.8
                        WHEN model = 'hybrid' THEN 0.5 WHEN model = 'onsite' THEN 1.0 ELSE 0.6 END::DOUBLE AS w
                 FROM mins),
    eff AS (SELECT *, CAST(trunc(shortest * w) AS INT) AS e FROM weighted)
"""


@register(
    "score_jobs",
    f"""
    {_SETTLED}, {_ADDRESS}, {_TIMED}
    SELECT id AS job_id,
           CASE WHEN shortest IS NULL THEN 0.5
                WHEN e <= 60 THEN round(1.0::DOUBLE - (e / 60) * 0.3::DOUBLE, 3)
                ELSE round(greatest(0.0::DOUBLE, 0.7::DOUBLE - (e - 60) / 60 * 0.5::DOUBLE), 3) END::DOUBLE AS score,
           coalesce(e, 0) AS effective_minutes, pub AS transit_public, car AS transit_car,
           coalesce(model, 'unknown') AS work_model, false AS is_remote
    FROM eff
    UNION ALL
    SELECT id, 1.0, 0, NULL, NULL, 'remote', true FROM settled
    WHERE place_remote OR coalesce(model = 'remote', false)
    """,
)
def score_all_jobs(v):
    cache, transit, routes = _minutes(v)
    scored = score_jobs(v.v_jobs, _resolved(v), cache, transit, routes, F.lit(AS_OF).cast("timestamp"))
    return batch_view(scored.scores)


@register(
    "fresh_transit_minutes",
    f"""
    {_SETTLED}, {_ADDRESS}, {_TIMED}
    SELECT DISTINCT company_id, landed AS transit_minutes,
           CASE WHEN k.c_acctbal > 5000 THEN 'db_rest' ELSE 'transport_rest' END AS api_used
    FROM timed JOIN customer k ON k.c_custkey = company_id
    WHERE pointed AND cached IS NULL AND landed IS NOT NULL
    """,
)
def fresh_transit_minutes(v):
    cache, transit, routes = _minutes(v)
    scored = score_jobs(v.v_jobs, _resolved(v), cache, transit, routes, F.lit(AS_OF).cast("timestamp"))
    return scored.fresh_minutes.select("company_id", "transit_minutes", "api_used")


@register(
    "missing_lookups",
    f"""
    {_SETTLED}, {_ADDRESS}, {_TIMED}
    SELECT company_id, bool_or(pub IS NULL) AS needs_transit, bool_or(car IS NULL) AS needs_route,
           '1998-06-02 08:00:00' AS departure
    FROM mins WHERE pointed AND (pub IS NULL OR car IS NULL) GROUP BY company_id
    """,
)
def missing_lookups(v):
    cache, transit, routes = _minutes(v)
    scored = score_jobs(v.v_jobs, _resolved(v), cache, transit, routes, F.lit(AS_OF).cast("timestamp"))
    return scored.missing_lookups.select(
        "company_id", "needs_transit", "needs_route",
        F.date_format("departure", "yyyy-MM-dd HH:mm:ss").alias("departure"),
    )


@register(
    "location_run",
    f"""
    {_SETTLED}, {_ADDRESS}, {_TIMED},
    fresh AS (
      SELECT id, CASE WHEN coalesce(pub, 0) = 0 AND coalesce(car, 0) = 0 THEN 'failed' ELSE 'resolved' END AS status FROM mins
      UNION ALL SELECT id, 'resolved' FROM settled WHERE place_remote OR coalesce(model = 'remote', false)),
    chosen AS (SELECT id FROM v_jobs WHERE location_status = 'unknown' AND is_active
               AND status NOT IN ('expired', 'ignored'))
    SELECT j.id, coalesce(f.status, j.location_status) AS location_status,
           CASE WHEN f.id IS NOT NULL THEN '{AS_OF}' END AS updated
    FROM v_jobs j LEFT JOIN (SELECT * FROM fresh SEMI JOIN chosen USING (id)) f ON f.id = j.id
    """,
)
def location_run(v):
    """Candidates, scores, status written."""
    cache, transit, routes = _minutes(v)
    _, jobs = score_batch(v.v_jobs, _resolved(v), cache, transit, routes, F.lit(AS_OF).cast("timestamp"))
    return jobs.select(
        "id", "location_status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")
    )


@register(
    "scoring_batch",
    f"""
    {_SETTLED} SELECT id, coalesce(model, 'unknown') AS model FROM settled
    WHERE id IN (SELECT id FROM v_jobs WHERE location_status = 'unknown' AND is_active
                 AND status NOT IN ('expired', 'ignored'))
    """,
)
def scoring_batch(v):
    chosen = scoring_candidates(v.v_jobs)
    model = L.effective_work_model(F.col("work_model"), F.col("raw_text"))
    return chosen.select("id", F.coalesce(model, F.lit("unknown")).alias("model"))
