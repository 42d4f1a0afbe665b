"""Registered queries: identity stages, table upkeep, lookups and run statistics.

The postings before a fixed day play the stored state, the later ones the batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk.functions.text import canonical_id, normalize_text
from stellwerk.operators import identity as I
from stellwerk.operators import lookups as J
from stellwerk.operators import maintenance as M
from stellwerk.operators import runs as R
from stellwerk.operators.similar_titles import similar_within
from stellwerk.plans.registry import register
from stellwerk.plans.text_queries import AS_OF, sql_canonical_id, sql_normalize
from stellwerk.session import cut_lineage

DAY = "2024-01-16 00:00:00"
_TS = "yyyy-MM-dd HH:mm:ss"

def _run_at():
    """When the registered upkeep runs; shown as text, as all times here."""
    return F.lit(AS_OF).cast("timestamp")


def _shown(name: str, alias: str):
    return F.date_format(name, _TS).alias(alias)


_STATE = f"""
    WITH p AS (SELECT *, {sql_canonical_id('title', 'company_name', 'location_raw')} AS canonical_id,
                      {sql_normalize('company_name')} AS company_key,
                      {sql_normalize('title')} AS title_norm FROM v_postings),
    stored AS (SELECT * FROM p WHERE published_at < TIMESTAMP '{DAY}'),
    batch AS (SELECT * FROM p WHERE published_at >= TIMESTAMP '{DAY}'),
    jobs AS (SELECT seq AS id, canonical_id, title, company_key, raw_text, location_raw, published_at AS seen
             FROM stored QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY seq) = 1),
    links AS (SELECT s.seq AS id, j.id AS job_id, s.url, s.source_name, s.source_job_id,
                     s.published_at AS seen
              FROM stored s JOIN jobs j USING (canonical_id)
              QUALIFY row_number() OVER (PARTITION BY s.url ORDER BY s.seq) = 1),
    companies AS (SELECT min(seq) AS id, company_key AS name_normalized FROM stored GROUP BY 2),
    placed AS (SELECT b.*, CASE WHEN j.id IS NULL AND row_number() OVER
                                (PARTITION BY b.canonical_id ORDER BY b.seq) = 1
                                THEN 'new' ELSE 'canonical_id' END AS label
               FROM batch b LEFT JOIN jobs j USING (canonical_id))
"""


def _split(v):
    # Several tables are derived from these rows: they are normalised and hashed once.
    rows = cut_lineage(v.v_postings.withColumns(
        {
            "canonical_id": canonical_id(
                F.col("title"), F.col("company_name"), F.col("location_raw")
            ),
            "company_key": normalize_text(F.col("company_name")),
        }
    ))
    early = F.col("published_at") < F.lit(DAY).cast("timestamp_ntz")
    return rows.where(early), rows.where(~early)


def _first_by(rows, key):
    first = rows.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("first")
    )
    return first.select(key, "first.*")


def _state(v):
    """Stored jobs, links and companies, and the batch."""
    stored, batch = _split(v)
    first = _first_by(stored, "canonical_id")
    companies = stored.groupBy(F.col("company_key").alias("name_normalized")).agg(
        F.min("seq").alias("id"), F.min_by("company_name", "seq").alias("name")
    )
    owners = companies.select(F.col("id").alias("company_id"), F.col("name_normalized").alias("company_key"))
    seen = F.col("published_at").cast("timestamp")
    jobs = first.join(owners, "company_key").select(
        F.col("seq").alias("id"), "canonical_id", "title", "company_id", "location_raw", "raw_text",
        seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit(True).alias("is_active"),
        F.lit("new").alias("status"), F.lit("unknown").alias("location_status"),
        F.lit(None).cast("string").alias("work_model"), F.lit(None).cast("string").alias("salary_raw"),
        F.lit(None).cast("timestamp").alias("deadline"), F.lit(None).cast("string").alias("sector"),
    )
    links = _first_by(stored, "url").join(
        jobs.select(F.col("id").alias("job_id"), "canonical_id"), "canonical_id"
    ).select(
        F.col("seq").alias("id"), "job_id", "url", "source_name", "source_type", "source_job_id",
        F.lit(False).alias("is_canonical"), seen.alias("first_seen_at"), seen.alias("last_seen_at"),
    )
    return jobs, links, companies, batch


def _placed(jobs, batch):
    """Batch labelled by canonical id alone, the part SQL can follow."""
    first = batch.groupBy("canonical_id").agg(F.min("seq").alias("first_seq"))
    known = jobs.select("canonical_id", F.lit(True).alias("known"))
    is_new = F.col("known").isNull() & (F.col("seq") == F.col("first_seq"))
    empty = {
        "work_model": "string", "salary_raw": "string", "deadline": "timestamp", "sector": "string",
    }
    return (
        batch.join(first, "canonical_id").join(known, "canonical_id", "left")
        .withColumn("label", F.when(is_new, I.NEW).otherwise(I.BY_HASH))
        .withColumn("job_key", F.col("canonical_id"))
        .withColumnRenamed("title", "raw_title")
        .withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
    )


def _seen():
    return F.col("published_at").cast("timestamp")


@register(
    "company_upsert",
    _STATE + f"""
    , fresh AS (SELECT company_key, min(seq) AS seq FROM batch
                WHERE company_key NOT IN (SELECT name_normalized FROM companies) GROUP BY 1)
    SELECT id, name_normalized, CAST(NULL AS VARCHAR) AS created, CAST(NULL AS VARCHAR) AS updated FROM companies
    UNION ALL
    SELECT (SELECT max(id) FROM companies) + row_number() OVER (ORDER BY seq), company_key, '{AS_OF}', '{AS_OF}' FROM fresh
    """,
)
def company_upsert(v):
    _, _, companies, batch = _state(v)
    return M.upsert_companies(batch, companies, _run_at()).select(
        "id", "name_normalized", _shown("created_at", "created"), _shown("updated_at", "updated")
    )


@register(
    "stage_source_id",
    _STATE + """
    , ids AS (SELECT l.source_name, l.source_job_id, j.canonical_id AS job_key
              FROM links l JOIN jobs j ON j.id = l.job_id WHERE l.source_job_id <> ''
              QUALIFY row_number() OVER (PARTITION BY l.source_name, l.source_job_id ORDER BY l.id) = 1)
    SELECT b.seq, i.job_key AS stored_job FROM batch b LEFT JOIN ids i
      ON i.source_name = b.source_name AND i.source_job_id = b.source_job_id
    """,
)
def stage_source_id(v):
    jobs, links, companies, batch = _state(v)
    known = I.known_from_tables(jobs, links, companies)
    return I.match_source_ids(I.posting_keys(batch), known).select("seq", "stored_job")


@register(
    "stage_canonical_id",
    _STATE + """
    SELECT seq, canonical_id IN (SELECT canonical_id FROM jobs) AS stored_hash,
           url IN (SELECT url FROM links) AS stored_url FROM batch
    """,
)
def stage_canonical_id(v):
    jobs, links, companies, batch = _state(v)
    known = I.known_from_tables(jobs, links, companies)
    keys = I.match_urls(I.match_hashes(I.posting_keys(batch), known), known)
    return keys.select("seq", "stored_hash", "stored_url")


# Ratcliff-Obershelp in SQL: longest common run first, then left and right of it.
# Ratios of the texts in ``pairs`` (a, b).
RATIOS_OF_PAIRS = """
    , cells AS (SELECT a, b, i, j FROM pairs, range(1, 200) x(i), range(1, 200) y(j)
              WHERE i <= length(a) AND j <= length(b) AND substr(a, i, 1) = substr(b, j, 1)),
    runs AS (SELECT a, b, i, j,
                    count(*) OVER (PARTITION BY a, b, i - j, island ORDER BY i DESC) AS len
             FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island
                   FROM cells)),
    blocks AS (
      SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS k FROM pairs
      UNION ALL
      SELECT a, b, part.alo, part.ahi, part.blo, part.bhi, part.k FROM (
        SELECT a, b, unnest([
          {'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j, 'k': m.k},
          {'alo': m.i + m.k, 'ahi': ahi, 'blo': m.j + m.k, 'bhi': bhi, 'k': 0}]) AS part
        FROM (
          SELECT s.a, s.b, s.alo, s.ahi, s.blo, s.bhi,
                 min({'order': -least(r.len, s.ahi - r.i, s.bhi - r.j), 'i': r.i, 'j': r.j,
                      'k': least(r.len, s.ahi - r.i, s.bhi - r.j)}) AS m
          FROM blocks s JOIN runs r ON r.a = s.a AND r.b = s.b
               AND r.i >= s.alo AND r.i < s.ahi AND r.j >= s.blo AND r.j < s.bhi
          GROUP BY ALL)) 
    ),
    ratios AS (SELECT a, b, 2.0::DOUBLE * sum(k) / (length(a) + length(b)) AS ratio
               FROM blocks GROUP BY a, b)
"""
_RATIOS = """
    , titles AS (SELECT DISTINCT title_norm AS t FROM p),
    pairs AS (SELECT a.t AS a, b.t AS b FROM titles a, titles b WHERE a.t <> b.t)
""" + RATIOS_OF_PAIRS

# The cascade row by row: each step sees what the steps before it accepted, linked and registered.
_WALK = """
    , alike AS (SELECT a, b FROM ratios WHERE ratio >= 0.85 UNION ALL SELECT t, t FROM titles),
    known_titles AS (SELECT DISTINCT company_key, {title_norm} AS known FROM jobs),
    known_ids AS (SELECT l.source_name, l.source_job_id, arg_min(j.canonical_id, l.id) AS stored_job
                  FROM links l JOIN jobs j ON j.id = l.job_id WHERE coalesce(l.source_job_id, '') <> '' GROUP BY 1, 2),
    numbered AS (
      SELECT *, row_number() OVER (ORDER BY seq)::INT AS n, dense_rank() OVER (ORDER BY canonical_id)::INT AS h,
             dense_rank() OVER (ORDER BY url)::INT AS u, dense_rank() OVER (ORDER BY company_key, title_norm)::INT AS t,
             CASE WHEN coalesce(source_job_id, '') <> ''
                  THEN dense_rank() OVER (ORDER BY source_name, source_job_id)::INT END AS k
      FROM batch),
    title_ids AS (SELECT DISTINCT company_key, title_norm, t FROM numbered),
    near AS (SELECT x.t, list(y.t) AS near FROM title_ids x JOIN title_ids y USING (company_key)
             JOIN alike ON a = x.title_norm AND b = y.title_norm GROUP BY x.t),
    known_near AS (SELECT DISTINCT x.t, true AS stored_title FROM title_ids x JOIN known_titles USING (company_key)
                   JOIN alike ON a = x.title_norm AND b = known),
    steps AS MATERIALIZED (
      SELECT n, seq, source_name, canonical_id, h, u, k, t, near, stored_job, j.canonical_id IS NOT NULL AS stored_hash,
             l.url IS NOT NULL AS stored_url, coalesce(stored_title, false) AS stored_title
      FROM numbered LEFT JOIN near USING (t) LEFT JOIN known_near USING (t)
      LEFT JOIN known_ids USING (source_name, source_job_id)
      LEFT JOIN (SELECT DISTINCT canonical_id FROM jobs) j USING (canonical_id)
      LEFT JOIN (SELECT DISTINCT url FROM links) l USING (url)),
    walk(n, label, brings, hashes, titles, urls, ids) AS (
      SELECT 0, NULL::VARCHAR, false, []::INT[], []::INT[], []::INT[], []::INT[]
      UNION ALL
      SELECT n, label, brings, CASE WHEN label = 'new' THEN list_append(hashes, h) ELSE hashes END,
             CASE WHEN label = 'new' THEN list_append(titles, t) ELSE titles END,
             CASE WHEN linked THEN list_append(urls, u) ELSE urls END, CASE WHEN brings THEN list_append(ids, k) ELSE ids END
      FROM (SELECT *, linked AND k IS NOT NULL AND NOT stored_url AS brings FROM (
        SELECT *, label <> 'similar_title' AND NOT list_contains(urls, u) AS linked FROM (
          SELECT s.*, w.hashes, w.titles, w.urls, w.ids,
                 CASE WHEN stored_job IS NOT NULL OR coalesce(list_contains(w.ids, k), false) THEN 'source_id'
                      WHEN stored_hash OR list_contains(w.hashes, h) THEN 'canonical_id'
                      WHEN stored_title OR list_has_any(w.titles, near) THEN 'similar_title' ELSE 'new' END AS label
          FROM walk w JOIN steps s ON s.n = w.n + 1)))),
    brought AS (SELECT k, arg_min(canonical_id, n) AS job FROM walk JOIN steps USING (n) WHERE brings GROUP BY k),
    decided AS (
      SELECT seq, source_name, label, CASE label WHEN 'source_id' THEN coalesce(stored_job, job) WHEN 'similar_title' THEN NULL
                                                 ELSE canonical_id END AS job_key
      FROM walk JOIN steps USING (n) LEFT JOIN brought USING (k))
"""
_CASCADE = _STATE.replace("WITH p", "WITH RECURSIVE p") + _RATIOS + _WALK.format(title_norm=sql_normalize("title"))
# The same with nothing stored.
FIRST_RUN = _CASCADE.replace(f"published_at < TIMESTAMP '{DAY}'", "false").replace(f"published_at >= TIMESTAMP '{DAY}'", "true")


@register(
    "similar_titles",
    _STATE.replace("WITH p", "WITH RECURSIVE p") + _RATIOS + """
    , per_company AS (SELECT company_key, title_norm AS t, min(seq) AS lo, max(seq) AS hi
                    FROM p GROUP BY 1, 2)
    SELECT x.company_key, x.t AS title, y.t AS earlier_title
    FROM per_company x JOIN per_company y ON x.company_key = y.company_key AND x.hi > y.lo
    JOIN ratios r ON r.a = x.t AND r.b = y.t WHERE r.ratio >= 0.85
    """,
)
def similar_titles(v):
    keys = I.posting_keys(v.v_postings)
    titles = keys.groupBy("company_key", "title").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    return similar_within(titles)


@register("stage_similar_title", _CASCADE + "SELECT seq, stored_title FROM steps")
def stage_similar_title(v):
    jobs, links, companies, batch = _state(v)
    known = I.known_from_tables(jobs, links, companies)
    keys = I.match_titles(I.posting_keys(batch), known, 0.85)
    return keys.select("seq", "stored_title")


@register("resolve_postings", _CASCADE + "SELECT seq, label, job_key FROM decided")
def resolve_postings(v):
    jobs, links, companies, batch = _state(v)
    known = I.known_from_tables(jobs, links, companies)
    labelled = I.label_postings(I.posting_keys(batch), known)
    return labelled.select("seq", "label", "job_key")


@register(
    "ingest_run_stats",
    FIRST_RUN + """
    SELECT source_name, count(*) AS fetched, count(*) FILTER (label = 'new') AS new, count(*) FILTER (label <> 'new') AS duplicate,
           0 AS skipped, 0 AS errors
    FROM decided GROUP BY source_name
    """,
)
def ingest_run_stats(v):
    """All postings against empty tables, counted per source."""
    keys = I.posting_keys(v.v_postings)
    jobs, links, companies, _ = _state(v)
    nothing = I.known_from_tables(jobs.limit(0), links.limit(0), companies.limit(0))
    labelled = I.label_postings(keys, nothing)
    outcomes = labelled.select("seq", I.outcome(F.col("label")).alias("outcome")).join(
        v.v_postings.select("seq", "source_name"), "seq"
    )
    return R.run_stats(outcomes, "source_name")


@register(
    "next_jobs",
    _STATE + """
    , hits AS (SELECT * FROM placed WHERE label <> 'new'),
    base AS (SELECT canonical_id, title, raw_text, seen, CAST(NULL AS TIMESTAMP) AS made FROM jobs
             UNION ALL SELECT canonical_id, title, raw_text, published_at, published_at FROM placed WHERE label = 'new'),
    touch AS (SELECT canonical_id, max(published_at) AS seen FROM hits GROUP BY 1),
    txt AS (SELECT canonical_id, raw_text FROM hits WHERE raw_text <> ''
            QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY seq) = 1)
    SELECT b.canonical_id, b.title, coalesce(nullif(b.raw_text, ''), t.raw_text, b.raw_text) AS raw_text,
           strftime(coalesce(h.seen, b.seen), '%Y-%m-%d %H:%M:%S') AS last_seen,
           strftime(b.made, '%Y-%m-%d %H:%M:%S') AS created,
           strftime(coalesce(h.seen, b.made), '%Y-%m-%d %H:%M:%S') AS updated
    FROM base b LEFT JOIN touch h USING (canonical_id) LEFT JOIN txt t USING (canonical_id)
    """,
)
def next_jobs(v):
    jobs, _, companies, batch = _state(v)
    placed = _placed(jobs, batch)
    after = M.next_jobs(placed, jobs, companies, _seen())
    return after.select(
        "canonical_id", "title", "raw_text", _shown("last_seen_at", "last_seen"),
        _shown("created_at", "created"), _shown("updated_at", "updated"),
    )


@register(
    "next_sources",
    _STATE + """
    , fresh AS (SELECT url, source_name, source_job_id, canonical_id, published_at AS seen FROM placed
                QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
    latest AS (SELECT url, max(published_at) AS seen FROM placed GROUP BY url)
    SELECT l.url, l.source_name, l.source_job_id, j.canonical_id,
           strftime(l.seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
           strftime(coalesce(t.seen, l.seen), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM links l JOIN jobs j ON j.id = l.job_id LEFT JOIN latest t USING (url)
    UNION ALL
    SELECT f.url, f.source_name, f.source_job_id, f.canonical_id,
           strftime(f.seen, '%Y-%m-%d %H:%M:%S'), strftime(t.seen, '%Y-%m-%d %H:%M:%S')
    FROM fresh f JOIN latest t USING (url) WHERE f.url NOT IN (SELECT url FROM links)
    """,
)
def next_sources(v):
    jobs, links, companies, batch = _state(v)
    placed = _placed(jobs, batch)
    after = M.next_jobs(placed, jobs, companies, _seen())
    owners = after.select(F.col("id").alias("job_id"), "canonical_id")
    return (
        M.next_sources(placed, links, after, _seen())
        .join(owners, "job_id")
        .select(
            "url", "source_name", "source_job_id", "canonical_id",
            F.date_format("first_seen_at", _TS).alias("first_seen"),
            F.date_format("last_seen_at", _TS).alias("last_seen"),
        )
    )


@register(
    "expire_jobs",
    f"""
    SELECT id,
           CASE WHEN gone THEN 'expired' ELSE status END AS status,
           is_active AND NOT gone AS is_active, gone AS expired_now,
           CASE WHEN gone THEN '{AS_OF}' END AS updated
    FROM (SELECT *, coalesce(deadline < TIMESTAMP '{AS_OF}' AND is_active
                    AND status NOT IN ('applying', 'applied', 'interview', 'offer'), false) AS gone
          FROM v_jobs)
    """,
)
def expire_jobs(v):
    after = M.expire(v.v_jobs, _run_at())
    return after.select("id", "status", "is_active", "expired_now", _shown("updated_at", "updated"))


@register(
    "cache_upsert",
    f"""
    WITH old AS (SELECT o_custkey AS company_id, o_orderpriority AS origin_hash,
                        CAST(floor(max(o_totalprice) / 10000) AS INT) AS minutes, max(o_orderdate) AS stamp
                 FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2),
    new AS (SELECT o_custkey AS company_id, o_orderpriority AS origin_hash,
                   CAST(floor(min(o_totalprice) / 10000) AS INT) AS minutes
            FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2),
    joined AS (SELECT * FROM old ANTI JOIN new USING (company_id, origin_hash))
    SELECT company_id, origin_hash, minutes AS transit_minutes,
           strftime(stamp + INTERVAL 90 DAY, '%Y-%m-%d %H:%M:%S') AS expires,
           stamp + INTERVAL 90 DAY > TIMESTAMP '{AS_OF}' AS valid FROM joined
    UNION ALL
    SELECT company_id, origin_hash, minutes,
           strftime(TIMESTAMP '{AS_OF}' + INTERVAL 90 DAY, '%Y-%m-%d %H:%M:%S'), true FROM new
    """,
)
def cache_upsert(v):
    as_of = F.lit(AS_OF).cast("timestamp")
    split = F.lit("1998-01-01").cast("timestamp")
    stamp = F.col("o_orderdate").cast("timestamp")
    keys = [F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("origin_hash")]
    old = v.orders.where(stamp < split).groupBy(*keys).agg(
        F.floor(F.max("o_totalprice") / 10000).cast("int").alias("transit_minutes"),
        F.lit("db_rest").alias("api_used"),
        F.max(stamp).alias("cached_at"),
        (F.max(stamp) + F.make_dt_interval(days=F.lit(90))).alias("expires_at"),
    )
    new = v.orders.where(stamp >= split).groupBy(*keys).agg(
        F.floor(F.min("o_totalprice") / 10000).cast("int").alias("transit_minutes"),
        F.lit("db_rest").alias("api_used"),
    )
    return M.upsert_cache(old, new, as_of).select(
        "company_id", "origin_hash", "transit_minutes",
        F.date_format("expires_at", _TS).alias("expires"),
        (F.col("expires_at") > as_of).alias("valid"),
    )


@register(
    "cached_minutes",
    f"""
    SELECT j.id, c.minutes AS cached_minutes FROM v_jobs j LEFT JOIN (
      SELECT o_custkey, CAST(floor(max(o_totalprice) / 10000) AS INT) AS minutes,
             max(o_orderdate) + INTERVAL 90 DAY AS expires
      FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1) c
    ON c.o_custkey = j.company_id AND c.expires > TIMESTAMP '{AS_OF}'
    """,
)
def cached_minutes(v):
    stamp = F.col("o_orderdate").cast("timestamp")
    cache = v.orders.groupBy(
        F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("origin_hash")
    ).agg(
        F.floor(F.max("o_totalprice") / 10000).cast("int").alias("transit_minutes"),
        (F.max(stamp) + F.make_dt_interval(days=F.lit(90))).alias("expires_at"),
    )
    as_of = F.lit(AS_OF).cast("timestamp")
    return J.with_cached_minutes(v.v_jobs, cache, "2-HIGH", as_of).select("id", "cached_minutes")


@register(
    "address_update",
    f"""
    SELECT c.id, CASE WHEN s.s_suppkey IS NULL THEN c.address_status
                      WHEN s.s_acctbal > 0 THEN 'found' ELSE 'failed' END AS address_status,
           CASE WHEN s.s_acctbal > 0 THEN s.s_name ELSE c.address_city END AS address_city,
           CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal ELSE c.lat END AS lat,
           CASE WHEN s.s_suppkey IS NOT NULL THEN '{AS_OF}' END AS updated
    FROM v_companies c LEFT JOIN supplier s ON s.s_suppkey = c.id
    """,
)
def address_update(v):
    address = F.when(
        F.col("s_acctbal") > 0,
        F.struct(
            F.lit(None).cast("string").alias("street"), F.col("s_name").alias("city"),
            F.lit(None).cast("string").alias("zip_code"), F.col("s_acctbal").alias("lat"),
            F.lit(0.5).alias("lng"), F.lit("impressum").alias("source"),
        ),
    )
    resolved = v.supplier.select(F.col("s_suppkey").alias("id"), address.alias("address"))
    after = M.update_addresses(v.v_companies, resolved, _run_at())
    return after.select("id", "address_status", "address_city", "lat", _shown("updated_at", "updated"))


@register(
    "location_status_update",
    f"""
    SELECT j.id, CASE WHEN c.lo IS NULL THEN j.location_status
                      WHEN c.lo > 0 THEN 'resolved' ELSE 'failed' END AS location_status,
           CASE WHEN c.lo IS NOT NULL THEN '{AS_OF}' END AS updated
    FROM v_jobs j LEFT JOIN (SELECT order_id, max(coalesce(car, 0)) AS lo FROM v_commute GROUP BY 1) c
    ON c.order_id = j.id
    """,
)
def location_status_update(v):
    scored = v.v_commute.groupBy(F.col("order_id").alias("id")).agg(
        F.max(F.coalesce("car", F.lit(0))).alias("most")
    )
    status = F.when(F.col("most") > 0, "resolved").otherwise("failed")
    after = M.update_location_status(v.v_jobs, scored.select("id", status.alias("status")), _run_at())
    return after.select("id", "location_status", _shown("updated_at", "updated"))


@register(
    "fill_texts",
    f"""
    SELECT j.id, coalesce(nullif(j.raw_text, ''), p.html, j.raw_text) AS raw_text,
           CASE WHEN coalesce(j.raw_text, '') = '' AND p.html <> '' THEN '{AS_OF}' END AS updated
    FROM v_jobs j LEFT JOIN pages p ON p.page_id = j.id
    """,
)
def fill_texts(v):
    texts = v.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return M.fill_texts(v.v_jobs, texts, _run_at()).select("id", "raw_text", _shown("updated_at", "updated"))


@register(
    "run_stats",
    """
    SELECT event_type AS source_name, count(*) AS fetched,
           count(*) FILTER (WHERE value < 10) AS new,
           count(*) FILTER (WHERE value >= 10 AND value < 50) AS duplicate,
           count(*) FILTER (WHERE value >= 50 AND value < 60) AS skipped,
           count(*) FILTER (WHERE value >= 60) AS errors,
           CASE WHEN count(*) FILTER (WHERE value >= 60) > 0
                 AND count(*) FILTER (WHERE value < 10) = 0 THEN 'failed' ELSE 'finished' END AS status
    FROM events GROUP BY 1
    """,
)
def run_stats(v):
    value = F.col("value")
    result = (
        F.when(value < 10, "new").when(value < 50, "duplicate").when(value < 60, "skipped")
        .otherwise("error")
    )
    outcomes = v.events.select(F.col("event_type").alias("source_name"), result.alias("outcome"))
    stats = R.run_stats(outcomes, "source_name")
    return stats.withColumn("status", R.run_status(F.col("errors"), F.col("new")))


@register(
    "run_log_row",
    """
    SELECT 7 AS id, 'finished' AS status, count(*) AS fetched,
           count(*) FILTER (WHERE value < 10) AS new, count(DISTINCT event_type) AS sources,
           3 AS expired
    FROM events
    """,
)
def run_log_row(v):
    outcomes = v.events.select(
        F.col("event_type").alias("source_name"),
        F.when(F.col("value") < 10, "new").otherwise("duplicate").alias("outcome"),
    )
    stamp = F.lit(AS_OF).cast("timestamp")
    row = R.run_row(R.run_stats(outcomes, "source_name"), 7, stamp, stamp, 3, [])
    return row.select(
        "id", "status", "stats.fetched", "stats.new", F.size("sources_run").alias("sources"),
        "stats.expired",
    )


@register(
    "known_ids_skipped",
    _STATE + """
    SELECT b.seq FROM batch b WHERE NOT EXISTS (
      SELECT 1 FROM links l WHERE l.source_job_id <> '' AND l.source_name = b.source_name
         AND l.source_job_id = b.source_job_id)
    """,
)
def known_ids_skipped(v):
    _, links, _, batch = _state(v)
    return J.without_known_ids(batch, links).select("seq")


@register(
    "known_source_ids",
    "SELECT DISTINCT source_job_id FROM v_sources WHERE source_name = 'AF' AND source_job_id IS NOT NULL",
)
def known_source_ids(v):
    return J.known_source_ids(v.v_sources, "AF")


@register(
    "known_urls",
    _STATE + "SELECT seq FROM batch WHERE url IN (SELECT url FROM links)",
)
def known_urls(v):
    _, links, _, batch = _state(v)
    return J.with_known_url(batch, links).select("seq")


@register(
    "job_company",
    """
    SELECT j.id, coalesce(s.s_name, 'Unknown') AS company_name
    FROM v_jobs j LEFT JOIN supplier s ON s.s_suppkey = j.company_id
    """,
)
def job_company(v):
    companies = v.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return J.with_company(v.v_jobs, companies).select("id", "company_name")


@register(
    "job_canonical_url",
    """
    SELECT j.id, u.url AS source_url FROM v_jobs j LEFT JOIN (
      SELECT job_id, min(url) AS url FROM v_sources WHERE is_canonical GROUP BY 1) u ON u.job_id = j.id
    """,
)
def job_canonical_url(v):
    return J.with_canonical_url(v.v_jobs, v.v_sources).select("id", "source_url")


@register(
    "detail_texts",
    """
    SELECT p.seq, coalesce(nullif(c.detail, ''), p.raw_text) AS raw_text
    FROM v_postings p LEFT JOIN (
      SELECT 'https://jobs.example/view/' || conv_id || '/' || turn AS url, max(text) AS detail
      FROM conversations WHERE text <> '' GROUP BY 1) c USING (url)
    """,
)
def detail_texts(v):
    details = v.conversations.select(
        F.concat(F.lit("https://jobs.example/view/"), "conv_id", F.lit("/"), "turn").alias("url"),
        F.col("text").alias("detail_text"),
    )
    return J.with_details(v.v_postings, details, "url").select("seq", "raw_text")


@register(
    "orphan_sources",
    "SELECT url FROM v_sources WHERE job_id NOT IN (SELECT id FROM v_jobs WHERE is_active)",
)
def orphan_sources(v):
    return J.orphans(v.v_sources, "job_id", v.v_jobs.where("is_active")).select("url")
