"""Posting-shaped views over the generated tables.

The generated tables hold no postings.  Each view below is plain SQL that both
Spark and the checking engine accept; ``{name}`` stands for an input table or
another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stellwerk.session import configure, spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Tables that grow with the data; the generated ones come as a single split each.
FACTS = ["orders", "lineitem", "events", "documents", "pages"]

VIEWS = {
    # jobs: one per order; text from the document of the same number, where there is one
    "v_jobs": """
        SELECT o.o_orderkey AS id,
               o.o_custkey AS company_id,
               c.c_mktsegment || ' ' || o.o_orderpriority AS title,
               CASE WHEN o.o_orderstatus = 'O' THEN 'new'
                    WHEN o.o_orderstatus = 'F' THEN 'expired'
                    WHEN o.o_totalprice > 250000 THEN 'applied'
                    ELSE 'ignored' END AS status,
               o.o_orderstatus <> 'F' AS is_active,
               CASE WHEN o.o_orderpriority = '1-URGENT' THEN
                         CASE WHEN c.c_mktsegment = 'BUILDING' THEN '' END
                    WHEN o.o_orderpriority = '2-HIGH' THEN
                         lpad(CAST(o.o_custkey AS STRING), 5, '0') || ' ' || r.r_name ||
                         CASE WHEN c.c_mktsegment = 'FURNITURE' THEN ', hessen'
                              WHEN c.c_mktsegment = 'HOUSEHOLD' THEN ', Umland' ELSE '' END
                    WHEN o.o_orderpriority = '3-MEDIUM' THEN
                         r.r_name || CASE WHEN c.c_mktsegment = 'BUILDING' THEN ', bayern'
                                          WHEN c.c_mktsegment = 'FURNITURE' THEN ','
                                          ELSE ', Mitte' END
                    WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN
                         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Remote'
                              ELSE 'Home Office ' || r.r_name END
                    WHEN c.c_mktsegment = 'MACHINERY' THEN 'sachsen'
                    WHEN c.c_mktsegment = 'AUTOMOBILE' THEN ' ' || r.r_name || ' '
                    ELSE n.n_name END AS location_raw,
               CASE WHEN o.o_orderstatus = 'P' THEN 'unknown'
                    WHEN o.o_orderpriority = '2-HIGH' THEN 'failed'
                    WHEN c.c_mktsegment = 'BUILDING' THEN 'unknown'
                    ELSE 'resolved' END AS location_status,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'onsite'
                    WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'hybrid'
                    WHEN o.o_orderpriority = '1-URGENT' THEN 'remote' END AS work_model,
               CASE WHEN o.o_totalprice > 400000 THEN
                         CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING) || ' EUR'
                    WHEN o.o_totalprice < 10000 THEN '' END AS salary_raw,
               CASE WHEN o.o_totalprice > 450000 THEN
                         CAST(floor(o.o_totalprice) AS BIGINT) END AS salary_min,
               CASE WHEN o.o_orderpriority <> '1-URGENT' THEN
                         o.o_orderdate + INTERVAL 60 DAY END AS deadline,
               o.o_orderdate AS first_seen_at,
               o.o_orderdate + INTERVAL 10 DAY AS last_seen_at,
               CASE WHEN d.lang = 'es' THEN '' ELSE d.text END AS raw_text,
               c.c_mktsegment AS sector
        FROM {orders} o
        JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        JOIN {region} r ON r.r_regionkey = n.n_regionkey
        LEFT JOIN {documents} d ON d.doc_id = o.o_orderkey
    """,
    # source links: one per shipped position, url unique
    "v_sources": """
        SELECT l_orderkey AS job_id,
               l_returnflag || l_linestatus AS source_name,
               'https://jobs.example/' || CAST(l_orderkey AS STRING) || '/'
                   || CAST(l_linenumber AS STRING) || '/' || l_returnflag || l_linestatus AS url,
               CAST(min(l_partkey) AS STRING) AS source_job_id,
               min(l_shipdate) AS first_seen_at,
               max(l_shipdate) AS last_seen_at,
               min(l_quantity) > 40 AS is_canonical
        FROM {lineitem}
        GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus
    """,
    "v_companies": """
        SELECT c.c_custkey AS id,
               c.c_name AS name,
               lower(replace(c.c_name, '#', '')) AS name_normalized,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'found'
                    WHEN c.c_mktsegment = 'MACHINERY' THEN 'failed'
                    ELSE 'unknown' END AS address_status,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN n.n_name END
                   AS address_city,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN c.c_acctbal / 100 END AS lat,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN c.c_nationkey * 1.5 END AS lng,
               CASE WHEN c.c_acctbal > 5000 THEN 'hybrid' ELSE 'unknown' END AS remote_policy
        FROM {customer} c
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    """,
    # postings: one per event; a user without supplier has no employer
    "v_postings": """
        SELECT e.event_id AS seq,
               e.event_type AS source_name,
               CASE WHEN e.event_type IN ('click', 'view') THEN 'aggregator'
                    ELSE 'portal' END AS source_type,
               p.p_brand || ' ' || p.p_name || ' ' || p.p_type AS title,
               coalesce(s.s_name, 'Unbekannt') AS company_name,
               CASE WHEN n.n_name IS NOT NULL THEN
                         lpad(CAST(e.user_id AS STRING), 5, '0') || ' ' || n.n_name END
                   AS location_raw,
               'https://jobs.example/' || e.event_type || '/' || CAST(e.user_id AS STRING)
                   || '/' || e.k AS url,
               CASE WHEN e.event_type <> 'signup' THEN
                         CAST(e.user_id AS STRING) || '-'
                         || CAST(CAST(floor(e.value) AS BIGINT) AS STRING) END AS source_job_id,
               CASE WHEN e.event_type <> 'error' THEN e.props END AS raw_text,
               e.ts AS published_at
        FROM (SELECT event_id, ts, user_id, event_type, value, props,
                     regexp_extract(props, '[0-9]+', 0) AS k FROM {events}) e
        JOIN {part} p ON p.p_partkey = CAST(e.k AS BIGINT)
        LEFT JOIN {supplier} s ON s.s_suppkey = e.user_id
        LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey
    """,
    # offers: part x supplier of each shipped position
    "v_offers": """
        SELECT l.l_orderkey AS order_id,
               l.l_linenumber AS line,
               l.l_partkey AS part_id,
               CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) || '-'
                   || CAST(CAST(floor(l.l_extendedprice) AS BIGINT) AS STRING) || '-'
                   || CAST(l.l_orderkey AS STRING) || CAST(l.l_linenumber AS STRING) AS uid,
               p.p_name AS title,
               s.s_name AS company_name,
               lpad(CAST(l.l_suppkey AS STRING), 5, '0') || ' ' || n.n_name AS location_raw,
               l.l_returnflag AS flag,
               l.l_linestatus AS line_status,
               l.l_quantity AS quantity,
               l.l_extendedprice AS price,
               l.l_shipdate AS shipped_at,
               p.p_size AS size
        FROM {lineitem} l
        JOIN {part} p ON p.p_partkey = l.l_partkey
        JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
        JOIN {nation} n ON n.n_nationkey = s.s_nationkey
    """,
    # commuting facts: minutes, model and office days of each shipped position
    "v_commute": """
        SELECT l.l_orderkey AS order_id,
               l.l_linenumber AS line,
               l.l_partkey AS part_id,
               CASE WHEN l.l_discount < 0.09 THEN CAST(l.l_quantity AS INT) * 3 END AS public,
               CASE WHEN l.l_tax < 0.07 THEN p.p_size * 2 END AS car,
               CASE WHEN l.l_returnflag = 'A' THEN 'hybrid'
                    WHEN l.l_returnflag = 'N' THEN 'onsite'
                    WHEN l.l_linestatus = 'F' THEN 'remote' END AS model,
               CASE WHEN l.l_linenumber < 6 THEN l.l_linenumber END AS days
        FROM {lineitem} l
        JOIN {part} p ON p.p_partkey = l.l_partkey
    """,
    # documents with a closing sentence that names a work model in some languages
    "v_texts": """
        SELECT doc_id AS id,
               source AS source_name,
               lang,
               CASE WHEN lang = 'de' THEN text || ' Wir arbeiten hybrid, '
                         || substr(CAST(n_chars AS STRING), 1, 1) || '-5 Tage pro Woche.'
                    WHEN lang = 'fr' THEN text || ' 100% Remote'
                    WHEN lang = 'es' THEN text || ' Arbeit vor Ort, '
                         || substr(CAST(n_chars AS STRING), 1, 1) || ' Tage im Büro'
                    ELSE text END AS raw_text
        FROM {documents}
    """,
}

_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table or one of the views above."""
    if name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(rows) if name in FACTS else rows
    text = VIEWS[name]
    inputs = {used: table(spark, sf_dir, used) for used in set(_NAME.findall(text))}
    return spark.sql(text, **inputs)


class Inputs:
    """Tables and views of one data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def with_views(query: str) -> str:
    """Checking SQL with the views it names put in front as common table expressions."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed[name] = _NAME.sub(r"\1", VIEWS[name])

    visit(query)
    if not needed:
        return query
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in needed.items())
    body = query.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"WITH {ctes}\n{body}"
