"""Registered queries: specified evaluations over the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk.operators import analytics as A
from stellwerk.operators import retrieval
from stellwerk.operators import skill_pairs as P
from stellwerk.operators import weighted_pairs as W
from stellwerk.plans.identity_queries import RATIOS_OF_PAIRS
from stellwerk.plans.registry import register

AS_OF = "2001-07-01 06:30:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@register(
    "keyword_exclusion",
    """
    SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'Ring'
                           WHEN contains(lower(p_name), 'small') THEN 'small' END AS excluded_by
    FROM part
    """,
)
def keyword_exclusion(v):
    return A.exclude_by_keyword(v.part, ["Ring", "small"], F.col("p_name")).select("p_partkey", "excluded_by")


@register(
    "weighted_total",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round((0.0::DOUBLE + l_quantity * 35 + l_linenumber * 25 + l_discount * 20 + l_tax * 15
                  + l_quantity * 5) / 100, 4) AS total
    FROM lineitem
    """,
)
def weighted_total(v):
    named = v.lineitem.withColumns(
        {
            "skills": F.col("l_quantity"), "level": F.col("l_linenumber"), "domain": F.col("l_discount"),
            "location": F.col("l_tax"), "potential": F.col("l_quantity"),
        }
    )
    return named.select("l_orderkey", "l_linenumber", "l_partkey", A.weighted_total().alias("total"))


@register(
    "strategy_comparison",
    """
    SELECT event_type AS eval_strategy, count(*) AS decisions, round(avg(value), 4) AS mean_delta,
           round(stddev_samp(value), 4) AS stddev_delta FROM events GROUP BY 1
    """,
)
def strategy_comparison(v):
    return A.strategy_comparison(
        v.events.select(F.col("event_type").alias("eval_strategy"), F.col("value").alias("score_delta"))
    )


@register(
    "change_detection",
    """
    SELECT j.id, p.page_id IS NOT NULL AND sha256(j.raw_text) IS DISTINCT FROM sha256(p.html) AS changed,
           CASE WHEN p.page_id IS NOT NULL AND j.raw_text IS NOT NULL
                 AND sha256(j.raw_text) <> sha256(p.html) THEN 1 ELSE 0 END AS entries,
           coalesce(sha256(p.html), sha256(j.raw_text)) AS content_hash
    FROM v_jobs j LEFT JOIN pages p ON p.page_id = j.id
    """,
)
def change_detection(v):
    jobs = v.v_jobs.select(
        "id", F.sha2("raw_text", 256).alias("content_hash"),
        F.lit(None).cast("array<struct<changed_at:timestamp,content_hash:string>>").alias("change_history"),
    )
    texts = v.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return A.detect_changes(jobs, texts, _as_of()).select(
        "id", "changed", F.size("change_history").alias("entries"), "content_hash"
    )


@register(
    "reevaluation_list",
    """
    SELECT l_orderkey AS job_id, l_suppkey AS user_id FROM lineitem
    JOIN supplier ON s_suppkey = l_suppkey JOIN v_jobs ON id = l_orderkey
    GROUP BY 1, 2 HAVING max(l_linenumber) < max(s_nationkey)
    """,
)
def reevaluation_list(v):
    users = v.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("profile_version"))
    evaluations = v.lineitem.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_linenumber").alias("profile_version"),
    )
    return A.needs_reevaluation(v.v_jobs, users, evaluations)


def _skills(v):
    return v.lineitem.join(v.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("job_id"), F.col("p_type").alias("skill")
    )


def _fine_skills(v):
    return v.lineitem.join(v.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("job_id"), F.concat_ws(" ", "p_brand", "p_type").alias("skill")
    )


_SKILL_PAIRS_SQL = """
    WITH skills AS (SELECT DISTINCT l_orderkey AS job_id, p_brand || ' ' || p_type AS skill
                    FROM lineitem JOIN part ON p_partkey = l_partkey),
    pairs AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS jobs
              FROM skills a JOIN skills b ON a.job_id = b.job_id AND a.skill < b.skill
              GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@register("skill_pairs", _SKILL_PAIRS_SQL + "SELECT skill_a, skill_b, jobs FROM pairs")
def skill_pairs(v):
    """Kinds of parts that two or more orders share."""
    return P.skill_pairs(_fine_skills(v), 2)


@register(
    "skill_partners",
    _SKILL_PAIRS_SQL
    + """
    , sides AS (SELECT skill_a AS skill, skill_b AS partner, jobs FROM pairs
                UNION ALL SELECT skill_b, skill_a, jobs FROM pairs)
    SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY jobs DESC, partner)::INT AS rank, partner, jobs
    FROM sides QUALIFY rank <= 5
    """,
)
def skill_partners(v):
    """The five kinds of parts that each one is ordered with most."""
    return P.best_partners(P.skill_pairs(_fine_skills(v), 2), 5)


@register(
    "skill_trends",
    """
    WITH skills AS (SELECT DISTINCT l_orderkey AS job_id, p_type AS skill
                    FROM lineitem JOIN part ON p_partkey = l_partkey),
    used AS (SELECT s.job_id, s.skill, date_trunc('month', j.first_seen_at) AS m, j.salary_min
             FROM skills s JOIN v_jobs j ON j.id = s.job_id),
    per AS (SELECT skill, m, source_name, count(*) AS n FROM used JOIN v_sources USING (job_id) GROUP BY 1, 2, 3),
    mix AS (SELECT skill, m, string_agg(source_name || '=' || n, ',' ORDER BY source_name) AS source_mix
            FROM per GROUP BY 1, 2)
    SELECT u.skill, strftime(u.m, '%Y-%m-%d') AS period, count(*) AS job_count,
           round(avg(salary_min), 2) AS avg_salary_min, any_value(source_mix) AS source_mix
    FROM used u LEFT JOIN mix USING (skill, m) GROUP BY 1, 2
    """,
)
def skill_trends(v):
    trends = A.skill_trends(_skills(v), v.v_jobs, v.v_sources)
    mix = F.array_join(
        F.transform(F.map_entries("source_mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return trends.select(
        "skill", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "job_count", "avg_salary_min",
        mix.alias("source_mix"),
    )


@register(
    "salary_histogram",
    """
    SELECT CASE WHEN salary_min >= 500000 THEN 6
                ELSE CAST(floor((salary_min - 450000) / 10000) AS BIGINT) + 1 END AS bucket, count(*) AS jobs
    FROM v_jobs WHERE salary_min IS NOT NULL GROUP BY 1
    """,
)
def salary_histogram(v):
    return A.salary_histogram(v.v_jobs, 450000, 500000, 5)


@register(
    "remote_share",
    """
    SELECT sector, count(*) AS jobs, count(*) FILTER (WHERE work_model = 'remote') AS remote,
           round(count(*) FILTER (WHERE work_model = 'remote') / count(*) * 100, 2) AS remote_pct
    FROM v_jobs GROUP BY sector
    """,
)
def remote_share(v):
    return A.remote_share(v.v_jobs)


@register(
    "application_funnel",
    """
    SELECT count(*) AS found, count(*) FILTER (WHERE status = 'applied') AS applied,
           0 AS interview, 0 AS offer FROM v_jobs
    """,
)
def application_funnel(v):
    return A.application_funnel(v.v_jobs)


@register(
    "best_sources",
    """
    SELECT source_name, count(*) AS jobs, round(avg(o_totalprice), 4) AS mean_score
    FROM (SELECT DISTINCT source_name, job_id FROM v_sources) JOIN orders ON o_orderkey = job_id GROUP BY 1
    """,
)
def best_sources(v):
    scores = v.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("score"))
    return A.best_sources(v.v_sources, scores)


@register(
    "daily_tiles",
    f"""
    SELECT count(*) FILTER (WHERE status = 'new' AND is_active) AS new, count(*) FILTER (WHERE is_active) AS open,
           count(*) FILTER (WHERE is_active AND deadline >= TIMESTAMP '{AS_OF}'
                            AND deadline < TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY) AS deadline_soon,
           0 AS interviews
    FROM v_jobs
    """,
)
def daily_tiles(v):
    return A.daily_tiles(v.v_jobs, _as_of())


@register(
    "job_list",
    f"""
    SELECT j.id, j.title FROM v_jobs j JOIN orders ON o_orderkey = j.id
    WHERE j.status = 'new' AND o_totalprice >= 200000 AND j.work_model = 'hybrid'
      AND j.deadline < TIMESTAMP '{AS_OF}' AND (contains(j.title, 'HIGH') OR contains(j.raw_text, 'HIGH'))
    """,
)
def job_list(v):
    scored = v.v_jobs.join(
        v.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "id"
    )
    return A.job_list(scored, "new", 200000, "hybrid", _as_of(), "HIGH").select("id", "title")


@register(
    "job_list_of_source",
    f"""
    SELECT j.id, j.title FROM v_jobs j
    WHERE j.status = 'new' AND j.deadline < TIMESTAMP '{AS_OF}'
      AND EXISTS (SELECT 1 FROM v_sources s WHERE s.job_id = j.id AND s.source_name = 'AF')
    """,
)
def job_list_of_source(v):
    scored = v.v_jobs.withColumn("score", F.lit(0))
    found = A.job_list(scored, "new", deadline_before=_as_of(), source="AF", sources=v.v_sources)
    return found.select("id", "title")


@register(
    "clarification_queue",
    """
    WITH j AS (SELECT v.id, v.location_status, v.work_model, c.address_status, v.company_id,
                      CAST(floor(o_totalprice / 50000) AS INT) AS score
               FROM v_jobs v JOIN orders ON o_orderkey = v.id LEFT JOIN v_companies c ON c.id = v.company_id)
    SELECT id AS entity_id, 'company_address' AS issue_type, score,
           CASE WHEN score > 7 THEN 'urgent' ELSE 'normal' END AS priority FROM j WHERE address_status <> 'found'
    UNION ALL SELECT id, 'location', score, CASE WHEN score > 7 THEN 'urgent' ELSE 'normal' END
              FROM j WHERE location_status = 'failed'
    UNION ALL SELECT id, 'work_model', score, CASE WHEN score > 7 THEN 'urgent' ELSE 'normal' END
              FROM j WHERE work_model IS NULL
    """,
)
def clarification_queue(v):
    score = F.floor(F.col("o_totalprice") / 50000).cast("int")
    scored = v.v_jobs.join(v.orders.select(F.col("o_orderkey").alias("id"), score.alias("score")), "id")
    return A.clarification_queue(scored, v.v_companies)


@register(
    "anonymous_feedback",
    """
    SELECT o_orderkey AS job_id, o_orderstatus AS decision, c_mktsegment AS sector
    FROM orders JOIN customer ON c_custkey = o_custkey
    """,
)
def anonymous_feedback(v):
    feedback = v.orders.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"),
        F.col("o_orderstatus").alias("decision"), F.col("o_orderpriority").alias("reasoning"),
    )
    companies = v.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("sector"))
    return A.anonymous_feedback(feedback, companies)


@register(
    "token_costs",
    """
    SELECT l_returnflag AS model, round(sum(l_quantity / 1000 * coalesce(p, 0) + l_linenumber / 1000 * coalesce(q, 0)), 4)
           AS cost
    FROM lineitem LEFT JOIN (SELECT 'A' AS m, 3.0::DOUBLE AS p, 15.0::DOUBLE AS q
                             UNION ALL SELECT 'N', 0.25, 1.25) ON m = l_returnflag
    GROUP BY 1
    """,
)
def token_costs(v):
    usage = v.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input_tokens"),
        F.col("l_linenumber").alias("output_tokens"),
    )
    prices = v.spark.createDataFrame(
        [("A", 3.0, 15.0), ("N", 0.25, 1.25)], "model string, input_price double, output_price double"
    )
    return A.token_costs(usage, prices)


@register(
    "location_fingerprint",
    """
    SELECT seq, md5(lower(title) || '|' || lower(company_name) || '|' || lower(coalesce(location_raw, ''))) AS print
    FROM v_postings
    """,
)
def location_fingerprint(v):
    place = F.coalesce("location_raw", F.lit(""))
    return v.v_postings.select(
        "seq", A.location_fingerprint(F.col("title"), F.col("company_name"), place).alias("print")
    )


@register(
    "known_city",
    r"""
    SELECT page_id, nullif(regexp_extract(html, '(^|[^\p{L}\p{N}_])(fr|en|es)([^\p{L}\p{N}_]|$)', 2), '') AS city,
           nullif(regexp_extract(url, '[-/](\d{6,})([-/.?#]|$)', 1), '') AS url_id
    FROM pages
    """,
)
def known_city(v):
    return v.pages.select(
        "page_id", A.known_city(F.col("html"), ["fr", "en", "es"]).alias("city"),
        A.numeric_url_id(F.col("url")).alias("url_id"),
    )


@register(
    "best_chunks",
    """
    WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings)
    SELECT q.id AS job_id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector, c.vector), 12) DESC, c.id)::INT AS rank,
           c.id AS chunk_id, list_cosine_similarity(q.vector, c.vector) AS score
    FROM v q JOIN v c ON q.id % 10 = 0 AND c.id % 10 <> 0 QUALIFY rank <= 5
    """,
)
def best_chunks(v):
    """Every tenth vector plays a job, the others the chunks of a profile."""
    vectors = v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.best_chunks(vectors.where("id % 10 = 0"), vectors.where("id % 10 <> 0"), 5)


def _kinds(v):
    """Parts as postings: the name and type as title, the brand as company."""
    return v.part.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("company")
    )


_CLASSES_SQL = """
    WITH RECURSIVE classes AS (
      SELECT lower(p_name || ' ' || p_type) AS title, lower(p_brand) AS company, min(p_partkey) AS id FROM part GROUP BY 1, 2)
"""


@register(
    "weighted_duplicates",
    # Pairs of texts that cannot reach a field's least ratio leave by their edit distance.
    _CLASSES_SQL
    + """
    , texts AS (SELECT DISTINCT title AS t, 0.75 AS least FROM classes UNION ALL SELECT DISTINCT company, 0.625 FROM classes),
    pairs AS (SELECT DISTINCT x.t AS a, y.t AS b FROM texts x JOIN texts y ON x.least = y.least AND x.t <> y.t
              AND length(x.t) + length(y.t) - levenshtein(x.t, y.t) >= x.least * (length(x.t) + length(y.t)) - 1e-6)
"""
    + RATIOS_OF_PAIRS
    + """
    , alike AS (SELECT a, b, ratio FROM ratios UNION ALL SELECT DISTINCT t, t, 1.0::DOUBLE FROM texts),
    by_title AS (SELECT x.id AS class_id, y.id AS other_id, x.company AS c, y.company AS d, r.ratio
                 FROM classes x JOIN alike r ON r.a = x.title JOIN classes y ON y.title = r.b AND x.id < y.id)
    SELECT class_id, other_id, round(p.ratio * 0.6::DOUBLE + r.ratio * 0.4::DOUBLE, 6) AS similarity
    FROM by_title p JOIN alike r ON r.a = p.c AND r.b = p.d
    WHERE p.ratio * 0.6::DOUBLE + r.ratio * 0.4::DOUBLE >= 0.85::DOUBLE
    """,
)
def weighted_duplicates(v):
    """Pairs of kinds of parts whose names and brands are alike."""
    return W.weighted_pairs(_kinds(v)).withColumn("similarity", F.round("similarity", 6))


@register(
    "duplicate_classes",
    """
    SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_name || ' ' || p_type), lower(p_brand)) AS class_id FROM part
    """,
)
def duplicate_classes(v):
    """The class of equal name and brand of every part."""
    return W.members(_kinds(v))
