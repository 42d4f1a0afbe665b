"""Registered queries: quality sections, diagnosis and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.operators import quality as Q
from stellwerk.operators.recommendations import recommendations
from stellwerk.plans.registry import register
from stellwerk.plans.report import quality_report

_TS = "yyyy-MM-dd HH:mm:ss"
SOURCE = "AF"


@register(
    "source_breakdown",
    """
    SELECT source_name, count(DISTINCT job_id) AS job_count,
           strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
           strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM v_sources GROUP BY source_name ORDER BY job_count DESC, source_name
    """,
)
def source_breakdown(v):
    return _dated(Q.source_breakdown(v.v_sources))


def _dated(frame):
    return frame.withColumn("first_seen", F.date_format("first_seen", _TS)).withColumn(
        "last_seen", F.date_format("last_seen", _TS)
    )


@register(
    "general_stats",
    """
    SELECT (SELECT count(*) FROM v_jobs) AS total_jobs,
           (SELECT count(*) FROM v_jobs WHERE is_active) AS total_active,
           (SELECT count(*) FROM v_jobs WHERE status = 'expired') AS total_expired,
           (SELECT count(*) FROM v_companies) AS total_companies,
           (SELECT count(DISTINCT source_name) FROM v_sources) AS total_sources,
           (SELECT strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') FROM v_jobs) AS first_seen,
           (SELECT strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') FROM v_jobs) AS last_seen
    """,
)
def general_stats(v):
    return _dated(Q.general_stats(v.v_jobs, v.v_sources, v.v_companies))


@register(
    "status_breakdown",
    "SELECT status, count(*) AS job_count FROM v_jobs GROUP BY status",
)
def status_breakdown(v):
    return Q.status_breakdown(v.v_jobs)


_LOCATION_SQL = """
    SELECT count(*) FILTER (WHERE location_raw IS NOT NULL AND location_raw <> '')
               AS jobs_with_location,
           count(*) FILTER (WHERE location_raw IS NULL OR location_raw = '')
               AS jobs_without_location,
           round(count(*) FILTER (WHERE location_raw <> '') / count(*) * 100, 2)
               AS location_coverage_pct,
           count(DISTINCT location_raw) AS distinct_locations,
           count(*) FILTER (WHERE location_raw GLOB '[0-9][0-9][0-9][0-9][0-9] *')
               AS plz_city_count,
           greatest(0, count(*) FILTER (WHERE location_raw <> '')
               - count(*) FILTER (WHERE location_raw GLOB '[0-9][0-9][0-9][0-9][0-9] *')
               - count(*) FILTER (WHERE location_raw ILIKE '%remote%'
                   OR location_raw ILIKE '%homeoffice%' OR location_raw ILIKE '%home office%'))
               AS city_only_count,
           count(*) FILTER (WHERE location_raw ILIKE '%remote%'
               OR location_raw ILIKE '%homeoffice%' OR location_raw ILIKE '%home office%')
               AS remote_count,
           count(*) FILTER (WHERE location_raw IS NULL OR location_raw = '')
               AS unparseable_count
    FROM v_jobs
"""


@register("location_quality", _LOCATION_SQL)
def location_quality(v):
    return Q.location_quality(v.v_jobs)


@register(
    "top_locations",
    """
    SELECT location_raw AS location, count(*) AS job_count FROM v_jobs
    WHERE location_raw IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
    """,
)
def top_locations(v):
    return Q.top_locations(v.v_jobs)


_COVERAGE_SQL = """
    SELECT s.source_name, count(DISTINCT j.id) AS total,
           count(DISTINCT CASE WHEN j.location_raw <> '' THEN j.id END) AS with_location,
           count(DISTINCT CASE WHEN j.raw_text <> '' THEN j.id END) AS with_text,
           round(count(DISTINCT CASE WHEN j.location_raw <> '' THEN j.id END)
                 / count(DISTINCT j.id) * 100, 2) AS location_coverage_pct,
           round(count(DISTINCT CASE WHEN j.raw_text <> '' THEN j.id END)
                 / count(DISTINCT j.id) * 100, 2) AS text_coverage_pct
    FROM v_sources s JOIN v_jobs j ON j.id = s.job_id GROUP BY s.source_name
"""


@register("source_coverage", _COVERAGE_SQL)
def source_coverage(v):
    return Q.source_coverage(v.v_jobs, v.v_sources)


_COMPANY_SQL = """
    SELECT count(*) AS total_companies,
           count(*) FILTER (WHERE address_status = 'found') AS address_found,
           count(*) FILTER (WHERE address_status = 'unknown') AS address_unknown,
           count(*) FILTER (WHERE address_status = 'failed') AS address_failed,
           count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS with_lat_lng,
           count(*) FILTER (WHERE remote_policy <> 'unknown') AS with_remote_policy
    FROM v_companies
"""


@register("company_quality", _COMPANY_SQL)
def company_quality(v):
    return Q.company_quality(v.v_companies)


_MODEL_SQL = """
    SELECT coalesce(work_model, 'null') AS work_model, count(*) AS job_count,
           round(count(*) / (SELECT count(*) FROM v_jobs) * 100, 2) AS pct
    FROM v_jobs GROUP BY 1
"""


@register("work_model_breakdown", _MODEL_SQL)
def work_model_breakdown(v):
    return Q.work_model_breakdown(v.v_jobs)


_SALARY_SQL = """
    SELECT count(*) FILTER (WHERE salary_raw <> '') AS with_salary_raw,
           count(*) - count(*) FILTER (WHERE salary_raw <> '') AS without_salary_raw,
           round(count(*) FILTER (WHERE salary_raw <> '') / count(*) * 100, 2)
               AS salary_coverage_pct,
           count(salary_min) AS with_parsed_min_max
    FROM v_jobs
"""


@register("salary_quality", _SALARY_SQL)
def salary_quality(v):
    return Q.salary_quality(v.v_jobs)


_TEXT_SQL = """
    SELECT count(*) FILTER (WHERE raw_text <> '') AS with_raw_text,
           count(*) - count(*) FILTER (WHERE raw_text <> '') AS without_raw_text,
           round(count(*) FILTER (WHERE raw_text <> '') / count(*) * 100, 2)
               AS raw_text_coverage_pct,
           round(avg(length(raw_text)) FILTER (WHERE raw_text <> ''), 1) AS avg_text_length
    FROM v_jobs
"""


@register("raw_text_quality", _TEXT_SQL)
def raw_text_quality(v):
    return Q.raw_text_quality(v.v_jobs)


@register(
    "duplicate_analysis",
    """
    WITH links AS (SELECT job_id, count(*) AS c FROM v_sources GROUP BY job_id)
    SELECT (SELECT count(*) FROM v_jobs) AS total_jobs,
           CAST(sum(c) AS BIGINT) AS total_source_entries,
           count(*) FILTER (WHERE c > 1) AS jobs_with_multiple_sources,
           max(c) AS max_sources_per_job,
           round(CAST(sum(c) AS BIGINT) / (SELECT count(*) FROM v_jobs), 2) AS source_to_job_ratio
    FROM links
    """,
)
def duplicate_analysis(v):
    return Q.duplicate_analysis(v.v_jobs, v.v_sources)


@register(
    "text_coverage_by_week",
    f"""
    SELECT strftime(j.first_seen_at, '%Y-W%W') AS week, count(*) AS total,
           count(*) FILTER (WHERE j.raw_text <> '') AS with_text,
           round(count(*) FILTER (WHERE j.raw_text <> '') / count(*) * 100, 1) AS coverage_pct
    FROM v_jobs j JOIN v_sources s ON s.job_id = j.id
    WHERE s.source_name = '{SOURCE}'
    GROUP BY 1 ORDER BY 1 DESC LIMIT 12
    """,
)
def text_coverage_by_week(v):
    return Q.text_coverage_by_week(v.v_jobs, v.v_sources, SOURCE)


@register(
    "text_status_share",
    f"""
    WITH classed AS (
      SELECT CASE WHEN j.raw_text IS NULL THEN '{K.TEXT_NULL}' WHEN j.raw_text = '' THEN '{K.TEXT_EMPTY}'
                  WHEN length(j.raw_text) < 50 THEN '{K.TEXT_SHORT}' ELSE '{K.TEXT_OK}' END AS status
      FROM v_jobs j JOIN v_sources s ON s.job_id = j.id WHERE s.source_name = '{SOURCE}')
    SELECT status, count(*) AS job_count,
           round(count(*) / (SELECT count(*) FROM classed) * 100, 1) AS share_pct
    FROM classed GROUP BY status
    UNION ALL SELECT '{K.TEXT_TOTAL}', count(*), 100.0 FROM classed
    """,
)
def text_status_share(v):
    return Q.text_status_share(v.v_jobs, v.v_sources, SOURCE)


@register(
    "text_source_summary",
    f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE j.raw_text <> '') AS with_text,
           count(*) - count(*) FILTER (WHERE j.raw_text <> '') AS without_text,
           round(count(*) FILTER (WHERE j.raw_text <> '') / count(*) * 100, 1) AS coverage_pct,
           count(*) FILTER (WHERE j.raw_text <> '') / count(*) * 100 < 50 AS is_low
    FROM v_jobs j JOIN v_sources s ON s.job_id = j.id WHERE s.source_name = '{SOURCE}'
    """,
)
def text_source_summary(v):
    return Q.text_source_summary(v.v_jobs, v.v_sources, SOURCE)


@register(
    "location_stats",
    """
    SELECT (SELECT count(*) FROM v_jobs) AS jobs_total,
           (SELECT count(*) FROM v_jobs WHERE location_status = 'resolved') AS jobs_resolved,
           (SELECT count(*) FROM v_jobs WHERE location_status = 'unknown') AS jobs_unknown,
           (SELECT count(*) FROM v_jobs WHERE location_status = 'failed') AS jobs_failed,
           (SELECT count(*) FROM v_companies) AS companies_total,
           (SELECT count(*) FROM v_companies WHERE address_status = 'found')
               AS companies_with_address,
           (SELECT count(*) FROM v_companies WHERE address_status = 'unknown')
               AS companies_without_address,
           (SELECT count(*) FROM v_commute) AS transit_cache_entries
    """,
)
def location_stats(v):
    return Q.location_stats(v.v_jobs, v.v_companies, v.v_commute)


def _said(message: str, *values: str) -> str:
    """SQL of one of the fixed messages with its values."""
    quoted = message.replace("'", "''")
    return f"printf('{quoted}', {', '.join(values)})" if values else f"'{quoted}'"


_RULES_SQL = f"""
    WITH loc AS ({_LOCATION_SQL}), cov AS ({_COVERAGE_SQL}), com AS ({_COMPANY_SQL}),
         wm AS ({_MODEL_SQL}), sal AS ({_SALARY_SQL}), txt AS ({_TEXT_SQL}),
         miss AS (
           SELECT coalesce(string_agg('''' || source_name || '''', ', ' ORDER BY source_name)
                    FILTER (WHERE location_coverage_pct < 100), '') AS l,
                  coalesce(string_agg('''' || source_name || '''', ', ' ORDER BY source_name)
                    FILTER (WHERE text_coverage_pct < 100), '') AS t
           FROM cov)
    SELECT 'location' AS category,
           CASE WHEN location_coverage_pct < 90 THEN 'high' ELSE 'medium' END AS severity,
           {_said(K.MSG_LOCATION, "100 - location_coverage_pct", "'[' || l || ']'")} AS message,
           jobs_without_location AS affected_count,
           round(100 - location_coverage_pct, 2) AS affected_pct
    FROM loc, miss WHERE location_coverage_pct < 95
    UNION ALL
    SELECT 'location', 'high', {_said(K.MSG_LOCATION_SOURCE, "source_name")}, total, 100.0
    FROM cov WHERE location_coverage_pct = 0 AND total > 0
    UNION ALL
    SELECT 'work_model', CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END,
           {_said(K.MSG_WORK_MODEL)},
           job_count, pct
    FROM wm WHERE work_model = 'null' AND pct > 20
    UNION ALL
    SELECT 'raw_text', CASE WHEN raw_text_coverage_pct < 80 THEN 'high' ELSE 'medium' END,
           {_said(K.MSG_TEXT, "'[' || t || ']'")},
           without_raw_text, round(100 - raw_text_coverage_pct, 2)
    FROM txt, miss WHERE raw_text_coverage_pct < 95
    UNION ALL
    SELECT 'raw_text', 'medium', {_said(K.MSG_TEXT_SOURCE, "source_name")}, total, 100.0
    FROM cov WHERE text_coverage_pct = 0 AND total > 0
    UNION ALL
    SELECT 'salary', 'low', {_said(K.MSG_SALARY, "salary_coverage_pct")},
           without_salary_raw, round(100 - salary_coverage_pct, 2)
    FROM sal WHERE salary_coverage_pct < 20
    UNION ALL
    SELECT 'general', 'high',
           {_said(K.MSG_ADDRESS)},
           address_unknown, round(address_unknown / total_companies * 100, 2)
    FROM com WHERE address_unknown / total_companies * 100 > 90
"""


@register("recommendations", _RULES_SQL)
def recommendation_rules(v):
    return recommendations(
        location=Q.location_quality(v.v_jobs),
        work_model=Q.work_model_breakdown(v.v_jobs),
        salary=Q.salary_quality(v.v_jobs),
        raw_text=Q.raw_text_quality(v.v_jobs),
        companies=Q.company_quality(v.v_companies),
        coverage=Q.source_coverage(v.v_jobs, v.v_sources),
    )


@register(
    "report_metrics",
    """
    WITH links AS (SELECT job_id, count(*) AS c FROM v_sources GROUP BY job_id)
    SELECT 'general' AS section, 'total_jobs' AS metric, CAST(count(*) AS DOUBLE) AS value
      FROM v_jobs
    UNION ALL SELECT 'general', 'total_active', count(*) FROM v_jobs WHERE is_active
    UNION ALL SELECT 'general', 'total_companies', count(*) FROM v_companies
    UNION ALL SELECT 'location', 'location_coverage_pct',
                     round(count(*) FILTER (WHERE location_raw <> '') / count(*) * 100, 2)
      FROM v_jobs
    UNION ALL SELECT 'salary', 'salary_coverage_pct',
                     round(count(*) FILTER (WHERE salary_raw <> '') / count(*) * 100, 2)
      FROM v_jobs
    UNION ALL SELECT 'raw_text', 'raw_text_coverage_pct',
                     round(count(*) FILTER (WHERE raw_text <> '') / count(*) * 100, 2)
      FROM v_jobs
    UNION ALL SELECT 'duplicates', 'total_source_entries', count(*) FROM v_sources
    UNION ALL SELECT 'duplicates', 'max_sources_per_job', max(c) FROM links
    """,
)
def report_metrics(v):
    report = quality_report(v.v_jobs, v.v_sources, v.v_companies)
    wanted = [
        ("general", "total_jobs"), ("general", "total_active"), ("general", "total_companies"),
        ("location", "location_coverage_pct"), ("salary", "salary_coverage_pct"),
        ("raw_text", "raw_text_coverage_pct"), ("duplicates", "total_source_entries"),
        ("duplicates", "max_sources_per_job"),
    ]
    frames = [
        report[section].select(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
        )
        for section, metric in wanted
    ]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked
