import json

import pytest
from pyspark.sql import functions as F

from stellwerk import schemas
from stellwerk.operators import quality as Q
from stellwerk.operators.recommendations import recommendations
from stellwerk.plans.report import quality_report, write_report


def _empty(spark):
    return [spark.createDataFrame([], s) for s in (schemas.JOBS, schemas.JOB_SOURCES, schemas.COMPANIES)]


def _jobs(spark, rows):
    """rows: (id, location, text, model)"""
    frame = spark.createDataFrame(rows, "id long, location_raw string, raw_text string, work_model string")
    rest = {"is_active": "true", "status": "'new'", "salary_raw": "''", "salary_min": "cast(null as int)",
            "first_seen_at": "timestamp'2026-03-01'", "last_seen_at": "timestamp'2026-03-02'"}
    return frame.withColumns({k: F.expr(v) for k, v in rest.items()})


def test_empty_tables(spark):
    report = quality_report(*_empty(spark))
    assert report["general"].first().asDict() == {
        "total_jobs": 0, "total_active": 0, "total_expired": 0, "total_companies": 0, "total_sources": 0,
        "first_seen": None, "last_seen": None}
    location = report["location"].first()
    assert location["location_coverage_pct"] == 0.0 and location["city_only_count"] == 0
    assert report["salary"].first()["salary_coverage_pct"] == 0.0
    assert report["raw_text"].first().asDict() == {
        "with_raw_text": 0, "without_raw_text": 0, "raw_text_coverage_pct": 0.0, "avg_text_length": None}
    assert report["duplicates"].first()["source_to_job_ratio"] == 0.0
    assert [report[x].count() for x in ("status", "sources", "coverage", "work_model", "top_locations")] == [0] * 5
    got = {(r["category"], r["severity"]) for r in report["recommendations"].collect()}
    assert got == {("location", "high"), ("raw_text", "high"), ("salary", "low")}


def test_coverage_counts_distinct_jobs(spark):
    jobs = _jobs(spark, [(1, "Kassel", "t", None), (2, "", None, None), (3, None, "", None)])
    links = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("b", 9)], "source_name string, job_id long")
    got = {r["source_name"]: tuple(r)[1:] for r in Q.source_coverage(jobs, links).collect()}
    assert got == {"a": (2, 1, 1, 50.0, 50.0), "b": (1, 0, 0, 0.0, 0.0)}


def test_shape_of_locations(spark):
    jobs = _jobs(spark, [(i, x, None, None) for i, x in enumerate(
        ["34117 Kassel", "34117 Kassel", "Remote", "HomeOffice", "Home Office", "Köln", "", None, "3411 Ort", "341177 Ort"])])
    row = Q.location_quality(jobs).first()
    assert (row["jobs_with_location"], row["distinct_locations"], row["plz_city_count"], row["remote_count"]) == (8, 8, 2, 3)
    assert (row["city_only_count"], row["unparseable_count"], row["location_coverage_pct"]) == (3, 2, 80.0)
    top = [tuple(r) for r in Q.top_locations(jobs, 2).collect()]
    assert top == [("34117 Kassel", 2), ("", 1)]


def test_fan_out_per_url(spark):
    jobs = _jobs(spark, [(1, None, "x" * 60, None), (2, None, "kurz", None), (3, None, None, None)])
    links = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 3)], "source_name string, job_id long")
    assert Q.text_source_summary(jobs, links, "a").first()[:4] == (4, 3, 1, 75.0)
    got = {r["status"]: (r["job_count"], r["share_pct"]) for r in Q.text_status_share(jobs, links, "a").collect()}
    assert got == {"ok": (2, 50.0), "sehr_kurz (<50)": (1, 25.0), "NULL": (1, 25.0), "GESAMT": (4, 100.0)}
    assert [tuple(r) for r in Q.text_coverage_by_week(jobs, links, "a").collect()] == [("2026-W08", 4, 3, 75.0)]
    assert Q.text_status_share(jobs, links, "zz").count() == 0


@pytest.mark.parametrize("location,text,model,salary,unknown,want", [
    (90.0, 95.0, 50.0, 20.0, 90, {("location", "medium"), ("work_model", "medium")}),
    (89.99, 79.99, 50.01, 19.99, 91, {("location", "high"), ("raw_text", "high"), ("work_model", "high"), ("salary", "low"), ("general", "high")}),
    (95.0, 80.0, 20.0, 20.0, 90, {("raw_text", "medium")}),
])
def test_rule_thresholds(spark, location, text, model, salary, unknown, want):
    def frame(**values):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    found = recommendations(
        location=frame(location_coverage_pct=location, jobs_without_location=5),
        work_model=frame(work_model="null", job_count=3, pct=model),
        salary=frame(salary_coverage_pct=salary, without_salary_raw=1),
        raw_text=frame(raw_text_coverage_pct=text, without_raw_text=2),
        companies=frame(address_unknown=unknown, total_companies=100),
        coverage=frame(source_name="a", total=4, location_coverage_pct=99.0, text_coverage_pct=100.0),
    ).collect()
    assert {(r["category"], r["severity"]) for r in found} == want
    ranks = [("high", "medium", "low").index(r["severity"]) for r in found]
    assert ranks == sorted(ranks)
    for r in found:
        if r["category"] == "location":
            assert r["message"].startswith(f"{100 - location:.1f}% der Jobs") and "['a']" in r["message"]
        if r["category"] == "raw_text":
            assert r["message"].startswith("Quellen [] liefern")


def test_sources_without_anything(spark):
    coverage = spark.createDataFrame([("leer", 3, 0, 0, 0.0, 0.0)],
                                     "source_name string, total long, with_location long, with_text long, location_coverage_pct double, text_coverage_pct double")
    jobs, links, companies = _empty(spark)
    found = recommendations(Q.location_quality(jobs), Q.work_model_breakdown(jobs), Q.salary_quality(jobs),
                            Q.raw_text_quality(jobs), Q.company_quality(companies), coverage).collect()
    messages = {r["message"]: r["severity"] for r in found}
    assert messages["Quelle 'leer' liefert keine Locations. Parser oder Scraper anpassen."] == "high"
    assert messages["Quelle 'leer' liefert keinen Volltext."] == "medium"


def test_report_sink(spark, tmp_path):
    report = quality_report(*_empty(spark))
    for day in ("2026-03-22", "2026-03-23", "2026-03-22"):
        write_report(report, str(tmp_path), day)
    rows = spark.read.json(str(tmp_path))
    assert {str(r["report_date"]) for r in rows.collect()} == {"2026-03-22", "2026-03-23"}
    day = [r for r in rows.collect() if str(r["report_date"]) == "2026-03-22"]
    general = [json.loads(r["content"]) for r in day if r["section"] == "general"]
    assert len(general) == 1 and general[0]["total_jobs"] == 0
