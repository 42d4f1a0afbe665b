import pytest
from pyspark.sql import functions as F

from stellwerk.constants import FEDERAL_STATES
from stellwerk.functions import location as L
from test_text import many


def test_parse(spark):
    cases = {
        "34117 Kassel": ("plz_city", "Kassel", "34117", None),
        "60311 Frankfurt am Main, Hessen": ("plz_city", "Frankfurt am Main", "60311", "Hessen"),
        "60311 Frankfurt, Mitte": ("plz_city", "Frankfurt, Mitte", "60311", None),
        "Frankfurt am Main, Hessen": ("city_only", "Frankfurt am Main", None, "Hessen"),
        "Kassel, Nord": ("city_only", "Kassel", None, "Nord"),
        "Kassel,": ("city_only", "Kassel", None, None),
        " Berlin Mitte ": ("city_only", "Berlin Mitte", None, None),
        "bayern": ("region", None, None, "Bayern"),
        "Remote": ("remote", None, None, None),
        "Homeoffice": ("remote", None, None, None),
        "Home Office möglich": ("remote", None, None, None),
        "deutschlandweit": ("remote", None, None, None),
        "bundesweit": ("remote", None, None, None),
        "": ("unparseable", None, None, None),
        "   ": ("unparseable", None, None, None),
        "Raum 123 irgendwo": ("unparseable", None, None, None),
        "12345 Ort,\nRest": ("plz_city", "Ort", "12345", "Rest"),
        **{state: ("region", None, None, state) for state in FEDERAL_STATES},
    }
    rows = [(k,) for k in [*cases, None]]
    parsed = spark.createDataFrame(rows, "x string").select("x", L.parse_location(F.col("x")).alias("p")).collect()
    got = {r["x"]: (r["p"]["pattern_type"], r["p"]["city"], r["p"]["postal_code"], r["p"]["region"]) for r in parsed}
    assert got.pop(None) == ("unparseable", None, None, None)
    assert got == cases
    assert all(r["p"]["is_remote"] == (r["p"]["pattern_type"] == "remote") for r in parsed)
    assert all(r["p"]["raw"] == (r["x"] or "").strip() for r in parsed)


def test_work_model(spark):
    many(spark, [
        ("Wir arbeiten hybrid", "hybrid"), ("teilweise remote möglich", "hybrid"), ("3 Tage im Büro", "hybrid"),
        ("100% Remote", "remote"), ("Homeoffice", "remote"), ("VOR ORT in Kassel", "onsite"),
        ("in unserem Büro", "onsite"), ("Tage vor Ort", "hybrid"), ("nichts", None), ("", None), (None, None),
    ], L.detect_work_model)


def test_hybrid_days(spark):
    many(spark, [
        ("2-3 Tage pro Woche", 2), ("3–5 Tage/Woche", 4), ("2 - 4 Tage WÖCHENTLICH", 3), ("2 Tage pro Woche", 2),
        ("1 Tag / Woche", 1), ("3 Tage im Büro", 3), ("2x/Woche", 2), ("2x Woche", 2), ("4xs Woche", None),
        ("flexibel", None), (None, None),
    ], L.hybrid_days)


@pytest.mark.parametrize("model,days,weight", [
    ("remote", None, 0.0), ("remote", 3, 0.0), ("hybrid", 0, 0.2), ("hybrid", 1, 0.2), ("hybrid", 2, 0.5),
    ("hybrid", 3, 0.5), ("hybrid", 4, 0.8), ("hybrid", None, 0.5), ("onsite", None, 1.0), (None, None, 0.6),
    ("sonst", 2, 0.6),
])
def test_weight(spark, model, days, weight):
    frame = spark.createDataFrame([(model, days)], "m string, d int")
    assert frame.select(L.work_model_weight(F.col("m"), F.col("d"))).first()[0] == weight


def test_score(spark):
    cases = [
        (30, 20, "remote", None, 60, 1.0, 0), (30, 20, "onsite", None, 60, 0.9, 20),
        (90, 70, "onsite", None, 60, 0.617, 70), (60, 40, "hybrid", 2, 60, 0.9, 20),
        (None, None, "onsite", None, 60, 0.5, 0), (60, 30, "onsite", None, 60, 0.85, 30),
        (40, None, None, None, 60, 0.88, 24), (50, None, "onsite", None, 30, 0.533, 50),
        (300, None, "onsite", None, 60, 0.0, 300), (40, None, "hybrid", 1, 60, 0.96, 8),
        (0, None, "onsite", None, 60, 1.0, 0),
    ]
    for limit in {c[4] for c in cases}:
        chosen = [c for c in cases if c[4] == limit]
        frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(chosen)], "i int, p int, c int, m string, d int")
        rows = frame.select("i", L.location_score(*[F.col(x) for x in "pcmd"], limit).alias("s")).collect()
        for r in rows:
            want = chosen[r["i"]]
            assert (r["s"]["score"], r["s"]["effective_minutes"]) == want[5:], want
            assert r["s"]["is_remote"] == (want[2] == "remote")
            assert r["s"]["work_model"] == (want[2] or "unknown")


def test_status(spark):
    frame = spark.createDataFrame([(0, None), (None, None), (5, None), (0, 7)], "p int, c int").coalesce(1)
    got = [r[0] for r in frame.select(L.location_status(F.col("p"), F.col("c"))).collect()]
    assert got == ["failed", "failed", "resolved", "resolved"]


def test_targets(spark):
    rows = [("Frankfurt am Main", False), ("Köln", True), ("köln", False), (None, False), ("WIESBADEN", None)]
    frame = spark.createDataFrame(rows, "l string, r boolean").coalesce(1)
    got = [r[0] for r in frame.select(L.matches_targets(F.col("l"), F.col("r"), ["Frankfurt", "Wiesbaden"])).collect()]
    assert got == [True, True, False, False, True]


def test_display_name(spark):
    text = "Kassel, Nord, 34117, Deutschland, 99999"
    many(spark, [(text, "Kassel"), ("", "")], L.display_name_city)
    many(spark, [(text, "34117"), ("Kassel, 1234", None)], L.display_name_postal_code)
