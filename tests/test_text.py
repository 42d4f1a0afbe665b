import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from stellwerk.functions import dates as D
from stellwerk.functions import text as X
from stellwerk.operators import analytics as A


def one(spark, value, build, kind="string"):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(build(F.col("x")).alias("y")).first()["y"]


def many(spark, cases, build, kind="string"):
    rows = [(i, value) for i, (value, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"i int, x {kind}").select("i", build(F.col("x")).alias("y"))
    got = {r["i"]: r["y"] for r in frame.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_normalize(spark):
    many(spark, [
        ("Senior, Python-Developer!", "senior pythondeveloper"),
        ("  viel   leerzeichen  ", "viel leerzeichen"),
        ("München", "münchen"),
        ("München", "münchen"),
        ("Ångström", "ångström"),
        ("Mu\u0308nchen", "münchen"),
        ("\u212bngstro\u0308m", "ångström"),
        ("- x", " x"),
        ("a  b　", "a b"),
        ("C# / C++ (m/w/d)_1²", "c c mwd_1²"),
        ("", ""),
        (None, None),
    ], X.normalize_text)


def test_postal_prefix(spark):
    many(spark, [
        ("34117 Kassel", "Kassel"), ("1010 Wien", "Wien"), ("Frankfurt am Main 60311", "Frankfurt am Main 60311"),
        ("", ""), ("123 Ort", "123 Ort"), ("123456 Ort", "123456 Ort"),
    ], X.strip_postal_prefix)


def test_canonical_id(spark):
    rows = [("Dev", "ACME", "34117 Kassel"), ("dev!", "Acme", "Kassel"), ("Dev", "ACME", None), ("Dev", "ACME", ""),
            ("Dev", "Other", "Kassel"), ("QA", "ACME", "Kassel")]
    ids = [
        r["id"] for r in spark.createDataFrame(rows, "t string, c string, l string").coalesce(1)
        .select(X.canonical_id(F.col("t"), F.col("c"), F.col("l")).alias("id")).collect()
    ]
    assert ids[0] == ids[1] == hashlib.sha256(b"dev|acme|kassel").hexdigest()
    assert ids[2] == ids[3] == hashlib.sha256(b"dev|acme|").hexdigest()
    assert len(set(ids)) == 4 and all(len(x) == 64 for x in ids)


def test_german_dates(spark):
    many(spark, [
        ("03.04.2026 23:59", dt.datetime(2026, 4, 3, 23, 59)), ("15.04.2026", dt.datetime(2026, 4, 15)),
        ("  3.4.2026 9:05 ", dt.datetime(2026, 4, 3, 9, 5)), ("invalid-date", None), ("", None),
        ("31.02.2026", None), ("2026-04-03", None), (None, None),
    ], D.german_timestamp)


def test_rfc2822(spark):
    many(spark, [
        ("Mon, 01 Dec 2025 08:00:00 +0100", dt.datetime(2025, 12, 1, 7)),
        ("1 Dec 2025 08:00:00 GMT", dt.datetime(2025, 12, 1, 8)),
        ("Mon, 1 Dec 2025 08:00 EST", dt.datetime(2025, 12, 1, 13)),
        ("gestern", None), ("", None), (None, None),
    ], D.rfc2822_timestamp)


def test_iso(spark):
    many(spark, [
        ("2025-12-01T10:20:30Z", dt.datetime(2025, 12, 1, 10, 20, 30)),
        ("2025-12-01T10:20:30.0000000", dt.datetime(2025, 12, 1, 10, 20, 30)),
        ("2025-12-01", dt.datetime(2025, 12, 1)), ("kaputt", None), (None, None),
    ], D.iso_timestamp)


def test_recency(spark, as_of):
    now = F.lit(as_of)
    keep = lambda days: lambda c: D.is_recent(D.iso_timestamp(c), now, days)
    many(spark, [(None, True), ("kaputt", True), ("2024-01-01", False), ("2026-03-01", True),
                 ("2026-02-11T12:00:00", True), ("2026-02-10T12:00:00", False), ("2026-02-10T12:00:01", True),
                 ("2027-01-01", True)], keep(30))
    many(spark, [("2024-01-01", True)], keep(0))
    many(spark, [("2024-01-01", True)], keep(None))


def test_week_label(spark):
    days = [dt.datetime(2016, 1, 1) + dt.timedelta(days=i) for i in range(0, 4000, 3)]
    many(spark, [(d, d.strftime("%Y-W%W")) for d in days], D.week_label, "timestamp")


def test_next_departure(spark):
    def departure(c):
        return D.next_departure(c, "tuesday", "08:00")

    many(spark, [
        (dt.datetime(2026, 3, 9, 7), dt.datetime(2026, 3, 10, 8)),
        (dt.datetime(2026, 3, 10, 7), dt.datetime(2026, 3, 17, 8)),
        (dt.datetime(2026, 3, 15, 23), dt.datetime(2026, 3, 17, 8)),
    ], departure, "timestamp")


def test_ids_and_urls(spark):
    from stellwerk.constants import FEED_ID, LISTING_URL_PATTERN

    many(spark, [("https://x.de/a-1111111.html", "1111111"), ("https://x.de/T--2222222.HTML", "2222222"),
                 ("https://x.de/ohne.html", None), (None, None)], lambda c: X.extract(c, FEED_ID))
    many(spark, [("https://x.de/job/77-a/", "77"), ("https://x.de/12/abc", None)], X.last_segment_digits)
    many(spark, [("/stellenanzeige/42/", "42"), ("/x/42/", None)], lambda c: X.extract(c, LISTING_URL_PATTERN))
    many(spark, [("https://u@x.de:81/p?q=1#f", "https://u@x.de:81"), ("http://x.de", "http://x.de")], X.base_url)
    many(spark, [("a--12345678-inline.html", "12345678"), ("a-12345-x", None)], A.numeric_url_id)


def test_title_split(spark):
    many(spark, [("Dev - Java - ACME GmbH", "Dev - Java"), ("Dev", "Dev")], lambda c: X.split_title_company(c)[0])
    many(spark, [("Dev - Java - ACME GmbH", "ACME GmbH"), ("Dev", "Unbekannt")], lambda c: X.split_title_company(c)[1])


def test_salary_text(spark):
    assert one(spark, 55000.9, lambda c: X.salary_text(c, c + 20000), "double") == "55.000 – 75.000 EUR"
    assert one(spark, None, lambda c: X.salary_text(c, F.lit(1.0)), "double") is None


def test_completeness_and_ratio(spark):
    many(spark, [(None, "NULL"), ("", "leer"), ("x" * 49, "sehr_kurz (<50)"), ("x" * 50, "ok")], X.completeness_class)
    many(spark, [(0, 0.0), (3, 33.33)], lambda c: X.percent(F.lit(1), c), "int")
    many(spark, [("public", "public"), ("Öffentlicher Dienst", "public"), ("Koch", None)], X.sector_norm)


@pytest.mark.parametrize("keywords,want", [(["chef"], "chef"), (["xyz", "ARZT"], "ARZT"), ([], None)])
def test_keyword_exclusion(spark, keywords, want):
    frame = spark.createDataFrame([("Chefarzt",)], "title string")
    if not keywords:
        keywords = ["nie"]
    assert A.exclude_by_keyword(frame, keywords, F.col("title")).first()["excluded_by"] == want


def test_strip_takes_what_the_pattern_of_white_space_takes(spark):
    from stellwerk.constants import WS

    texts = [(f"{chr(i)}{chr(i)}a{chr(i)}b{chr(i)}",) for i in range(1, 0x3100)]
    chars = spark.createDataFrame(texts, "c string")
    other = chars.where(~X.strip(F.col("c")).eqNullSafe(F.regexp_replace("c", f"^{WS}+|{WS}+$", "")))
    assert other.count() == 0
    assert "regexp_replace" not in str(X.strip(F.col("c")))
