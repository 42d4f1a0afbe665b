"""Source queries over small tables of the tests' own."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from __spark_entry__ import queries
from stellwerk.functions import dates as D
from stellwerk.sources import encoded_pages, feeds


def written(folder, lines):
    """Tables of the given positions (order, part, supplier, line, flag, status, shipped); part 3 and supplier 3 have odd names."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us")]
    columns = {n: pa.array([r[i] for r in lines], k) for i, (n, k) in enumerate(zip(names, kinds))}
    rest = {n: pa.array([v] * len(lines), pa.float64()) for n, v in (("l_quantity", 5.0), ("l_extendedprice", 123.5), ("l_discount", 0.0), ("l_tax", 0.0))}
    pq.write_table(pa.table({**columns, **rest}), f"{folder}/lineitem.parquet")
    part = {"p_partkey": [1, 2, 3], "p_name": ["red lamp", "blue & co", "Ünï <b> - x"], "p_brand": ["B"] * 3, "p_type": ["T"] * 3, "p_size": [1, 2, 3]}
    pq.write_table(pa.table(part), f"{folder}/part.parquet")
    supplier = {"s_suppkey": [1, 2, 3], "s_name": ["S#1", "S & 2", None], "s_nationkey": [0, 0, 0], "s_acctbal": [1.0] * 3}
    pq.write_table(pa.table(supplier), f"{folder}/supplier.parquet")
    pq.write_table(pa.table({"n_nationkey": [0], "n_name": ["NATION_0"], "n_regionkey": [0]}), f"{folder}/nation.parquet")
    return str(folder)


DAY = dt.datetime(1999, 6, 1)


def test_listing_pages_are_built_of_what_stays(spark, tmp_path):
    rows = [(1, 1, 1, 1, "R", "F", DAY), (1, 1, 1, 1, "R", "F", DAY), (1, 1, 2, 1, "A", "F", DAY), (2, 2, 2, 1, "N", "O", DAY), (3, 1, 1, 2, "A", "F", DAY)]
    frame = queries()["source_listings"](spark, written(tmp_path, rows))
    found = sorted((r.source_job_id, r.title, r.company_name, r.location_raw, (r.raw_text or "")[:11]) for r in frame.collect())
    assert found == [
        ("111", "red lamp", "S & 2", "00002 NATION_0", "Gute Stelle"), ("212", "blue & co", "Unbekannt", "2", ""),
        ("321", "red lamp", "S#1", "00001 NATION_0", "Gute Stelle"),
    ]
    # The aggregate over positions reads columns; pages were part of it before.
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    narrow = [line for line in plan.splitlines() if "Aggregate [search_key" in line and "part_id" in line]
    assert narrow and not any("payload" in line for line in narrow)


def test_feed_dates_are_read_once_by_a_filter(spark):
    feed = "<rss><channel><item><title>t - c</title><link>http://x/{0}</link><pubDate>{1}</pubDate></item></channel></rss>"
    dates = ["Mon, 31 May 1999 10:00:00 GMT", "31 May 1999 10:00 +0200", "Mon, 31 May 1999 10:00:00 XYZ", "Mon, 01 Jan 1990 10:00:00 GMT", "no date", ""]
    rows = spark.createDataFrame([("it", i, feed.format(i, d)) for i, d in enumerate(dates)], "search_key string, page long, payload string")
    items = feeds.feed_items(rows)
    as_of = F.lit("2000-01-01 00:00:00").cast("timestamp")
    kept = items.where(D.is_recent(D.rfc2822_timestamp(F.col("pubDate")), as_of, 365))
    assert sorted(r.page for r in kept.collect()) == [0, 1, 2, 4, 5]
    read = D.rfc2822_timestamp(F.col("pubDate"))
    assert [str(r[0]) for r in items.orderBy("page").select(read).collect()] == ["1999-05-31 10:00:00", "1999-05-31 08:00:00", "1999-05-31 10:00:00", "1990-01-01 10:00:00", "None", "None"]
    # A filter computes whatever its condition spells out twice twice: the trimming stood there some twenty times.
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1


def test_category_feeds_and_their_union(spark, tmp_path):
    rows = [(1, 1, 1, 1, "R", "F", DAY), (1, 1, 2, 2, "A", "F", DAY), (2, 1, 2, 1, "N", "O", dt.datetime(1990, 1, 1)), (3, 1, 3, 1, "A", "F", DAY)]
    folder = written(tmp_path, rows)
    found = [tuple(r) for r in queries()["source_category_feeds"](spark, folder).collect()]
    assert found == [("red lamp", "R", "https://cat.example/job/1/", "1", "Teil 1 & mehr")]
    merged = {r.source_name: tuple(r)[2:] for r in queries()["union_of_sources"](spark, folder).collect()}
    # A feed without employer has no payload; a snippet without one has the default.
    assert merged == {"service_bund": (2, 2, 1, 2), "jooble": (3, 3, 3, 5)}


def test_code_points_written_and_read(spark, tmp_path, monkeypatch):
    texts = ["a", "äß–", "😀 x", "", None, "z" * 5000, "\x00,\n"]
    monkeypatch.setattr(encoded_pages, "PASS_CHARS", 3)
    column = pa.array(texts, pa.string())
    written_points = encoded_pages.points_of_text.func(column).to_pylist()
    assert written_points == [None if t is None else ",".join(str(ord(c)) for c in t) for t in texts]
    rows = [(1, 3, 1, 1, "A", "F", DAY), (2, 2, 2, 1, "R", "F", DAY), (3, 1, 1, 1, "N", "O", dt.datetime(1990, 1, 1))]
    frame = queries()["source_encoded_pages"](spark, written(tmp_path, rows))
    found = sorted((r.title, r.url, (r.raw_text or "")[:5]) for r in frame.collect())
    assert found == [
        ("blue & co – Ü", "https://original.example/2-2-123-21.html", "Kurz"), ("Ünï <b> - x – Ü", "https://www.kimeta.de/iframe/3-1-123-11", "Lang "),
    ]
    assert "ascii(" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_searched_once_for_its_script(spark):
    begin, end, data = '<script id="__NEXT_DATA__" type="application/json">', "</script>", '{"props":{"pageProps":{"__PPA__":[72,228]}}}'
    pages = {
        begin + data + end: "Hä", "a" + end + begin + data + end + "b": "Hä", begin + data + end + begin + end: "Hä", begin + data + "\n" + end: "Hä",
        "": None, begin: None, begin + end: None, begin + end + begin + data + end: None, begin + " " + end: None, begin + data: None, begin + "{}" + end: None,
    }
    rows = spark.createDataFrame([(p,) for p in (*pages, None)], "payload string")
    found = rows.select("payload", encoded_pages.decode_page(F.col("payload")).alias("text"))
    assert {r.payload: r.text for r in found.collect()} == {**pages, None: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("NEXT_DATA") == 1
