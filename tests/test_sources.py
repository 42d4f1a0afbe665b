import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from stellwerk import schemas
from stellwerk.functions import html as H
from stellwerk.sources import encoded_pages, feeds, html_lists, json_lists, landed, lookup_payloads
from stellwerk.sources.registry import PARSERS, parse_source, union_sources

FEED = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Stellen</title>
<item><title>Sachbearbeitung</title><link>https://b.de/IMP/A--1111111.html#track=feed-jobs</link>
<guid isPermaLink="true">https://b.de/IMP/A--1111111.html</guid><pubDate>Wed, 11 Mar 2026 08:00:00 +0100</pubDate>
<description><![CDATA[Arbeitgeber: <strong>Landesbetrieb (LLH)</strong><br/>Ort: <strong>34117 Kassel</strong><br/>
Bewerbungsfrist: <strong>03.04.2026 23:59</strong>]]></description></item>
<item><title>Referent</title><guid>https://b.de/IMP/B--2222222.html</guid><pubDate>Tue, 10 Mar 2026 08:00:00 +0100</pubDate>
<description><![CDATA[ort: <strong>Bonn</strong>]]></description></item>
<item><title>Alt</title><guid>https://b.de/IMP/C--3333333.html</guid><pubDate>Mon, 01 Jan 2024 08:00:00 +0100</pubDate></item>
<item><title>Kopie</title><guid>https://b.de/IMP/A--1111111.html</guid></item>
<item><guid>https://b.de/IMP/D--4444444.html</guid></item>
</channel></rss>"""


def _landed(spark, *rows):
    full = [("s", key, page, None, payload) for key, page, payload in rows]
    return spark.createDataFrame(full, schemas.LANDED)


def _by(rows, key):
    return {r[key]: r for r in rows}


def test_labelled_feed(spark, as_of):
    items = feeds.feed_items(_landed(spark, ("f", 0, FEED), ("f", 1, "kein XML"), ("f", 2, "<rss><channel/></rss>")))
    got = _by(feeds.parse_labelled_feed(items, F.lit(as_of), 30).collect(), "source_job_id")
    assert set(got) == {"1111111", "2222222"}
    first = got["1111111"]
    assert (first["title"], first["company_name"], first["location_raw"]) == ("Sachbearbeitung", "Landesbetrieb (LLH)", "34117 Kassel")
    assert first["deadline"] == dt.datetime(2026, 4, 3, 23, 59) and "#track" not in first["url"]
    assert (first["sector"], first["source_name"], first["source_type"]) == ("public", "service_bund", "portal")
    second = got["2222222"]
    assert (second["company_name"], second["location_raw"], second["deadline"]) == ("Unbekannt", "Bonn", None)
    assert feeds.parse_labelled_feed(items, F.lit(as_of), 0).count() == 3


def test_feed_files(spark, as_of, tmp_path):
    (tmp_path / "it.xml").write_text(FEED, encoding="utf-8")
    items = feeds.read_feed_files(spark, str(tmp_path))
    assert {r["search_key"] for r in items.collect()} == {"it"} and items.count() == 5
    got = feeds.parse_labelled_feed(items, F.lit(as_of), 30)
    assert {r["title"] for r in got.collect()} == {"Sachbearbeitung", "Referent"}


def test_category_feeds(spark, as_of):
    item = "<item><title>{t}</title><link>https://c.de/{u}</link><description>{d}</description></item>"
    def feed(*items):
        return "<rss><channel>" + "".join(items) + "</channel></rss>"
    first = feed(item.format(t="Dev - Java - ACME", u="job-77-x/", d="&lt;p&gt;A &amp;amp; B&lt;/p&gt;"))
    second = feed(item.format(t="Anders - Y", u="job-77-x/", d=""), item.format(t="Koch", u="z", d=""))
    items = feeds.feed_items(_landed(spark, ("design", 0, second), ("consulting", 0, first)))
    got = _by(feeds.parse_category_feeds(items, F.lit(as_of), 30).collect(), "url")
    both = got["https://c.de/job-77-x/"]
    assert (both["title"], both["company_name"], both["raw_text"], both["source_job_id"]) == ("Dev - Java", "ACME", "A & B", "77")
    assert got["https://c.de/z"]["company_name"] == "Unbekannt" and got["https://c.de/z"]["raw_text"] is None


def test_json_sources(spark, as_of):
    now = F.lit(as_of)
    agency = {"stellenangebote": [{"titel": "Koch", "refnr": "r1", "arbeitsort": {"ort": "Köln", "plz": "50667"},
                                   "aktuelleVeroeffentlichungsdatum": "2026-03-01", "beruf": "Koch/Köchin"},
                                  {"titel": "x"}, {"refnr": "y"}], "maxErgebnisse": 3}
    detail = _landed(spark, ("r1", 0, json.dumps({"stellenbeschreibung": "  Text  "})))
    (row,) = json_lists.parse_agency(_landed(spark, ("a", 0, json.dumps(agency)), ("a", 1, "{kaputt")), detail).collect()
    assert (row["location_raw"], row["company_name"], row["raw_text"], row["sector"]) == ("50667 Köln", "Unbekannt", "Text", "Koch/Köchin")
    assert row["url"].endswith("/jobdetail/r1") and row["published_at"] == dt.datetime(2026, 3, 1)

    stamp = int(dt.datetime(2026, 3, 12, tzinfo=dt.timezone.utc).timestamp())
    board = {"data": [
        {"title": "A", "url": "u1", "slug": "s1", "company_name": "", "location": "Berlin", "remote": True, "created_at": stamp,
         "description": "<b>x</b>&amp;"},
        {"title": "B", "url": "u2", "location": "Frankfurt", "remote": False, "created_at": stamp - 10 * 86400},
        {"title": "C", "url": "u3", "location": "Bad Frankfurt", "remote": False},
        {"title": "D", "url": "u4", "location": "Rom", "remote": False, "created_at": stamp}]}
    got = _by(json_lists.parse_open_board(_landed(spark, ("a", 0, json.dumps(board))), now, 2).collect(), "title")
    assert set(got) == {"A", "C"}
    assert (got["A"]["work_model"], got["A"]["company_name"], got["A"]["raw_text"]) == ("remote", "", "x &")
    assert (got["C"]["company_name"], got["C"]["raw_text"]) == ("Unbekannt", "")

    paged = {"results": [{"title": "A", "redirect_url": "u", "id": 7, "company": {"display_name": "X"}, "location": {},
                          "salary_min": 55000.5, "salary_max": 75000, "created": "2026-03-01T10:00:00Z", "description": ""}]}
    (row,) = json_lists.parse_paged_search(_landed(spark, ("a", 0, json.dumps(paged)))).collect()
    assert (row["source_job_id"], row["salary_raw"], row["location_raw"], row["raw_text"]) == ("7", "55.000 – 75.000 EUR", None, None)
    assert row["published_at"] == dt.datetime(2026, 3, 1, 10)

    snips = {"jobs": [{"title": " A ", "link": "u", "id": -3, "company": "", "location": "", "snippet": "s", "updated": "2026-03-12T00:00:00.0000000"},
                      {"title": "B", "link": "v", "updated": "2026-01-01"}, {"title": "C", "link": ""}]}
    (row,) = json_lists.parse_snippets(_landed(spark, ("a", 0, json.dumps(snips))), now, 7).collect()
    assert (row["title"], row["company_name"], row["location_raw"], row["raw_text"]) == ("A", "Unbekannt", None, "s")
    assert landed.unreadable(_landed(spark, ("a", 0, "{"), ("b", 0, "{}")), json_lists.SNIPPETS).count() == 1


def _page(offers, more=False):
    text = json.dumps({"searchResults": {"jobOffers": offers}, "canPageMore": more}, ensure_ascii=False)
    data = {"props": {"pageProps": {"__PPA__": [ord(c) for c in text]}}}
    return f"<html><script type='x'>1</script><script id=\"__NEXT_DATA__\" type='application/json'>{json.dumps(data)}</script></html>"


def test_encoded_pages(spark, as_of):
    base = {"title": "Pflege – 😀", "offerOriginalUrl": "o", "offerUrl": "p", "companyName": "X", "location": "Kassel",
            "lastChange": "2026-03-12T08:00:00Z", "firstFound": "2026-01-01", "documentId": 5, "teaser": "kurz"}
    fallback = {**base, "offerOriginalUrl": None, "companyName": None, "teaser": "", "lastChange": None, "firstFound": None}
    dropped = [{**base, "title": ""}, {**base, "offerOriginalUrl": "", "offerUrl": None},
               {**base, "offerOriginalUrl": "q", "lastChange": "2026-02-01", "firstFound": "2026-03-12"}]
    frame = {**base, "offerOriginalUrl": "https://www.kimeta.de/iframe/9", "teaser": ""}
    rows = _landed(spark, ("k", 0, _page([base, fallback, *dropped], True)), ("k", 1, _page([{**base, "title": "zweite"}, frame], True)),
                   ("l", 0, _page([base])), ("m", 0, "<html>nichts</html>"))
    details = _landed(spark, ("https://www.kimeta.de/iframe/9", 0, "<body><main>" + "wort " * 40 + "</main></body>"), ("o", 0, "<body>nein</body>"))
    got = encoded_pages.parse_encoded_pages(rows, F.lit(as_of), 7, details).collect()
    assert sorted((r["search_key"], r["url"]) for r in got) == [("k", "https://www.kimeta.de/iframe/9"), ("k", "o"), ("k", "p"), ("l", "o")]
    by = {(r["search_key"], r["url"]): r for r in got}
    assert by["k", "o"]["title"] == "Pflege – 😀" and by["k", "o"]["raw_text"] == "kurz" and by["k", "o"]["source_job_id"] == "5"
    assert by["k", "p"]["company_name"] == "Unbekannt" and by["k", "p"]["raw_text"] is None and by["k", "p"]["published_at"] is None
    assert by["k", "https://www.kimeta.de/iframe/9"]["raw_text"].startswith("wort wort")
    assert [tuple(r) for r in encoded_pages.incomplete_searches(rows).collect()] == [("k", 1)]


def test_filter_links():
    html = """<a class="jsx-1 pos" rel="nofollow" href="/s?loc=F&amp;pf=position%40Consultant%20(m%2Fw%2Fd)&amp;page=0">a</a>
    <a class="pos" rel="nofollow" href="/s?pf=position%40Consultant%20(m%2Fw%2Fd)">doppelt</a>
    <a class="pos" rel="nofollow" href="/s?pf=area%40IT+X">b</a><a class="neg" rel="nofollow" href="/s?pf=z">c</a>
    <a class="pos" href="/s?pf=y">d</a><a class="pos" rel="nofollow" href="/s?loc=F">e</a>"""
    assert H.find_filter_links(html) == ["position@Consultant (m/w/d)", "area@IT+X"]


def test_html_text():
    assert H.strip_tags("<p>A &amp; B</p><script>x</script><!-- c --> <b>C</b>&nbsp;D &lt;i&gt;E&lt;/i&gt;") == "A & B C D E"
    assert H.strip_tags("offen <b>fett <i>beides</b> weiter") == "offen fett beides weiter"
    long, body = "wort " * 30, "<body>Rand <article>kurz</article><main>{}</main></body>"
    assert H.find_main_text(body.format(long), [".x", "article", "main"]) == long.strip()
    assert H.find_main_text(body.format("y"), ["article", "main"]) == "Rand kurz y"
    assert H.find_main_text(body.format("y"), ["article", "main"], strict=True) is None
    assert H.find_main_text("<p>ohne</p>", ["main"]) is None


def test_listings(spark):
    box = '<div class="a stellenanzeige"><h2><a href="{h}"> Koch <b>Chef</b></a></h2><p>ACME</p> <p>Köln</p></div>'
    html = box.format(h="/stellenanzeige/42/") + box.format(h="https://andere.de/x") + '<div class="stellenanzeige">leer</div>'
    again = '<article><a href="https://www.xn--jobbrse-d1a.de/stellenanzeige/42/">Zweite</a></article><article><a href="/stellenanzeige/43/">Nur Titel</a></article>'
    details = _landed(spark, ("https://www.xn--jobbrse-d1a.de/stellenanzeige/42/", 0, "<body>kurzer Text</body>"))
    got = _by(html_lists.parse_listings(_landed(spark, ("Kassel", 0, html), ("Kassel", 1, again)), details).collect(), "source_job_id")
    assert set(got) == {"42", "43"}
    first = got["42"]
    # The title pieces are joined without blanks, so single pieces stay in the texts.
    assert (first["title"], first["company_name"], first["location_raw"]) == ("KochChef", "Koch", "Chef")
    assert first["raw_text"] == "kurzer Text"
    assert (got["43"]["company_name"], got["43"]["location_raw"]) == ("Unbekannt", "Kassel")


def test_table_pages(spark, as_of):
    def row(i, **cells):
        return f"<tr class='ia-e-table__row x'><td data-field='StellenangebotId'><span>{i}</span></td>" + "".join(
            f"<td data-field='{k}'> {v} </td>" for k, v in cells.items()) + "</tr>"
    html = "<table>" + row("Nr", Stellenbezeichnung="Kopf") + row("7", Stellenbezeichnung="Amt", Von="12.03.2026", Bewerbungsfrist="01.04.2026", PLZOrte="34117 Kassel") \
        + row("7", Stellenbezeichnung="Amt doppelt") + row("8", Stellenbezeichnung="Alt", Von="01.01.2024") + row("9") + "</table>"
    (got,) = html_lists.parse_table_pages(_landed(spark, ("t", 0, html)), F.lit(as_of), 2).collect()
    assert (got["title"], got["company_name"], got["location_raw"], got["source_job_id"]) == ("Amt", "Unbekannt", "34117 Kassel", "7")
    assert got["url"].endswith("stelle?id=7") and got["deadline"] == dt.datetime(2026, 4, 1) and got["sector"] == "Öffentlicher Dienst"


def test_lookup_payloads(spark):
    def leg(a, b):
        return {"departure": f"2026-03-10T{a}:00+01:00", "arrival": f"2026-03-10T{b}:00+01:00"}
    payloads = {
        "one": {"journeys": [{"legs": [leg("08:00", "08:20"), leg("08:25", "08:45")]}]},
        "three": {"journeys": [{"legs": [leg("08:00", "09:30")]}, {"legs": []}, {"legs": [leg("08:00", "08:40")]}, {"legs": [leg("08:00", "09:00")]}]},
        "none": {"journeys": []}, "empty": {},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads.items()], "k string, p string")
    got = {r["k"]: r["m"] for r in frame.select("k", lookup_payloads.journey_minutes(F.col("p")).alias("m")).collect()}
    assert got == {"one": 45, "three": 40, "none": None, "empty": None}

    routes = [("ok", {"code": "Ok", "routes": [{"duration": 2700.0}, {"duration": 1.0}]}), ("bad", {"code": "NoRoute"}), ("leer", {"code": "Ok", "routes": []})]
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in routes], "k string, p string")
    got = {r["k"]: r["m"] for r in frame.select("k", lookup_payloads.route_minutes(F.col("p")).alias("m")).collect()}
    assert got == {"ok": 45, "bad": None, "leer": None}

    hits = [("a", [{"lat": "51.3", "lon": "9.5", "display_name": "Kassel"}, {"lat": "1", "lon": "1", "display_name": "x"}]), ("b", []), ("c", [{"lat": "x", "lon": "9", "display_name": "y"}])]
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in hits], "k string, p string")
    got = {r["k"]: r["g"] for r in frame.select("k", lookup_payloads.geocode_hit(F.col("p")).alias("g")).collect()}
    assert (got["a"]["lat"], got["a"]["lng"], got["a"]["display_name"]) == (51.3, 9.5, "Kassel") and got["b"] is None and got["c"] is None


def test_imprint(spark):
    pages = [
        ("full", "<body><h1>Impressum</h1><p>ACME</p><p>Hauptstraße 42</p><p>10115 Berlin</p></body>"),
        ("far", "<p>Hauptstraße 42</p><p>a</p><p>b</p><p>c</p><p>10115 Berlin</p>"),
        ("none", "<p>Kontakt 123</p>"), ("city", "<p>60311 Frankfurt am Main</p>"), ("same", "<p>Am Ring, Parkweg 3 a 34117 Kassel</p>"),
    ]
    frame = spark.createDataFrame(pages, "k string, payload string")
    got = {r["k"]: r["address"] and tuple(r["address"]) for r in lookup_payloads.with_imprint_address(frame).collect()}
    assert got == {"full": ("Hauptstraße 42", "10115", "Berlin"), "far": (None, "10115", "Berlin"), "none": None,
                   "city": (None, "60311", "Frankfurt am"), "same": ("Parkweg 3 a", "34117", "Kassel")}


def test_registry_and_sequence(spark, as_of, tmp_path):
    bronze = _landed(spark, ("f", 0, FEED)).withColumn("source_name", F.lit("service_bund")).unionByName(
        _landed(spark, ("j", 0, json.dumps({"jobs": [{"title": "A", "link": "u"}, {"title": "B", "link": "v"}]}))).withColumn("source_name", F.lit("jooble")))
    bronze.write.partitionBy("source_name").parquet(str(tmp_path / "bronze"))
    parts = [parse_source(name, landed.read_landed(spark, str(tmp_path / "bronze"), name), F.lit(as_of), 30) for name in PARSERS]
    numbered = landed.with_sequence(union_sources(parts)).orderBy("seq").collect()
    assert [r["seq"] for r in numbered] == [1, 2, 3, 4]
    in_order = [("service_bund", "Sachbearbeitung"), ("service_bund", "Referent"), ("jooble", "A"), ("jooble", "B")]
    assert [(r["source_name"], r["title"]) for r in numbered] == in_order
    asked = landed.with_sequence(union_sources(parts), ["jooble", "service_bund"]).orderBy("seq").collect()
    assert [(r["source_name"], r["title"]) for r in asked] == in_order[2:] + in_order[:2]


GOOD_FEED = "<rss><channel><title>t</title><item><title>{}</title><link>https://a.example/1</link><guid>https://a.example/1</guid>" \
            "<pubDate>Thu, 12 Mar 2026 08:00:00 +0000</pubDate></item></channel></rss>"


@pytest.mark.parametrize(
    "name,good,bad,broken",
    [
        ("adzuna", '{"results": [{"title": "A", "redirect_url": "u"}, {"title": "", "redirect_url": "v"}]}', 1, ['{"results": [', "[1]", "", None]),
        ("jooble", '{"jobs": [{"title": "A", "link": "u", "updated": "2026-03-12T00:00:00"}, {"title": "B", "updated": "2026-03-12T00:00:00"}]}', 1, ["<html>", "null"]),
        ("arbeitnow", '{"data": [{"title": "A", "url": "u", "remote": true}, {"title": "", "url": "w", "remote": true}]}', 1, ["nothing"]),
        ("service_bund", GOOD_FEED.format("A"), 0, ["{}", "<rss><other/></rss>", ""]),
        ("service_bund", GOOD_FEED.format(" "), 1, ["no feed"]),
        ("jobboerse", "<html><body>empty</body></html>", 0, ["", None, "plain"]),
        ("kimeta", "<html></html>", None, ["", "<html></html>"]),
    ],
)
def test_errors_cost_their_own_rows_only(spark, as_of, name, good, bad, broken):
    from stellwerk.operators.runs import run_stats
    from stellwerk.sources import isolation

    responses = [("ok", 0, good)] if bad is not None else []
    landed = _landed(spark, *responses, *[("x", i, b) for i, b in enumerate(broken)])
    alone = parse_source(name, _landed(spark, *responses), F.lit(as_of)).count() if responses else 0
    parsed = isolation.parse_isolated(name, landed, F.lit(as_of))
    assert parsed.postings.count() == alone
    rejects = parsed.rejects.collect()
    assert {(r.search_key, r.page) for r in rejects if r.reason == isolation.UNREADABLE} == {("x", i) for i in range(len(broken))}
    assert sum(r.reason == isolation.INCOMPLETE for r in rejects) == (bad or 0)
    outcomes = parsed.postings.select("source_name", F.lit("new").alias("outcome"))
    (stats,) = run_stats(isolation.with_errors(outcomes, parsed.rejects), "source_name").collect()
    assert (stats.fetched, stats.new, stats.errors) == (alone + (bad or 0), alone, (bad or 0) + len(broken))
    failed = isolation.failed_sources(landed.withColumn("source_name", F.lit(name)), parsed.rejects)
    assert failed == ([] if responses else [name])


def test_code_points_become_text_without_a_lambda_per_point(spark):
    def page(points):
        return f'<script type="a" id="__NEXT_DATA__">{{"props": {{"pageProps": {{"__PPA__": {points}}}}}}}</script></script>'

    pages = [page("[72, 228, 128512]"), page("[55357, 56832, 65]"), page("[65279, 66, 55357]"), page("[67, null, 68]"), page("[]"), page("null"),
             '<script id="__NEXT_DATA__">{"props": 1}', "<p>no script</p>", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, payload string")
    found = rows.select("i", encoded_pages.decode_page(F.col("payload")).alias("text"))
    assert [r.text for r in found.orderBy("i").collect()] == ["Hä😀", "😀A", "B?", "CD", "", None, None, None, None]
    assert "lambdafunction" not in found._jdf.queryExecution().executedPlan().toString()


def test_filter_links_are_parsed_in_many_tasks(spark, tmp_path):
    from stellwerk.plans.catalog import QUERIES

    spark.range(40).selectExpr("id AS p_partkey", "'a b' AS p_name", "'B' AS p_brand", "'T' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["filter_link_values"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    assert {r.pf for r in found.collect()} == {"position@a b (m/w/d)+|contract@B|area@T"}


def test_only_staying_category_items_are_read_as_html(spark):
    item = "<item><title>A - B</title><link>https://x.example/job/7/</link><description>&lt;p&gt;Eins&lt;/p&gt;</description></item>"
    landed = spark.createDataFrame([("it", 1, f"<rss><channel>{item * 3}</channel></rss>")], "search_key string, page long, payload string")
    rows = feeds.parse_category_feeds(feeds.feed_items(landed), F.lit("2026-01-01").cast("timestamp"), None)
    assert [(r.title, r.raw_text) for r in rows.collect()] == [("A", "Eins")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate")
