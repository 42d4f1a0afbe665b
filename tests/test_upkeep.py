import datetime as dt
import random

from pyspark.sql import functions as F

from stellwerk import schemas
from stellwerk.operators import addresses as AD
from stellwerk.operators import backfill as B
from stellwerk.operators import filters as W
from stellwerk.operators import lookups as J
from stellwerk.operators import maintenance as M
from stellwerk.operators import runs as R
from stellwerk.plans.scoring import batch_view, score_jobs
from stellwerk.session import cut_lineage
from stellwerk.streaming import cache_timers as T
from stellwerk.streaming import incremental as S
from test_identity import FIELDS, _batch

NOW = dt.datetime(2026, 3, 13, 12)


def _at(**delta):
    return NOW + dt.timedelta(**delta)


def test_expiry(spark):
    rows = [(1, _at(days=-1), True, "new"), (2, _at(days=1), True, "new"), (3, None, True, "new"),
            (4, _at(days=-1), True, "applying"), (5, _at(days=-1), False, "new"), (6, NOW, True, "new")]
    jobs = spark.createDataFrame(rows, "id long, deadline timestamp, is_active boolean, status string")
    got = {r["id"]: (r["status"], r["is_active"], r["expired_now"]) for r in M.expire(jobs, F.lit(NOW)).collect()}
    assert got[1] == ("expired", False, True) and got[4] == ("applying", True, False)
    assert [got[i][2] for i in (2, 3, 5, 6)] == [False] * 4 and got[5] == ("new", False, False)


def test_cache(spark):
    cache = spark.createDataFrame([], schemas.TRANSIT_CACHE)
    def fresh(company, minutes):
        return spark.createDataFrame([(company, "h", minutes, "db_rest")], "company_id long, origin_hash string, transit_minutes int, api_used string")
    cache = M.upsert_cache(cache, fresh(1, 30), F.lit(NOW))
    cache = M.upsert_cache(cache, fresh(2, 42), F.lit(NOW), ttl_days=0)
    cache = M.upsert_cache(cache, fresh(1, 55), F.lit(NOW))
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "company_id long")
    got = {r["company_id"]: r["cached_minutes"] for r in J.with_cached_minutes(jobs, cache, "h", F.lit(NOW)).collect()}
    assert got == {1: 55, 2: None, 3: None}
    later = J.with_cached_minutes(jobs, cache, "h", F.lit(_at(days=91))).collect()
    assert all(r["cached_minutes"] is None for r in later)


def test_assign_ids_is_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("seq"))
    got = sorted((r["seq"], r["id"]) for r in M.assign_ids(rows, "seq", 10).collect())
    assert [i for _, i in got] == list(range(11, 1011))


def test_filters(spark):
    rows = [(1, "unknown", True, "new"), (2, "resolved", True, "new"), (3, "unknown", False, "new"), (4, "unknown", True, "expired"), (5, "unknown", True, "ignored")]
    jobs = spark.createDataFrame(rows, "id long, location_status string, is_active boolean, status string")
    assert [r["id"] for r in W.scoring_candidates(jobs).collect()] == [1]
    companies = spark.createDataFrame([(1, "A", "unknown"), (2, "B", "found"), (3, "C", "failed")], "id long, name string, address_status string")
    assert [tuple(r) for r in W.address_candidates(companies, 5).collect()] == [(1, "A")]
    stamped = spark.createDataFrame([(1, _at(days=-3)), (2, _at(days=-1)), (3, None)], "id int, t timestamp")
    assert {r["id"] for r in W.newer_than(stamped, "t", F.lit(NOW), 2).collect()} == {2, 3}
    assert {r["id"] for r in W.newer_than(stamped, "t", F.lit(NOW), 0).collect()} == {3}
    links = spark.createDataFrame([(1, "u")], "job_id long, url string")
    assert J.orphans(links, "job_id", jobs).count() == 0 and J.orphans(links, "job_id", companies.where("id > 1")).count() == 1


def _companies(spark):
    rows = [(1, "Bekannt", "found", 51.0, 9.0), (2, "Impressum", "unknown", None, None), (3, "Web", "unknown", None, None),
            (4, "Ort", "failed", None, None), (5, "Nichts", "unknown", None, None), (6, "Null", "found", 0.0, 9.0)]
    frame = spark.createDataFrame(rows, "id long, name string, address_status string, lat double, lng double")
    return frame.withColumns({c: F.lit(None).cast("string") for c in ("address_street", "address_city", "address_zip", "address_source")})


def _resolved(spark):
    wanted = spark.createDataFrame([(1, "Kassel"), (2, "Kassel"), (3, None), (4, "Kassel"), (5, "Nirgends"), (6, None), (None, "Kassel")], "company_id long, location_raw string")
    page = "company_id long, rank int, payload string"
    imprint = spark.createDataFrame([(1, 0, "<p>10115 Berlin</p>"), (2, 0, "<p>leer</p>"), (2, 1, "<p>Parkweg 3</p><p>34117 Kassel</p>"), (2, 2, "<p>10115 Berlin</p>")], page)
    search = spark.createDataFrame([(2, 0, "<p>10115 Berlin</p>"), (3, 0, "<p>10115 Berlin</p>")], page)
    geo = spark.createDataFrame([("Parkweg 3, 34117 Kassel", '[{"lat":"51.3","lon":"9.5","display_name":"x"}]'), ("Kassel", '[{"lat":"51.2","lon":"9.4","display_name":"Kassel, 34117, D"}]'), ("Nirgends", "[]")], "search_key string, payload string")
    return AD.resolve_addresses(wanted, _companies(spark), imprint, search, geo)


def test_address_order(spark):
    resolved = _resolved(spark)
    got = {r["id"]: r["address"] and (r["address"]["source"], r["address"]["street"], r["address"]["zip_code"], r["address"]["city"], r["address"]["lat"]) for r in resolved.collect()}
    assert got == {1: ("db", None, None, None, 51.0), 2: ("impressum", "Parkweg 3", "34117", "Kassel", 51.3),
                   3: ("searxng", None, "10115", "Berlin", None), 4: ("nominatim", None, "34117", "Kassel", 51.2),
                   5: None, 6: ("db", None, None, None, 0.0)}
    after = {r["id"]: (r["address_status"], r["address_source"]) for r in M.update_addresses(_companies(spark), resolved).collect()}
    assert after[2] == ("found", "impressum") and after[5] == ("failed", None) and after[4] == ("found", "nominatim")


def test_scoring(spark):
    rows = [(1, 1, "Remote", None, None), (2, 1, "Kassel", "remote", None), (3, 1, "Kassel", None, "100% remote"),
            (4, 1, "Kassel", "onsite", None), (5, 2, "Kassel", "hybrid", "2 Tage im Büro"), (6, 5, "Kassel", "onsite", None),
            (7, 6, "Kassel", None, ""), (8, None, "Kassel", "onsite", None)]
    jobs = spark.createDataFrame(rows, "id long, company_id long, location_raw string, work_model string, raw_text string")
    from stellwerk.functions.text import origin_hash
    cache = spark.createDataFrame([(1, 42, _at(days=1))], "company_id long, transit_minutes int, expires_at timestamp").withColumn("origin_hash", origin_hash(F.lit("Frankfurt, Germany")))
    transit = spark.createDataFrame([(1, 99, 99), (2, None, 60), (6, 10, None)], "company_id long, primary_minutes int, fallback_minutes int")
    routes = spark.createDataFrame([(1, 50), (6, 10)], "company_id long, car_minutes int")
    scored = score_jobs(jobs, _resolved(spark), cache, transit, routes, F.lit(NOW))
    got = {r["id"]: r for r in scored.scores.collect()}
    assert all(got[i]["score"] == 1.0 and got[i]["status"] == "resolved" and got[i]["is_remote"] for i in (1, 2, 3))
    assert (got[4]["transit_minutes_public"], got[4]["transit_minutes_car"], got[4]["score"]) == (42, 50, 0.79)
    assert (got[5]["effective_minutes"], got[5]["hybrid_days"], got[5]["score"]) == (30, 2, 0.85)
    assert all(got[i]["score"] == 0.5 and got[i]["status"] == "failed" for i in (6, 7, 8))
    assert [tuple(r) for r in scored.fresh_minutes.select("company_id", "transit_minutes", "api_used").collect()] == [(2, 60, "transport_rest")]
    (missing,) = scored.missing_lookups.collect()
    assert (missing["company_id"], missing["needs_transit"], missing["needs_route"]) == (2, False, True)
    assert missing["departure"] == dt.datetime(2026, 3, 17, 8)
    assert set(batch_view(scored.scores).columns) == {"job_id", "score", "effective_minutes", "transit_public", "transit_car", "work_model", "is_remote"}


def test_backfill(spark):
    jobs = spark.createDataFrame([(1, "alt"), (2, ""), (3, None), (4, None)], "id long, raw_text string")
    texts = spark.createDataFrame([(1, "neu"), (2, "neu"), (3, ""), (4, "neu")], "id long, text string")
    assert {r["id"]: r["raw_text"] for r in M.fill_texts(jobs, texts).collect()} == {1: "alt", 2: "neu", 3: None, 4: "neu"}


def test_backfill_from_pages(spark):
    long = "Aufgaben und Profil " * 10
    jobs = spark.createDataFrame(
        [(1, "A", "alt", True, NOW), (2, "B", "", True, NOW), (3, "C", None, True, NOW), (4, "D", None, False, NOW), (5, "E", None, True, NOW)],
        "id long, title string, raw_text string, is_active boolean, first_seen_at timestamp",
    )
    links = spark.createDataFrame([(i, "interamt", f"u{i}") for i in range(1, 6)] + [(3, "other", "u9")], "job_id long, source_name string, url string")
    page = f"<html><body><main>{long}</main></body></html>"
    pages = spark.createDataFrame(
        [("u1", page), ("u2", page), ("u3", "<html><body>kurz</body></html>"), ("u4", page), ("u9", page)], "search_key string, payload string"
    )
    done = B.backfill_texts(jobs, links, pages, "interamt", F.lit(NOW))
    got = {r["id"]: (r["raw_text"], r["updated_at"] is not None) for r in done.jobs.collect()}
    assert got == {1: ("alt", False), 2: (long.strip(), True), 3: (None, False), 4: (None, False), 5: (None, False)}
    assert sorted(tuple(r) for r in done.candidates.collect()) == [(2, "u2", True), (3, "u3", False), (5, "u5", False)]
    assert B.backfill_texts(jobs, links, pages, "interamt", limit=1).candidates.count() == 1


def test_cache_timers_over_restarts(spark, tmp_path):
    schema = "company_id long, origin_hash string, transit_minutes int, api_used string, landed_at timestamp"
    day = lambda n, **more: dt.datetime(2026, 3, 1) + dt.timedelta(days=n, **more)
    parts = [
        [(1, "h", 10, "a", day(0)), (1, "h", 12, "b", day(0, hours=1)), (2, "h", 20, "a", day(1)), (3, "g", 30, "a", day(1))],
        [(1, "h", 99, "a", day(0)), (2, "h", 25, "a", day(6)), (4, "h", 40, "a", day(7))],
        [(5, "h", 50, "a", day(30)), (1, "h", 11, "a", day(29))],
    ]
    inbox, state = str(tmp_path / "minutes"), str(tmp_path / "timers")
    for part in parts:
        # Each file is a run of its own: the query starts anew from its checkpoint.
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        T.keep_cache(stream, state, f"{state}/progress", ttl_days=10, delay="2 days").awaitTermination()
    changes = T.read_changes(spark, state)
    got = sorted((r.company_id, r.transit_minutes, r.change, r.expires_at) for r in T.latest_changes(changes).collect())
    assert got == [
        (1, 11, "kept", day(39)), (2, 25, "expired", day(16)), (3, 30, "expired", day(11)), (4, 40, "expired", day(17)), (5, 50, "kept", day(40)),
    ]
    # The lookup of company 1 that the last one replaced has expired or been replaced, never both kept.
    assert changes.where("company_id = 1 AND transit_minutes = 99").isEmpty()


def test_run_log(spark):
    outcomes = spark.createDataFrame([("a", "new"), ("a", "error"), ("b", "duplicate")], "source_name string, outcome string")
    row = R.run_row(R.run_stats(outcomes, "source_name"), 3, F.lit(NOW), F.lit(NOW), 2, ["Scraper [c] fehlgeschlagen"]).first()
    assert row["stats"].asDict() == {"fetched": 3, "new": 1, "duplicate": 1, "skipped": 0, "errors": 1, "expired": 2}
    assert (row["status"], row["sources_run"], len(row["error_log"])) == ("finished", ["a", "b"], 1)
    empty = R.run_row(R.run_stats(outcomes.limit(0), "source_name"), 3, F.lit(NOW), F.lit(NOW), 0, ["x"]).first()
    assert empty["status"] == "failed" and empty["stats"]["fetched"] == 0


def test_stream_by_file_equals_one_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = _batch(rng, 0, 40)
    whole = spark.createDataFrame(rows, FIELDS)
    inbox = str(tmp_path / "inbox")
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(inbox)
    state = str(tmp_path / "state")
    S.ingest_stream(stream, lambda batch: batch, state, f"{state}/progress", F.lit(NOW)).awaitTermination()
    assert S.last_version(spark, state) == 2
    S.ingest_batch(cut_lineage(whole), str(tmp_path / "once"), 0, F.lit(NOW))
    for table, columns in {"jobs": ["id", "canonical_id", "title", "raw_text"], "sources": ["url", "job_id", "source_job_id"], "companies": ["id", "name"]}.items():
        streamed = S.read_version(spark, state, table, 2).select(*columns).collect()
        batched = S.read_version(spark, str(tmp_path / "once"), table, 1).select(*columns).collect()
        assert sorted(map(str, streamed)) == sorted(map(str, batched)), table


def test_state_and_batch_are_normalised_once(spark):
    from stellwerk.plans import identity_queries
    from stellwerk.plans.adapters import Inputs

    for rows in identity_queries._split(Inputs(spark, "/root/testdata/sf0.001")):
        assert "sha2" not in rows._jdf.queryExecution().optimizedPlan().toString()
