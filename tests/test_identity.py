import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import sequential
from stellwerk import schemas
from stellwerk.functions.text import canonical_id, normalize_text
from stellwerk.operators import identity as I
from stellwerk.operators import maintenance as M
from stellwerk.operators import settling as S
from stellwerk.functions.similarity import ratio
from stellwerk.session import cut_lineage

TITLES = ["Data Engineer", "Data Engineer (m/w/d)", "Data Enginer", "Pflegekraft", "Pflegekraft Nacht",
          "Pflegekraft Tag", "Leiter IT", "Leiter IT-Betrieb", "Sachbearbeiter", "Sachbearbeiterin"]
FIELDS = "seq long, source_name string, source_type string, title string, company_name string, url string," \
         " location_raw string, work_model string, deadline timestamp, salary_raw string, raw_text string," \
         " source_job_id string, sector string"


def _batch(rng, start, n):
    rows = []
    for i in range(n):
        rows.append((
            start + i, rng.choice(["a", "b"]), "portal", rng.choice(TITLES),
            rng.choice(["Unbekannt", "Acme GmbH", "ACME gmbh", "Stadt Köln"]),
            f"u{rng.randrange(n)}", rng.choice([None, "Kassel", "34117 Kassel", "Köln"]), None, None, None,
            rng.choice([None, "", f"text {i}"]),
            rng.choice([None, "", *[str(x) for x in range(n // 3)]]), None,
        ))
    return rows


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


# Slices of two titles; components from the first round on; both with tiny components only.
@pytest.mark.parametrize(
    "seed,slice_titles,rounds,component_rows,days", [(1, 4096, 4, 5000, 2), (3, 2, 4, 5000, 1), (4, 4096, 1, 5000, 1)]
)
def test_runs_equal_sequential_model(spark, monkeypatch, seed, slice_titles, rounds, component_rows, days):
    monkeypatch.setattr(S, "PAIRS_PER_TITLE", -1)  # always slice above slice_titles
    monkeypatch.setattr(S, "FIRST_SLICE", 2)
    monkeypatch.setattr(S, "ROUNDS", rounds)
    monkeypatch.setattr(S, "COMPONENT_ROWS", component_rows)
    rng = random.Random(seed)
    jobs, sources, companies = (_empty(spark, s) for s in (schemas.JOBS, schemas.JOB_SOURCES, schemas.COMPANIES))
    state = {"jobs": {}, "sources": {}, "companies": {}}
    for day in range(days):
        ts = dt.datetime(2026, 3, 1 + day, 8)
        frame = spark.createDataFrame(_batch(rng, day * 1000, 45), FIELDS).repartition(3)
        keyed = frame.withColumns({
            "canonical_id": canonical_id(F.col("title"), F.col("company_name"), F.col("location_raw")),
            "company_key": normalize_text(F.col("company_name")),
            "title_norm": normalize_text(F.col("title")),
        })
        local = sorted((r.asDict() for r in keyed.collect()), key=lambda r: r["seq"])
        want = sequential.run(local, state, ts)
        done = M.resolve(frame, jobs, sources, companies, F.lit(ts), slice_titles=slice_titles)
        got = [tuple(r) for r in done.outcomes.select("seq", "outcome", "matched_stage", "job_key").collect()]
        assert sorted(got) == want
        jobs, sources, companies = (cut_lineage(x) for x in (done.jobs, done.sources, done.companies))

        stored = {r["canonical_id"]: r for r in jobs.collect()}
        assert stored.keys() == state["jobs"].keys()
        for key, job in state["jobs"].items():
            assert (stored[key]["last_seen_at"], stored[key]["first_seen_at"]) == (job["last_seen_at"], job["first_seen_at"])
            assert (stored[key]["raw_text"] or None) == (job["raw_text"] or None)
        by_id = {r["id"]: r["canonical_id"] for r in jobs.collect()}
        assert sorted(by_id) == list(range(1, len(by_id) + 1))
        links = {r["url"]: r for r in sources.collect()}
        assert links.keys() == state["sources"].keys() and len(links) == sources.count()
        for url, link in state["sources"].items():
            row = links[url]
            assert by_id[row["job_id"]] == link["job"]
            assert (row["source_name"], row["source_job_id"] or None) == (link["source_name"], link["source_job_id"] or None)
            assert row["last_seen_at"] == link["last_seen_at"]
        assert {r["name_normalized"]: r["name"] for r in companies.collect()} == state["companies"]

        # Close some jobs so that stages 0 and 1 meet inactive ones.
        closed = sorted(state["jobs"])[::3]
        for key in closed:
            state["jobs"][key]["is_active"] = False
        jobs = cut_lineage(jobs.withColumn("is_active", F.col("is_active") & ~F.col("canonical_id").isin(closed)))


def _keys(spark, titles):
    """Posting keys of one company per prefix, in arrival order."""
    rows = [(i, f"u{i}", False, f"none{i}", f"c{i}", company, title) for i, (company, title) in enumerate(titles)]
    schema = "seq long, url string, has_source_id boolean, source_key string, canonical_id string, company_key string, title string"
    return spark.createDataFrame(rows, schema).withColumns(
        {"stored_job": F.lit(None).cast("string"), "stored_hash": F.lit(False), "stored_url": F.lit(False), "stored_title": F.lit(False)}
    )


def _model(titles):
    accepted, labels = {}, []
    for company, title in titles:
        earlier = accepted.setdefault(company, [])
        alike = any(ratio(title, t) >= 0.85 for t in earlier)
        labels.append(I.BY_TITLE if alike else I.NEW)
        if not alike:
            earlier.append(title)
    return labels


def test_a_chain_of_titles_costs_a_small_multiple_of_the_batch(spark):
    # Each title resembles its neighbours only, so every label waits for the one before.
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    text = "".join(random.Random(5).choices(letters, k=900))
    titles = [("c", text[4 * i : 4 * i + 40]) for i in range(200)]
    settling = S.Settling(_keys(spark, titles).repartition(3), 0.85)
    got = [r.label for r in settling.labels().orderBy("seq").collect()]
    assert got == _model(titles) and got[:5] == [I.NEW, I.BY_TITLE] * 2 + [I.NEW]
    assert sum(settling.joined) <= 3 * 200 + 4 * 200, settling.joined
    assert len(settling.joined) < 12


def test_bursts_of_copies_are_compared_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_SLICE", 16)
    monkeypatch.setattr(S, "SAMPLE_TITLES", 500)
    compared = []
    within = S.similar_within

    def counted(titles, threshold):
        edges = within(titles, threshold)
        compared.append(edges.count())
        return edges

    monkeypatch.setattr(S, "similar_within", counted)
    rng = random.Random(6)
    titles = [(c, f"sachbearbeiter einkauf standort {c} nr {i:05d}") for i in range(1500) for c in ("a", "b", "c")]
    titles += [("small", " ".join(rng.choices(["data", "pflege", "leiter", "berater", "java", "sql"], k=4))) for _ in range(60)]
    rng.shuffle(titles)
    settling = S.Settling(_keys(spark, titles), 0.85, slice_titles=1000)
    got = [r.label for r in settling.labels().orderBy("seq").collect()]
    assert got == _model(titles)
    assert settling.slices >= 1
    assert sum(compared) < 3 * len(titles)
    # The rest of the batch leaves with the first rounds.
    assert sum(settling.joined) < 6 * len(titles)
