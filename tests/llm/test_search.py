"""Nearest vectors and BM25 against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import bm25_search, curve_search
from stellwerk.llm.common import table
from stellwerk.session import checkpoint_dir

SF = "/root/testdata/sf0.1"


def test_hilbert_neighbours_are_adjacent_cells():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = curve_search.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_of_the_registered_search(spark, uneven):
    rows = table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    if uneven:  # lengths matter for the inner product
        rows = rows.withColumn("vector", F.transform("vector", lambda x: x * (1 + F.col("id") % 3)))
    points = curve_search.usable(rows)
    found = {}
    for r in curve_search.search(points, points.where("id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, []).append(r)
    held = {r.id: np.array(r.vector, np.float64) for r in points.collect()}
    ids = np.array(sorted(held))
    matrix = np.stack([held[i] for i in ids])
    hits = total = 0
    for q, near in found.items():
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, 21)) and q not in [r.vec_id for r in near]
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        scores = matrix @ held[q]
        assert all(r.score == pytest.approx(float(held[r.vec_id] @ held[q]), abs=1e-12) for r in near)
        best = set([i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20])
        hits += len(best & {r.vec_id for r in near})
        total += 20
    assert total == 2000 and hits / total >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (7, [1.0]), (1, [0.5, 0.5]), (8, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, vector array<float>, rank int")
    points = curve_search.usable(frame)
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in curve_search.search(points, points.where("id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    none = curve_search.usable(frame.where("false"))
    assert curve_search.search(none, none).count() == 0


def bm25(documents, k=10):
    words = [(i, (t or "").encode().lower().split()) for i, t in documents if i is not None]
    counts = [(i, Counter(w), len(w)) for i, w in words]
    df = Counter(t for _, c, _ in counts for t in c)
    n, mean = len(counts), sum(m for *_, m in counts) / len(counts)
    out = {}
    for q, asked, _ in counts:
        if q % 100:
            continue
        scored = []
        for d, own, m in counts:
            if d != q:
                s = sum(times * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * m / mean)) for t, times in asked.items() if t in own)
                if s:
                    scored.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def test_bm25_equals_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(200, None), (201, ""), (300, "the of and"), (None, "the of"), (301, "the of and"), (302, "The OF\tand"), (400, rows[0][1]), (401, "zz " * 20_000)]
    monkeypatch.setattr(bm25_search, "SHARD_DOCUMENTS", 64)
    monkeypatch.setattr(bm25_search, "BLOCK_DOCUMENTS", 4)
    monkeypatch.setattr(bm25_search, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(bm25_search, "QUERIES_PER_TASK", 2)
    documents = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, text string, score double")
    found = {}
    for r in bm25_search.search(documents, documents.where("id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    expected = {q: v for q, v in bm25(rows).items() if v}
    assert found.keys() == expected.keys()
    for q in found:
        assert [d for d, _ in found[q]] == [d for d, _ in expected[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in expected[q]], abs=2e-6)


def test_every_query_row_of_a_repeated_id_is_answered(spark):
    rows = [(100, "red apple"), (100, "red apple"), (100, "green pear"), (1, "apple pie"), (2, "pear tree"), (3, "stone")]
    documents = spark.createDataFrame(rows, "id long, text string")
    found = bm25_search.search(documents, documents.where("id % 100 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == [(100, 1, 1), (100, 1, 1), (100, 1, 2)]


def test_slices_of_queries_hold_no_copies_on_disk(spark, monkeypatch):
    rows = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id as id", "text")
    plans, stored = [], bm25_search.stored

    def watched(frame, name):
        plans.append((name, frame._jdf.queryExecution().optimizedPlan().toString()))
        return stored(frame, name)

    monkeypatch.setattr(bm25_search, "stored", watched)
    monkeypatch.setattr(bm25_search, "SHARD_DOCUMENTS", 32)
    found = {}
    for most in (1000, 16):
        plans.clear()
        monkeypatch.setattr(bm25_search, "QUERIES_PER_TASK", most)
        found[most] = sorted(map(tuple, bm25_search.search(rows, rows, 3).collect()))
    assert len(found[16]) > 500 and found[16] == found[1000]
    # Each slice is a run of its own; before, slices multiplied the documents, and shards the queries.
    assert len([name for name, _ in plans if name == "bm25-best"]) > 5
    assert not [name for name, plan in plans if "explode(" in plan]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    left = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [name for name in left if name.startswith(("bm25-queries", "bm25-weighted"))]


def test_bm25_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert bm25_search.search(none, none).count() == 0
