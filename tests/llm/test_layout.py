"""Sharding and packing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from stellwerk.llm import packing, sharding
from stellwerk.llm.common import fresh_folder


@pytest.fixture
def documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ä" * int(rng.integers(0, 400)), i, "x") for i in range(3000)]
    rows += [(None, "no id", None, None), (None, None, None, None), (5, rows[5][1], 1, "y"), (3001, "", 0, ""), (3002, "z" * 50_000, 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, law string")


def test_shards_are_near_equal_and_places_gapless(spark, documents):
    rows = sharding.shard_documents(documents, 8).collect()
    loads, places = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert len(rows) == documents.count() and set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= 1000
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_id = {r.doc_id: r for r in documents.collect()}
    for r in rows:
        if r.doc_id is not None:
            data = by_id[r.doc_id].text.encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        else:
            assert (r.size, r.text_crc32) in ((13, zlib.crc32(b"no id")), (8, 0))


def test_growing_moves_slots_only_into_new_shards(spark, documents):
    path = fresh_folder(spark, "test-map")
    slotted = sharding.with_slots(documents)
    sharding.save_map(sharding.first_map(sharding.slot_sizes(slotted), 8), path)
    first = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    sharding.save_map(sharding.grown_map(sharding.load_map(spark, path), 10), path)
    second = sharding.load_map(spark, path)
    grown = {r.virtual_slot: r.shard for r in second.collect()}
    assert set(first) == set(grown)
    assert all(grown[s] == first[s] or grown[s] in (8, 9) for s in first)
    loads = {r.shard: r.b for r in second.groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()}
    assert len(loads) == 10 and loads[8] and loads[9]
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == first


def test_sharding_an_empty_table(spark, documents):
    assert sharding.shard_documents(documents.where("false"), 8).count() == 0


def test_sharding_uses_no_python(spark, documents):
    plan = sharding.shard_documents(documents, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_force(sizes, capacities, start_cost):
    """The same rules over a plain list of bins."""
    bins, left = [], sum(sizes)
    for size in sizes:
        fitting = [b for b in bins if b["free"] >= size]
        if fitting:
            tightest = min(b["free"] for b in fitting)
            chosen = max((b for b in fitting if b["free"] == tightest), key=lambda b: b["touched"])
        else:
            capacity = min((c for c in sorted(capacities) if c >= size), key=lambda c: ((c + start_cost) / min(c, left), -c))
            chosen = {"free": capacity, "items": [], "touched": 0}
            bins.append(chosen)
        chosen["items"].append(size)
        chosen["free"] -= size
        chosen["touched"] = len(sizes) - left + sum(1 for b in bins for _ in b["items"])
        left -= size
    return sorted((sorted(b["items"]), min(c for c in capacities if c >= sum(b["items"]))) for b in bins)


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 65, 120))[::-1]
        bins, offsets, capacities = packing.best_fit(sizes, (16, 32, 64), 4)
        own = defaultdict(list)
        for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes.tolist()):
            assert o == sum(own[b])
            own[b].append(s)
        found = sorted((sorted(v), int(capacities[b])) for b, v in own.items())
        expected = brute_force(sizes.tolist(), (16, 32, 64), 4)
        assert sum(c for _, c in found) == sum(c for _, c in expected)
        assert sorted(sum(x) for x, _ in found) == sorted(sum(x) for x, _ in expected)


def test_packing_loses_nothing(spark):
    rows = [(i, "w " * (i % 97 * 31)) for i in range(700)] + [(700, "w " * 30_000), (701, None), (None, "a b"), (3, "a"), (3, "a"), (702, "")]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bin string")
    lengths = packing.with_lengths(documents)
    placed = packing.pack(lengths, group_pieces=100).collect()
    assert sum(r.length for r in placed) == lengths.agg({"length": "sum"}).first()[0]
    bins = defaultdict(list)
    for r in placed:
        bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert {r.fill for r in own} == {sum(x.length for x in own)}
        assert {r.capacity for r in own} == {min(c for c in packing.LENGTHS if c >= own[0].fill)}
    long = sorted((r.piece, r.start, r.length) for r in placed if r.doc_id == 700)
    assert long == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 8192), (3, 24576, 30_001 - 24576)]
    fill = sum(r.length for r in placed) / sum(own[0].capacity for own in bins.values())
    assert fill > 0.9


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
