"""Exact dedup and its minimal perfect hash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from stellwerk.llm import exact_dedup, perfect_hash

SCHEMA = "doc_id long, text string, digest string, keep_id string, group_size string, locator string"


def digests(n, seed):
    return np.random.default_rng(seed).integers(0, 2**63, (n, 4), dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1000, 50_000])
def test_perfect_hash_gives_every_key_its_own_slot(n):
    keys = digests(n, n)
    sizes, maps = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(keys, sizes, maps).tolist()) == list(range(n))
    others = perfect_hash.slots(digests(1000, 7), sizes, maps)
    assert others.min() >= -1 and others.max() < max(n, 1)
    assert n < 1000 or 8 * len(maps) < 4.5 * n


def test_perfect_hash_parts_keys_that_differ_in_one_bit_only():
    keys = np.zeros((256, 4), np.uint64)
    for i in range(256):
        keys[i, i // 64] = np.uint64(1) << np.uint64(i % 64)
    sizes, maps = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(keys, sizes, maps).tolist()) == list(range(256))
    with pytest.raises(ValueError):
        perfect_hash.build(np.zeros((2, 4), np.uint64))


def brute(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows]
    groups = {}
    for (doc_id, _), text in zip(rows, normal):
        groups.setdefault(text, []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        least = min(known, default=None)
        kept = False
        for d in sorted(ids, key=lambda d: (d is None, d)):
            out.append((d, least, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(5)
    got = exact_dedup.deduplicate(frame).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str)


@pytest.mark.parametrize("few", [1 << 16, 16])
def test_groups_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", few)
    monkeypatch.setattr(exact_dedup, "HOT", 50)  # a hot group and groups that are joined by digest
    rng = random.Random(few)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(250)]
    texts += ["hot  text\t\n", "hot text ", "hot text"] * 60 + [None, "", " ", "\x0b", "\xa0", "\x1f", "x" * 300_000, "x" * 300_000]
    rng.shuffle(texts)
    rows = [(rng.choice([None, i, i]), t) for i, t in enumerate(texts)]
    rows += [(5, "hot text"), (5, "hot text"), (-9, "a b"), (None, "only null"), (None, "only null")]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_tables_without_ids(spark):
    assert found(spark, []) == []
    rows = [(None, "a"), (None, "a"), (None, None)]
    assert found(spark, rows) == brute(rows)
    rows = [(7, "a")] * 3
    assert found(spark, rows) == brute(rows)


def test_lookup_compares_bytes_and_keeps_what_the_history_located(spark):
    name = lambda i: hashlib.sha256(str(i).encode()).digest()
    kind = "digest binary, keep_id long, locator long, group_size long"
    history = spark.createDataFrame([(bytearray(name(i)), 1000 + i, i, 2) for i in range(300)], kind)
    batch = spark.createDataFrame([(bytearray(name(i)), i, 5000 + i, 1) for i in range(250, 900)], kind)
    index = exact_dedup.build_index(history, 4)
    assert index.count() == 4
    got = {bytes(r.digest): (r.keep_id, r.locator, r.group_size, r.known) for r in exact_dedup.look_up(index, batch, 4).collect()}
    want = {name(i): (1000 + i, i, 2 + (i >= 250), True) for i in range(300)}
    want |= {name(i): (i, 5000 + i, 1, False) for i in range(300, 900)}
    assert got == want
