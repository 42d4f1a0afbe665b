"""Merkle manifest against a plain recursive model."""

import hashlib
import random
import zlib

import pytest

from stellwerk.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, leaf string, place long"
UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def h(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(row, lowered=False):
    text = row[4].translate(UPPER_TO_LOWER) if lowered and row[4] is not None else row[4]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    """Root, and per node its runs (before, after) upwards."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            start = i // 8 * 8
            path.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def model(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]])
    root, above = tree([trees[x][0] for x in langs])
    out = []
    for lang, upper in zip(langs, above):
        for row, path in zip(by_lang[lang], trees[lang][1]):
            path = path + upper
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, changed)
            for before, after in path:
                node = h(before + node + after)
            out.append((row[0], leaf(row), trees[lang][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def made(spark, rows):
    frame = spark.createDataFrame([(*r, "k", "l", 3) for r in rows], SCHEMA).repartition(4)
    got = merkle.manifest(frame)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(sizes, seed):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "small only", "Ünïcode TEXT " * rng.randint(0, 9), "A"])
            rows.append((rng.randrange(10**6), rng.choice([None, "src", "s:1"]), lang, rng.choice([None, 0, 77]), text))
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"en": 1}, {"en": 9, "de": 8, None: 1}, {"en": 1100, "": 65, "fr": 513, None: 512, "zh": 64}, {f"x{i:02}": 1 + i % 3 for i in range(70)}],
)
def test_manifest_equals_the_model(spark, sizes):
    rows = rows_of(sizes, 1)
    rows.append((10**6, "s", next(iter(sizes)), 1, "Z" * 200_000))
    assert made(spark, rows) == model(rows)


def test_three_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "_SEGMENTS", merkle.segments(1))
    rows = rows_of({"en": 700, "de": 64, "fr": 3}, 2)
    assert made(spark, rows) == model(rows)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    assert made(spark, []) == []
    rows = rows_of({"en": 5, None: 3}, 3)
    rows += [rows[0]] * 30 + [(None, "s", "en", 1, "No Id"), (None, None, None, None, None), (None, "s", "en", 1, "No Id")]
    rows += [(rows[0][0], "other", "en", 2, "same id")]
    assert made(spark, rows) == model(rows)
