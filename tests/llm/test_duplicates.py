"""Jaccard join, components and suffix index against brute force."""

import collections
import hashlib
import random

import pytest

from stellwerk.llm import components, jaccard_join, suffix_index


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups=6, copies=25, edits=(0, 7)):
    """Groups whose members lie around the threshold, many of them not linked with their base."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(10**6)
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 160))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(*edits)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 2)] = [word()]
            if rng.random() < 0.2:
                text += passage
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join([word() for _ in range(40)] + passage)) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,pairs", [(1, 50_000), (2, 100), (3, 400)])
def test_components_equal_brute_force(spark, monkeypatch, seed, pairs):
    monkeypatch.setattr(jaccard_join, "ROUND_PAIRS", pairs)  # few pairs: many rounds
    monkeypatch.setattr(jaccard_join, "SMALL", {1: 64, 2: 0, 3: 8}[seed])
    rows = near_copies(seed)
    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute_components(rows)


EDGES = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one two three four five"), (6, "One two\x0bthree four five"),
    (7, "a b c d e f"), (7, "a b c d e f"), (8, "a a a a a a a a a"), (None, "one two"), (None, None), (9, "x " * 40_000), (10, "y\xa0z"), (11, "É è"), (12, "é è"),
]


def test_defined_cases_of_the_join(spark):
    frame = spark.createDataFrame([(*r, b"x", 1) for r in EDGES], "doc_id long, text string, set_id binary, component_id int")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(frame).collect()), key=str)
    assert found == brute_components(EDGES)
    assert jaccard_join.join_components(frame.where("false")).count() == 0


def test_copies_of_a_set_are_read_again_once(spark, monkeypatch):
    base = near_copies(5, groups=4, copies=10) + [(None, "no id here"), (None, "no id here"), (500, "a b c"), (501, None)]
    rows = [(d if d is None else d + 1000 * k, t) for k in range(6) for d, t in base]
    read = []
    links = jaccard_join.links

    def counted(documents, total):
        read.append([r.doc_id for r in documents.collect()])
        return links(documents, total)

    monkeypatch.setattr(jaccard_join, "links", counted)
    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute_components(rows)
    # The least row of each set is read; few other rows pass the filter.
    least = {}
    for d, t in rows:
        if d is not None and shingles(t):
            least[shingles(t)] = min(d, least.get(shingles(t), d))
    (again,) = read
    assert set(least.values()) <= set(again) and len([d for d in again if d is not None]) < 1.5 * len(least)


def test_one_document_of_each_component_stays(spark):
    rows = near_copies(4, groups=3, copies=8) + [(1000 + i, t) for i, (_, t) in enumerate(EDGES)] + [(None, None), (1007, "a b c d e f")]
    nameless = [(None, "words that stand alone"), (None, "Words that stand alone"), (None, "other words alone")]
    rows += nameless
    frame = spark.createDataFrame([(d, t, str(d)) for d, t in rows], "doc_id long, text string, n_shingles string")
    kept = jaccard_join.keep_one(frame).collect()
    named = brute_components(rows)
    expected = sorted({c for _, n, c in named if n and c is not None} | {d for d, n, _ in named if not n and d is not None})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == expected
    assert sorted((r.text or "").lower() for r in kept if r.doc_id is None) == ["", "other words alone", "words that stand alone"]
    assert set(kept[0].asDict()) == set(frame.columns)


def test_stars_reach_the_least_node(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 50)]
    found = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, **{500 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_edges_join_components(spark):
    labels = components.components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long"))
    more = spark.createDataFrame([(3, 11), (30, 31), (31, 20)], "a long, b long")
    found = dict(map(tuple, components.joined(labels, more).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20}


def brute_repeats(rows, length=200):
    counts = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (150, 185, 199, 200, 201, 260, 700)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [text(rng.randint(0, 300)), p[a:] if rng.random() < 0.5 else p]
        rows.append((i, "".join(parts) + text(rng.randint(0, 50))))
    rows += [(60, rows[3][1]), (61, "a" * 1500), (62, "ab" * 400), (63, None), (64, ""), (None, passages[-1]), (5, rows[5][1]), (5, rows[5][1]), (65, "x" * 199), (66, "x" * 199)]
    return rows


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 5)])
def test_repeats_equal_brute_force(spark, seed, batches):
    rows = repeated(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = suffix_index.repeated_spans(frame, batches)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == brute_repeats(rows)


def test_kept_texts_have_whole_characters(spark):
    body = "é" * 150
    rows = [(0, "aé" + body + "x"), (1, "bé" + body + "y"), (2, "clean"), (3, "ü" + body[:99] + "z")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    kept = {r.doc_id: r.kept_text for r in suffix_index.repeated_spans(frame, want_text=True).collect()}
    assert kept == {0: "ax", 1: "by", 2: "clean", 3: rows[3][1]}


def test_a_frequent_passage_is_one_entry_of_its_unit(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, short = text(900), text(100)
    rows = [(i, text(150) + passage + text(150) + short + text(150)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = suffix_index.SuffixIndex(spark, 10_000)
    index.add(frame, keep=False)
    written = spark.read.option("recursiveFileLookup", True).parquet(index.path).where("kind <> 'texts'").collect()
    counts = collections.Counter()
    for r in written:
        for column in ("keys", "prints"):
            packed = r[column] or b""
            counts.update((r["kind"], column, packed[i : i + 8]) for i in range(0, len(packed), 8))
    assert max(counts.values()) <= 3  # one per unit, and a partition is one unit here
    found = suffix_index.repeated_spans(frame, 1)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == brute_repeats(rows)


def test_anchors_are_dealt_evenly(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2000))) for i in range(200)]
    index = suffix_index.SuffixIndex(spark, 10_000)
    index.add(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    held = collections.Counter()
    for r in spark.read.option("recursiveFileLookup", True).parquet(index.path).where("kind <> 'texts'").collect():
        held[r["kind"], r["bucket"]] += len(r["prints"] or b"") // 8
    assert max(held.values()) < 0.05 * sum(held.values())


@pytest.mark.parametrize("batches", [1, 3])
def test_small_units_find_the_same_repeats(spark, monkeypatch, batches):
    monkeypatch.setattr(suffix_index, "UNIT_ENTRIES", 15)
    monkeypatch.setattr(suffix_index, "SLICE_BYTES", 1000)
    rows = repeated(11)
    found = suffix_index.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), batches)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == brute_repeats(rows)


def test_levels_merge_geometrically(spark):
    frame = spark.createDataFrame(repeated(9), "doc_id long, text string")
    index = suffix_index.SuffixIndex(spark, 10_000)
    sizes = []
    for number in range(5):
        index.add(frame.where(f"pmod(hash(doc_id), 5) = {number}"))
        sizes.append(sorted(index.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]


def test_no_text_no_repeats(spark):
    assert suffix_index.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
