import random

import pytest

from stellwerk.functions.similarity import ratio
from stellwerk.operators import weighted_pairs as W


def _brute(rows, threshold, weights):
    classes = {}
    for i, title, company in rows:
        if i is not None:
            key = ((title or "").lower(), (company or "").lower())
            classes[key] = min(i, classes.get(key, i))
    listed = sorted((i, *key) for key, i in classes.items())
    out = {}
    for n, (i, t, c) in enumerate(listed):
        for j, u, d in listed[n + 1 :]:
            similarity = ratio(t, u) * weights[0] + ratio(c, d) * weights[1]
            if similarity >= threshold:
                out[i, j] = similarity
    members = {(i, classes[(t or "").lower(), (c or "").lower()]) for i, t, c in rows if i is not None}
    return out, members


def _postings(n):
    rng = random.Random(5)

    def typo(text):
        letters = list(text)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "ä", " m", "q"])
        return "".join(letters)

    titles = ["Data Engineer (m/w/d)", "Software Developer", "Softwareentwickler Java", "Leitung Einkauf", "IT", "Koch", "a", ""]
    companies = ["Stadtwerke Nord GmbH", "Stadtwerke Süd GmbH", "Acme AG", "B", "", "ab"]
    rows = [(i, typo(rng.choice(titles)), typo(rng.choice(companies))) for i in range(n)]
    # A title that a third of all rows have, missing fields, repeated rows, characters beyond the first plane.
    rows += [(n + i, "Data Engineer", typo(companies[i % 2])) for i in range(n // 3)]
    rows += [(9000, None, None), (9001, "", None), (9002, None, "Acme AG"), (None, "Koch", "B"), (9003, "KOCH", "b"), (9003, "KOCH", "b")]
    rows += [(9004, "😀 Koch 😀", "Acme AG"), (9005, "😀 Koch 😁", "ACME AG"), (9006, "Ab", "b"), (9007, "ab", "c"), (9008, "abc", "b")]
    return rows


@pytest.mark.parametrize("threshold, weights", [(0.85, (0.6, 0.4)), (0.9, (0.5, 0.5))])
def test_pairs_and_members_equal_brute_force(spark, threshold, weights):
    rows = _postings(375)
    postings = spark.createDataFrame([(*r, "x") for r in rows], "id long, title string, company string, title_key string")
    pairs, members = _brute(rows, threshold, weights)
    found = {(r.class_id, r.other_id): r.similarity for r in W.weighted_pairs(postings, threshold, weights).collect()}
    assert len(pairs) > 1000 and found.keys() == pairs.keys()
    assert all(found[p] == pytest.approx(pairs[p], abs=1e-12) for p in pairs)
    assert {(r.id, r.class_id) for r in W.members(postings).collect()} == members


def test_nothing_and_loose_thresholds(spark):
    none = spark.createDataFrame([], "id long, title string, company string")
    assert W.weighted_pairs(none).count() == 0 and W.members(none).count() == 0
    with pytest.raises(ValueError):
        W.weighted_pairs(none, 0.7)


@pytest.mark.parametrize("by_fields", [True, False])
def test_both_ways_to_the_pairs_are_exact(spark, monkeypatch, by_fields):
    rows = _postings(150)
    monkeypatch.setattr(W, "_meetings", lambda keyed, keys: float((len(keys) == 2) == by_fields))
    pairs, _ = _brute(rows, 0.85, (0.6, 0.4))
    postings = spark.createDataFrame(rows, "id long, title string, company string")
    found = {(r.class_id, r.other_id): r.similarity for r in W.weighted_pairs(postings).collect()}
    assert len(pairs) > 100 and found.keys() == pairs.keys()
    assert all(found[p] == pytest.approx(pairs[p], abs=1e-12) for p in pairs)


def test_classes_of_few_texts_meet_by_their_texts(spark, monkeypatch):
    """20 titles and 20 companies in all their 400 combinations: each text is measured with 20 others, not with 400."""
    rows = [(20 * i + j, f"Data Engineer {i:02}", f"Stadtwerke {j:02}") for i in range(20) for j in range(20)]
    met = []
    ratio_of = W.sequence_ratio
    monkeypatch.setattr(W, "sequence_ratio", lambda a, b: met.append((a, b)) or ratio_of(a, b))
    found = W.weighted_pairs(spark.createDataFrame(rows, "id long, title string, company string"))
    assert set(met) == {("a", "b")}
    assert {(r.class_id, r.other_id) for r in found.collect()} == _brute(rows, 0.85, (0.6, 0.4))[0].keys()
