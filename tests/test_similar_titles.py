import random

import pytest
from pyspark.sql import functions as F

from stellwerk.functions.similarity import ratio
from stellwerk.operators import similar_titles as S

WORDS = ["senior", "junior", "python", "java", "entwickler", "entwicklerin", "berater", "data",
         "engineer", "leiter", "pflege", "m w d", "büro", "2026", "teamleiter", "it"]


def _titles(rng, n):
    made = set()
    while len(made) < n:
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))
        if rng.random() < 0.5:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice("abcxyz") + text[i + 1:]
        made.add(text)
        if rng.random() < 0.4:
            made.add(text + rng.choice(["en", " x", "in", "r"]))
    return sorted(made)


def _frame(spark, titles, company="c"):
    rows = [(company, t, i, i) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "company_key string, title string, first_seq long, last_seq long")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_within_equals_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(S, "DEPTH_2_FROM", 0 if depth > 1 else 10**9)
    monkeypatch.setattr(S, "DEPTH_3_FROM", 0 if depth > 2 else 10**9)
    titles = _titles(random.Random(depth), 250) + ["", "a", "ab", "abc", "abcd"]
    random.Random(1).shuffle(titles)
    want = {
        (titles[i], titles[j])
        for i in range(len(titles))
        for j in range(i)
        if ratio(titles[i], titles[j]) >= 0.85
    }
    got = [
        (r["title"], r["earlier_title"])
        for r in S.similar_within(_frame(spark, titles)).collect()
    ]
    assert len(got) == len(set(got))
    assert set(got) == want and len(want) > 50


def test_stored_equals_brute_force(spark):
    titles, stored = _titles(random.Random(7), 150), _titles(random.Random(8), 150)
    want = {t for t in titles if any(ratio(t, s) >= 0.85 for s in stored)}
    old = spark.createDataFrame([("c", s) for s in stored] + [("other", titles[0])], "company_key string, title string")
    got = [r["title"] for r in S.similar_to_stored(_frame(spark, titles), old).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def test_long_titles_and_hot_company(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh ", k=230))
    titles = [base, base[:-1] + "x", base[5:], base.upper()] + [f"mitarbeiter {i:05d}" for i in range(300)]
    want = {
        (titles[i], titles[j])
        for i in range(len(titles))
        for j in range(i)
        if ratio(titles[i], titles[j]) >= 0.85
    }
    got = {(r["title"], r["earlier_title"]) for r in S.similar_within(_frame(spark, titles)).collect()}
    assert got == want


def test_low_threshold_is_rejected(spark):
    with pytest.raises(ValueError):
        S.similar_within(_frame(spark, ["a"]), 0.5)


def test_edits_are_bounded(spark):
    pairs = [("abcd", "abce"), ("abcd", "wxyz"), ("kitten", "sitting"), ("aä€", "a€"), ("abc", "abcdefgh"), ("abc", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "explode(sequence(0, 9)) as most")
    told = rows.select("most", S._within("a", "b", F.col("most")).alias("near"), F.levenshtein("a", "b").alias("edits")).collect()
    assert all(r.near == (r.edits <= r.most) for r in told)
