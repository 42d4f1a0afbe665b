import random
from collections import Counter
from itertools import combinations

import pytest

from stellwerk.operators import skill_pairs as P


def _brute(rows, least):
    jobs = {}
    for job, skill in rows:
        if job is not None and skill is not None:
            jobs.setdefault(job, set()).add(skill)
    counts = Counter(pair for held in jobs.values() for pair in combinations(sorted(held), 2))
    return {pair: n for pair, n in counts.items() if n >= least}


def _found(frame):
    rows = [((r.skill_a, r.skill_b), r.jobs) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("block, task, stride, least", [(1024, 2_000_000, 1_000_000, 1), (7, 100, 13, 3), (3, 50, 5, 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, block, task, stride, least):
    monkeypatch.setattr(P, "BLOCK_SKILLS", block)
    monkeypatch.setattr(P, "SKILLS_PER_TASK", task)
    monkeypatch.setattr(P, "_STRIDE", stride)
    rng = random.Random(block)
    rows = [(rng.randrange(60), f"s{int(rng.paretovariate(0.6)) % 40}") for _ in range(500)]
    rows += rows[:50] + [(None, "s1"), (3, None), (900, "alone"), (901, ""), (901, "s1"), (902, ""), (902, "s1"), (903, "é"), (903, "")]
    skills = spark.createDataFrame([(*r, 1) for r in rows], "job_id long, skill string, jobs int")
    assert _found(P.skill_pairs(skills, least)) == _brute(rows, least)


def test_jobs_with_many_skills_make_no_row_per_pair(spark):
    rows = [(job, f"s{i}") for job in range(3) for i in range(1000)] + [(7, f"rare{i}") for i in range(1000)]
    pairs = P.skill_pairs(spark.createDataFrame(rows, "job_id long, skill string"), 3)
    found = pairs.groupBy("jobs").count().collect()
    assert [(r.jobs, r["count"]) for r in found] == [(3, 1000 * 999 // 2)]


def test_best_partners(spark):
    pairs = spark.createDataFrame([("a", "b", 5), ("a", "c", 5), ("a", "d", 9), ("b", "c", 1)], "skill_a string, skill_b string, jobs long")
    got = sorted(tuple(r) for r in P.best_partners(pairs, 2).collect())
    assert got == [("a", 1, "d", 9), ("a", 2, "b", 5), ("b", 1, "a", 5), ("b", 2, "c", 1), ("c", 1, "a", 5), ("c", 2, "b", 1), ("d", 1, "a", 9)]


def test_no_skills(spark):
    none = spark.createDataFrame([], "job_id long, skill string")
    assert P.skill_pairs(none, 1).count() == 0
    assert P.best_partners(P.skill_pairs(none, 1), 3).count() == 0
