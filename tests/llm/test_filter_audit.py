"""Filter interactions against filters applied one after the other."""

import itertools
import random
import re

from stellwerk.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask string, quality string, toxic string, digest string"


def judged(rows):
    texts = [t or "" for _, t, _ in rows]
    least = {}
    for (d, _, _), t in zip(rows, texts):
        if d is not None:
            least[t] = min(d, least.get(t, d))
    out = []
    for (d, _, _), t in zip(rows, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
            }
        )
    return out


def model(rows, labels):
    fails = judged(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        lines, totals = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order):
                removed = [(d, f) for d, f in left if f[x]]
                kept = [(d, f) for d, f in left if not f[x]]
                failing = sum(f[x] for _, f in mine)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                totals[x] += len(removed)
                lines.append(("".join(order), step + 1, x, len(kept), len(removed), failing - len(removed), alone, sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
                left = kept
        out += [(part, o, s, *m, totals[x]) for o, s, x, *m in lines]
    return sorted(out)


def audited(spark, rows, labels):
    documents = spark.createDataFrame([(*r, "p", "m", "q", "t", "d") for r in rows], SCHEMA).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    return sorted(tuple(r) for r in filter_audit.audit(documents, marks).collect())


def made_up(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["w%d" % rng.randrange(rng.choice([60, 900])) for _ in range(rng.choice([3, 150, 199, 200, 260]))]
        if rng.random() < 0.3:
            words += ["ABC"] * rng.randint(1, 40)
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|@"))
        rows.append((i, rng.choice([" ", "\n ", "\x0b"]).join(words), rng.choice(["a", "b", None, ""])))
    rows += [(n + i, rng.choice(rows)[1], rng.choice("abc")) for i in range(n // 2)]
    labels = [(rng.choice([None, rng.randrange(2 * n)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(n)]
    return rows, labels


def test_audit_equals_filters_in_sequence(spark):
    rows, labels = made_up(1)
    rows += [(None, None, "a"), (None, "", "a"), (900, "", None), (901, None, "a"), (900, "", "b"), (900, "", "b"), (7, rows[3][1], "a"), (902, "X" * 200_000, "z")]
    rng = random.Random(2)
    rng.shuffle(rows)
    got = audited(spark, rows, labels)
    assert got == model(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_no_rows_and_no_labels(spark):
    assert audited(spark, [], []) == []
    rows = [(1, "A", None)]
    assert audited(spark, rows, []) == model(rows, [])
