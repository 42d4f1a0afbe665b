"""Duplicates by a weighted similarity of two fields, found without comparing all pairs.

With weights a and b and a threshold t, each field has a least ratio of its own, the other one being
equal at best: (t - b) / a for the first and (t - a) / b for the second.  Each turns into a set-overlap
bound (see similar_titles), and there are two exact ways to the pairs.  By fields: the different titles that
share a key are measured once, so are the companies, and classes meet over the texts that are alike.  By
classes: a pair must share a key of both fields, so many alike titles are spread by their companies.  Counts
of the keys tell at which of the two fewer rows meet.  Bounds of the ratios follow inside the JVM, by the
characters that a text has at all and then by edit distance; only what is left gets the ratios.

Rows with equal fields form one class; pairs are between classes, and members are a list of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.similarity import sequence_ratio
from stellwerk.operators.similar_titles import _combinations, _needed, _tokens
from stellwerk.session import cut_lineage, spread

TITLE_DEPTH, COMPANY_DEPTH = 2, 1


def _folded(column: str) -> Column:
    return F.coalesce(F.lower(column), F.lit(""))


def members(postings: DataFrame) -> DataFrame:
    """id, class_id: the smallest id with the same title and company, whatever their case.

    A missing field counts as empty; rows without an id take no part.
    """
    known = postings.where(F.col("id").isNotNull()).select("id", _folded("title").alias("title"), _folded("company").alias("company"))
    least = known.groupBy("title", "company").agg(F.min("id").alias("class_id"))
    return known.join(least, ["title", "company"]).select("id", "class_id")


def _keys(text: Column, bound: float, depth: int) -> Column:
    """Keys of which two texts of at least this ratio share one."""
    n = F.length(text)
    shortest_partner = F.ceil(n * (bound / (2 - bound)) - 1e-9)
    prefix = F.slice(_tokens(text), F.lit(1), n - _needed(n + shortest_partner, bound).cast("int") + depth)
    # So short a text has no partner but an equal one.
    return F.when(n < depth, F.array(F.concat(F.lit("="), text))).otherwise(_combinations(prefix, depth))


def _letters(text: Column) -> Column:
    """The characters of a text as 64 bits; several may share one."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(bit(c)))


def _most_by_letters(m: Column, n: Column, a: Column, b: Column) -> Column:
    """Upper bound of the ratio: a character that only one text has matches nothing."""
    common = F.least(m - F.bit_count(a.bitwiseAND(F.bitwise_not(b))), n - F.bit_count(b.bitwiseAND(F.bitwise_not(a))))
    return F.when(m + n == 0, 1.0).otherwise(F.greatest(common, F.lit(0)) * 2 / (m + n))


def _most_by_edits(m: Column, n: Column, a: Column, b: Column) -> Column:
    """Upper bound of the ratio: characters outside the common blocks are edits."""
    return F.when(m + n == 0, 1.0).otherwise((m + n - F.levenshtein(a, b)) / (m + n))


def _meetings(keyed: DataFrame, keys: list[str]) -> float:
    """How often two rows meet at a key, from the keys' frequencies; no pair is formed."""
    n = keyed.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0


def _exploded(keyed: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        keyed = keyed.withColumn(key, F.explode(key))
    return keyed


def _distinct_keyed(classes: DataFrame, field: str, bound: float, depth: int) -> DataFrame:
    """The different texts of a field with their sizes, letters and keys."""
    text = F.col("text")
    texts = spread(cut_lineage(classes.select(F.col(field).alias("text")).distinct()))
    return cut_lineage(texts.withColumns({"size": F.length(text), "letters": _letters(text), "key": _keys(text, bound, depth)}))


def _alike(texts: DataFrame, bound: float) -> DataFrame:
    """a, b, ratio: different texts of at least this ratio in this order, and each text with itself."""
    keyed = _exploded(texts, ["key"])
    a, b = (keyed.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("text", "size", "letters"))) for side in "ab")

    def reaches(most, suffix: str) -> Column:
        return most(*(F.col(f"{side}{end}") for end in ("_size", suffix) for side in "ab")) >= bound - 1e-9

    # The cheap bound first; a pair can meet at several keys.
    close = (
        a.join(b, "key")
        .where((F.col("a_text") < F.col("b_text")) & reaches(_most_by_letters, "_letters") & reaches(_most_by_edits, "_text"))
        .select("a_text", "b_text").distinct()
    )
    # The order of the texts matters to the ratio.
    directions = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a_text", "b_text"), ("b_text", "a_text"))))
    directed = close.select(F.explode(directions).alias("d")).select("d.a", "d.b").withColumn("ratio", sequence_ratio("a", "b"))
    same = texts.select(F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("ratio"))
    return cut_lineage(directed.where(F.col("ratio") >= bound - 1e-9).unionByName(same))


def _pairs_by_fields(classes: DataFrame, texts: dict[str, DataFrame], bounds: dict, weights: tuple[float, float], threshold: float) -> DataFrame:
    """Classes meet over their alike titles and companies, each pair of texts being measured once."""
    met = classes.withColumnRenamed("id", "class_id")
    for field in texts:
        alike = _alike(texts[field], bounds[field][0])
        named = alike.select(F.col("a").alias(field), F.col("b").alias(f"other_{field}"), F.col("ratio").alias(f"{field}_ratio"))
        met = met.join(named, field).drop(field)
    similarity = F.col("title_ratio") * weights[0] + F.col("company_ratio") * weights[1]
    reached = met.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).drop("title_ratio", "company_ratio")
    others = classes.select(F.col("id").alias("other_id"), *(F.col(f).alias(f"other_{f}") for f in texts))
    pairs = reached.join(others, [f"other_{f}" for f in texts]).where(F.col("class_id") < F.col("other_id"))
    return pairs.select("class_id", "other_id", "similarity")


def weighted_pairs(
    postings: DataFrame, threshold: float = K.FUZZY_THRESHOLD, weights: tuple[float, float] = K.DUPLICATE_WEIGHTS
) -> DataFrame:
    """class_id, other_id, similarity: pairs of classes (the smaller id first) that reach the threshold."""
    title_weight, company_weight = weights
    title_bound = (threshold - company_weight) / title_weight
    company_bound = (threshold - title_weight) / company_weight
    if title_bound <= 2 / 3 or company_bound <= 0:
        raise ValueError("the threshold must be over 2/3 in the first field and over 0 in the second, the other being equal")
    classes = spread(
        cut_lineage(
            postings.where(F.col("id").isNotNull())
            .groupBy(_folded("title").alias("title"), _folded("company").alias("company"))
            .agg(F.min("id").alias("id"))
        )
    )
    fields = ("title", "company")
    bounds = {"title": (title_bound, TITLE_DEPTH), "company": (company_bound, COMPANY_DEPTH)}
    # Computed once per class, before its keys multiply the rows.
    keyed = cut_lineage(
        classes.withColumns(
            {f"{f}_size": F.length(f) for f in fields}
            | {f"{f}_letters": _letters(F.col(f)) for f in fields}
            | {f"{f}_key": _keys(F.col(f), *bounds[f]) for f in fields}
        )
    )
    keys = [f"{f}_key" for f in fields]
    texts = {f: _distinct_keyed(classes, f, *bounds[f]) for f in fields}
    if sum(_meetings(_exploded(texts[f], ["key"]), ["key"]) for f in fields) <= _meetings(_exploded(keyed.select(*keys), keys), keys):
        return _pairs_by_fields(classes, texts, bounds, weights, threshold)
    keyed = _exploded(keyed, keys)
    a, b = (keyed.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in keyed.columns if c not in keys)) for side in "ab")

    def reaches(bound, suffix: str) -> Column:
        most = [
            bound(*(F.col(f"{side}_{field}{end}") for end in ("_size", suffix) for side in "ab")) * weight
            for field, weight in zip(fields, weights)
        ]
        return most[0] + most[1] >= threshold - 1e-9

    # The cheap bound first; a pair can meet at several keys.
    pairs = (
        a.join(b, keys)
        .where((F.col("a_id") < F.col("b_id")) & reaches(_most_by_letters, "_letters") & reaches(_most_by_edits, ""))
        .select(*(f"{side}_{c}" for side in "ab" for c in ("id", *fields))).distinct()
    )
    similarity = sequence_ratio("a_title", "b_title") * title_weight + sequence_ratio("a_company", "b_company") * company_weight
    return pairs.select(F.col("a_id").alias("class_id"), F.col("b_id").alias("other_id"), similarity.alias("similarity")).where(
        F.col("similarity") >= threshold
    )
