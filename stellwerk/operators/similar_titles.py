"""Similar titles within a company, found without comparing all pairs.

A ratio of r over titles of lengths m and n needs a common subsequence of at
least r*(m+n)/2 characters, hence as many common characters counted with
repetition.  That turns the search into a set-overlap join: a title becomes the
set of its (character, occurrence) tokens, tokens get one global order with
unusual ones first, and two sets that share t tokens must share ``depth`` of
them within their first size-t+depth tokens.  Those prefix combinations are
the join keys.  The bound is exact - no similar pair is lost - and small
companies use depth 1 (few keys) while companies with many titles use depth 2
or 3 (much rarer keys), so one huge company is spread over many keys instead of
landing in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.similarity import sequence_ratio
from stellwerk.session import cut_lineage, spread

# Rough letter shares per thousand in German and English text.  Only the token
# order, i.e. speed, depends on them.
_LETTER_SHARE = {
    " ": 120, "a": 62, "b": 19, "c": 30, "d": 48, "e": 150, "f": 16, "g": 30, "h": 45, "i": 78,
    "j": 2, "k": 13, "l": 35, "m": 27, "n": 95, "o": 30, "p": 10, "q": 1, "r": 72, "s": 68,
    "t": 65, "u": 42, "v": 8, "w": 17, "x": 1, "y": 5, "z": 11,
}
_OTHER_SHARE = 4
# Titles per company from which longer key combinations pay off.
DEPTH_2_FROM = 256
DEPTH_3_FROM = 20_000
# Leaders of a company that are simply compared with all its titles.
FEW_LEADERS = 32
# Shortest title that can resemble a different one: 'abc' in 'abcd'.
SHORTEST = 3


def _tokens(title: Column) -> Column:
    """Distinct (character, occurrence) tokens in the global order, unusual first."""
    shares = F.create_map([F.lit(x) for pair in _LETTER_SHARE.items() for x in pair])

    def token(char: Column, index: Column) -> Column:
        head = F.substring(title, F.lit(1), index + 1)
        nth = F.length(head) - F.length(F.replace(head, char, F.lit("")))
        share = F.coalesce(F.try_element_at(shares, char), F.lit(_OTHER_SHARE))
        rank = F.lpad(F.floor(share * 1000 / F.greatest(nth, F.lit(1))).cast("string"), 6, "0")
        return F.concat(rank, char, nth.cast("string"))

    return F.array_sort(F.transform(F.split(title, ""), token))


def _needed(total_length: Column, threshold: float) -> Column:
    """Fewest common characters two titles of this summed length need."""
    return F.ceil(total_length * (threshold / 2) - 1e-9)


def _combinations(tokens: Column, depth: int) -> Column:
    """All ordered token combinations of one size, as strings."""
    def rest(start: Column) -> Column:
        return F.slice(tokens, start, F.greatest(F.size(tokens) - start + 1, F.lit(0)))

    if depth == 1:
        return tokens
    if depth == 2:
        return F.flatten(
            F.transform(tokens, lambda a, i: F.transform(rest(i + 2), lambda b: F.concat(a, b)))
        )
    return F.flatten(
        F.flatten(
            F.transform(
                tokens,
                lambda a, i: F.transform(
                    rest(i + 2),
                    lambda b, j: F.transform(rest(i + j + 3), lambda c: F.concat(a, b, c)),
                ),
            )
        )
    )


def _with_keys(titles: DataFrame, role: str, threshold: float) -> DataFrame:
    """One row per title and join key for its role as the shorter or longer title."""
    length = F.length("title")
    if role == "short":
        needed = _needed(length * 2, threshold)
    else:
        shortest_partner = F.ceil(length * (threshold / (2 - threshold)) - 1e-9)
        needed = _needed(length + shortest_partner, threshold)
    prefix = F.slice(_tokens(F.col("title")), F.lit(1), length - needed.cast("int") + F.col("depth"))
    # Shorter titles have no unequal partner (see _check).
    prepared = titles.where(length >= SHORTEST).withColumn("prefix", prefix)
    keys = (
        F.when(F.col("depth") == 1, _combinations(F.col("prefix"), 1))
        .when(F.col("depth") == 2, _combinations(F.col("prefix"), 2))
        .otherwise(_combinations(F.col("prefix"), 3))
    )
    return prepared.withColumn("key", F.explode(keys)).drop("prefix")


def _within(a: str, b: str, most: Column) -> Column:
    """Whether two different texts are at most so many edits apart; given up as soon as it is more."""
    return F.call_function("levenshtein", F.col(a), F.col(b), F.greatest(most, F.lit(0)).cast("int")) >= 0


def _candidates(short: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Pairs (short, long) of different titles that reach the character overlap, each once."""
    a = _with_keys(short, "short", threshold).select(
        F.col("company_key").alias("company_key"), "depth", "key", F.col("title").alias("a"),
        *[F.col(c).alias(f"a_{c}") for c in ("first_seq", "last_seq")],
    )
    b = _with_keys(long, "long", threshold).select(
        F.col("company_key").alias("company_key"), "depth", "key", F.col("title").alias("b"),
        *[F.col(c).alias(f"b_{c}") for c in ("first_seq", "last_seq")],
    )
    pairs = a.join(b, ["company_key", "depth", "key"])
    m, n = F.length("a"), F.length("b")
    needed = _needed(m + n, threshold)
    # Both tests are upper bounds of the ratio and run inside the JVM: unmatched
    # characters of either title are edits, so the edit distance is at most
    # their number.
    fits = (F.col("a") != F.col("b")) & (m <= n) & (m >= needed)
    close = _within("a", "b", m + n - needed * 2)
    # A pair can meet at several keys.
    return pairs.where(fits & close).drop("depth", "key").distinct()


def key_depth(n: Column) -> Column:
    """Key size of a company with so many titles."""
    return F.when(n > DEPTH_3_FROM, 3).when(n > DEPTH_2_FROM, 2).otherwise(1)


def with_depth(*sides: DataFrame) -> list[DataFrame]:
    """Attach the key size; it depends on the titles a company has on all sides together.

    Companies with one title have nothing to compare and drop out here.
    """
    counted = None
    for side in sides:
        part = side.groupBy("company_key").agg(F.count("*").alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    n = F.sum("n")
    depths = counted.groupBy("company_key").agg(key_depth(n).alias("depth"), n.alias("n")).where("n > 1").drop("n")
    # Each side feeds several joins: computed once, and spread, because a title
    # is few bytes but many keys.
    return [spread(cut_lineage(side.join(depths, "company_key"))) for side in sides]


def _check(threshold: float) -> None:
    # Below this, two unequal titles may need fewer than three common characters.
    if threshold < K.FUZZY_THRESHOLD:
        raise ValueError(f"threshold must be at least {K.FUZZY_THRESHOLD}")


def similar_within(titles: DataFrame, threshold: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """Directed pairs (company_key, title, earlier_title) of different similar titles.

    ``titles``: distinct (company_key, title) with first_seq and last_seq.  A
    direction is tested only if some row of the one title can follow the other.
    """
    _check(threshold)
    (sized,) = with_depth(titles)
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    pairs = _candidates(sized, sized, threshold).where(once)
    directions = F.array(
        F.struct(
            F.col("a").alias("title"), F.col("b").alias("earlier_title"),
            (F.col("a_last_seq") > F.col("b_first_seq")).alias("possible"),
        ),
        F.struct(
            F.col("b").alias("title"), F.col("a").alias("earlier_title"),
            (F.col("b_last_seq") > F.col("a_first_seq")).alias("possible"),
        ),
    )
    directed = pairs.select("company_key", F.explode(directions).alias("d")).where("d.possible")
    flat = directed.select("company_key", "d.title", "d.earlier_title")
    return flat.where(sequence_ratio("title", "earlier_title") >= threshold)


def similar_to_stored(
    titles: DataFrame, stored: DataFrame, threshold: float = K.FUZZY_THRESHOLD
) -> DataFrame:
    """Distinct (company_key, title) that equal or resemble a stored title of the company.

    Every stored title counts as earlier.
    """
    _check(threshold)
    here = cut_lineage(
        stored.join(titles.select("company_key").distinct(), "company_key", "left_semi")
    )
    equal = titles.join(here, ["company_key", "title"], "left_semi").select("company_key", "title")
    open_titles = titles.join(here, ["company_key", "title"], "left_anti")
    no_seq = here.withColumns(
        {"first_seq": F.lit(None).cast("bigint"), "last_seq": F.lit(None).cast("bigint")}
    )
    new, old = with_depth(open_titles, no_seq)
    as_short = _candidates(new, old, threshold).select(
        "company_key", F.col("a").alias("title"), F.col("b").alias("earlier_title")
    )
    # Equal lengths meet in both roles; keep them in the first only.
    as_long = (
        _candidates(old, new, threshold)
        .where(F.length("a") < F.length("b"))
        .select("company_key", F.col("b").alias("title"), F.col("a").alias("earlier_title"))
    )
    similar = as_short.unionByName(as_long).where(
        sequence_ratio("title", "earlier_title") >= threshold
    )
    return equal.unionByName(similar.select("company_key", "title")).distinct()


def similar_to_leaders(titles: DataFrame, leaders: DataFrame, threshold: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """As ``similar_to_stored``; a company with few leaders compares each title with each of them.

    So a burst of copies of one title costs about one comparison a title, however long its keys.
    """
    _check(threshold)
    sizes = leaders.groupBy("company_key").agg((F.count("*") <= FEW_LEADERS).alias("few"))
    sized = cut_lineage(leaders.join(sizes, "company_key"))
    few = sized.where("few").select("company_key", F.col("title").alias("leader"))
    m, n = F.length("title"), F.length("leader")
    needed = _needed(m + n, threshold)
    close = (F.least(m, n) >= needed) & _within("title", "leader", m + n - needed * 2)
    alike = (F.col("title") == F.col("leader")) | (close & (sequence_ratio("title", "leader") >= threshold))
    direct = titles.join(few, "company_key").where(alike).select("company_key", "title").distinct()
    many = sized.where(~F.col("few")).select("company_key", "title")
    if many.isEmpty():
        return direct
    return direct.unionByName(similar_to_stored(titles, many, threshold))


def candidate_pairs(titles: DataFrame, threshold: float) -> DataFrame:
    """company_key, pairs: how often two titles meet at a join key, from the keys' frequencies.

    ``titles`` carry the ``depth`` of their keys.
    """
    counted = [
        _with_keys(titles, role, threshold).groupBy("company_key", "depth", "key").agg(F.count("*").alias(role))
        for role in ("short", "long")
    ]
    met = counted[0].join(counted[1], ["company_key", "depth", "key"])
    return met.groupBy("company_key").agg(F.sum(F.col("short") * F.col("long")).alias("pairs"))
