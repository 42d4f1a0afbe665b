"""Settling labels inside a batch: every row is decided once, and leaves.

A label depends on the labels of earlier rows with the same source id, canonical id, URL or title,
or a similar title.  Of each dependency two bounds are known: what *certainly* holds, from rows
already decided, and what is still *possible*, from rows that are not.  A row whose bounds agree is
decided for good; its effects are marked on the rows still open, and it takes no part in later
joins.  So a round costs what is still open, not what the batch holds.

Long chains - each row waits for the one before it - would still take a round per row.  When a
round decides less than a third of the open rows, they are therefore split into connected
components, and each component of at most ``COMPONENT_ROWS`` rows is decided by the row-by-row rule
inside one task.  Larger ones go on by rounds, which break them up; after the next ``ROUNDS`` slow
rounds they are looked at again.

Companies whose titles would give too many similar pairs are compared in slices: the earliest few
open titles first; once the accepted ones among them - the leaders - are known, they take their
copies out of the remaining titles, and the next slice is twice as large.  A title not compared yet
counts as possibly similar, so nothing is decided too soon.  All such companies take a slice at the
same time, and rows of other companies are not read again.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.operators.similar_titles import candidate_pairs, key_depth, similar_to_leaders, similar_within
from stellwerk.session import cut_lineage

NEW, BY_SOURCE_ID, BY_HASH, BY_TITLE = "new", "source_id", "canonical_id", "similar_title"

# Companies with more open titles than this are looked at for density.
SLICE_TITLES = 4096
# Candidate pairs a title may bring before its company is compared in slices.
PAIRS_PER_TITLE = 256
SAMPLE_TITLES = 4096
FIRST_SLICE = 256
ROUNDS = 4
COMPONENT_ROWS = 5000

TITLE = ["company_key", "title"]


def title_ranges(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*TITLE).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def dense_companies(titles: DataFrame, threshold: float, slice_titles: int) -> DataFrame:
    """Companies whose titles would meet at too many join keys: company_key.

    Of every large company, about ``SAMPLE_TITLES`` titles are drawn by hash; their pairs are
    counted from the frequencies of the keys, not formed.  The answer steers the slicing, never
    the labels.
    """
    sizes = titles.groupBy("company_key").agg(F.count("*").alias("n")).where(F.col("n") > slice_titles)
    large = cut_lineage(sizes)
    if large.isEmpty():
        return large.select("company_key")
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_TITLES)) / F.col("n"))
    drawn = F.pmod(F.xxhash64("title"), F.lit(1 << 30)) < share * (1 << 30)
    sample = titles.join(large, "company_key").where(drawn).withColumn("depth", key_depth(F.col("n"))).drop("n")
    pairs = candidate_pairs(sample, threshold)
    dense = F.col("pairs") > F.col("n") * share * share * PAIRS_PER_TITLE
    return large.join(pairs, "company_key").where(dense).select("company_key")


def _first_guess() -> Column:
    """Labels that the stored tables alone decide."""
    return F.when(F.col("stored_job").isNotNull(), BY_SOURCE_ID)


def _start(rows: DataFrame) -> DataFrame:
    """Open rows: keys, label where known, and what is certain about each."""
    return rows.select(
        "seq", "url", "source_key", "canonical_id", *TITLE,
        (F.col("has_source_id") & ~F.col("stored_url")).alias("brings_id"),
        _first_guess().alias("label"), F.lit(False).alias("id_yes"), F.col("stored_hash").alias("hash_yes"),
        F.col("stored_title").alias("title_yes"), F.lit(False).alias("no_link"), F.lit(False).alias("dense"), F.lit(True).alias("compared"),
    )


def _may_be_new() -> Column:
    return F.col("label").isNull() & ~(F.col("id_yes") | F.col("hash_yes") | F.col("title_yes"))


def _least(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("seq")))


def _round(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Bounds from the open rows and those just decided; labels where the bounds agree.

    Adds ``before`` (the label at the start), ``waits`` (a decided row whose link is still
    uncertain) and ``marks`` (a row that later open rows may depend on).
    """
    seq = F.col("seq")
    is_new, maybe_new, last_open = F.col("label") == NEW, _may_be_new(), F.max(F.when(F.col("label").isNull(), F.col("seq")))
    by_hash = rows.groupBy("canonical_id").agg(
        _least(is_new).alias("hash_new"), _least(maybe_new).alias("hash_maybe"), last_open.alias("hash_open")
    )
    own_title = rows.groupBy(*TITLE).agg(
        _least(is_new).alias("title_new"), _least(maybe_new).alias("title_maybe"), last_open.alias("title_open")
    )
    nothing = F.lit(None).cast("bigint")
    via_earlier = (
        edges.join(own_title.withColumnRenamed("title", "earlier_title"), ["company_key", "earlier_title"])
        .select(*TITLE, "title_new", "title_maybe", nothing.alias("title_open"))
    )
    to_later = edges.join(own_title, TITLE).select(
        "company_key", F.col("earlier_title").alias("title"), nothing.alias("title_new"), nothing.alias("title_maybe"), "title_open"
    )
    by_title = own_title.unionByName(via_earlier).unionByName(to_later).groupBy(*TITLE).agg(
        F.min("title_new").alias("title_new"), F.min("title_maybe").alias("title_maybe"), F.max("title_open").alias("title_open")
    )
    # The first row of a URL that is not dropped makes the link.
    stays = F.coalesce(F.col("label") != BY_TITLE, F.col("id_yes") | F.col("hash_yes"))
    may_stay = F.coalesce(F.col("label") != BY_TITLE, F.lit(True))
    by_url = rows.where(~F.col("no_link")).groupBy("url").agg(
        _least(stays).alias("url_sure"), _least(may_stay).alias("url_maybe"), F.max("seq").alias("url_last")
    )
    linked = rows.join(by_url, "url", "left").withColumns(
        {
            "no_link": F.col("no_link") | F.coalesce(F.col("url_sure") < seq, F.lit(False)),
            "sure_link": ~F.col("no_link") & stays & (F.col("url_maybe") == seq),
            "maybe_link": ~F.col("no_link") & may_stay & F.coalesce(F.col("url_sure") >= seq, F.lit(True)),
        }
    )
    brings = F.col("brings_id")
    by_id = linked.groupBy("source_key").agg(
        _least(brings & F.col("sure_link")).alias("id_sure"), _least(brings & F.col("maybe_link")).alias("id_maybe"), last_open.alias("id_open")
    )
    before = lambda column: F.coalesce(F.col(column) < seq, F.lit(False))
    known = (
        linked.join(by_hash, "canonical_id", "left").join(by_title, TITLE, "left").join(by_id, "source_key", "left")
        .withColumns(
            {
                "id_yes": F.col("id_yes") | before("id_sure"), "hash_yes": F.col("hash_yes") | before("hash_new"),
                "title_yes": F.col("title_yes") | before("title_new"),
            }
        )
    )
    no_id, no_hash = ~before("id_maybe"), ~before("hash_maybe")
    no_title = ~before("title_maybe") & F.col("compared")
    label = F.coalesce(
        "label",
        F.when(F.col("id_yes"), BY_SOURCE_ID)
        .when(no_id & F.col("hash_yes"), BY_HASH)
        .when(no_id & no_hash & F.col("title_yes"), BY_TITLE)
        .when(no_id & no_hash & no_title, NEW),
    )
    after = lambda column: F.coalesce(F.col(column) > seq, F.lit(False))
    accepted = F.coalesce(label == NEW, F.lit(False))
    marks = (accepted & (after("hash_open") | after("title_open"))) | (~F.col("no_link") & after("url_last")) | (brings & after("id_open"))
    return known.select(
        *[c for c in rows.columns if c != "label"], label.alias("label"), F.col("label").alias("before"),
        # A decided row stays while it may make a link, but an earlier row may make it first.
        (brings & F.col("maybe_link") & ~F.col("sure_link")).alias("waits"), marks.alias("marks"),
    )


def _decide(component: pd.DataFrame) -> pd.DataFrame:
    """The row-by-row rule over one component, in arrival order."""
    component = component.sort_values("seq")
    hashes, titles, urls, ids, labels = set(), set(), set(), set(), []
    for r in component.itertuples():
        label = r.label
        if label is None:
            if r.id_yes or r.source_key in ids:
                label = BY_SOURCE_ID
            elif r.hash_yes or r.canonical_id in hashes:
                label = BY_HASH
            elif r.title_yes or any((r.company_key, t) in titles for t in (r.title, *r.earlier)):
                label = BY_TITLE
            else:
                label = NEW
        if label == NEW:
            hashes.add(r.canonical_id)
            titles.add((r.company_key, r.title))
        if label != BY_TITLE and not r.no_link and r.url not in urls:
            urls.add(r.url)
            if r.brings_id:
                ids.add(r.source_key)
        labels.append(label)
    return pd.DataFrame({"seq": component["seq"], "decided": labels})


def components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """seq, component: rows that share a key or have similar titles, named by their smallest seq.

    Names spread along the edges and then jump to the name of the named row, so that chains
    halve with each turn.
    """
    shared = []
    for key in (["source_key"], ["canonical_id"], ["url"], TITLE):
        first = rows.groupBy(*key).agg(F.min("seq").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
        shared.append(rows.join(first, key).select("seq", "other"))
    firsts = rows.groupBy(*TITLE).agg(F.min("seq").alias("seq"))
    similar = (
        edges.join(firsts, TITLE)
        .join(firsts.select("company_key", F.col("title").alias("earlier_title"), F.col("seq").alias("other")), ["company_key", "earlier_title"])
        .select("seq", "other")
    )
    links = reduce(DataFrame.unionByName, [*shared, similar]).where("seq <> other").distinct()
    both = cut_lineage(links.unionByName(links.select(F.col("other").alias("seq"), F.col("seq").alias("other"))).distinct())
    names = rows.select("seq", F.col("seq").alias("component"))
    while True:
        told = both.join(names.withColumnRenamed("seq", "other"), "other").groupBy("seq").agg(F.min("component").alias("told"))
        nearer = names.join(told, "seq", "left").select("seq", F.col("component").alias("was"), F.least("component", F.coalesce("told", "component")).alias("component"))
        jumps = nearer.select(F.col("seq").alias("component"), F.col("component").alias("next"))
        moved = cut_lineage(
            nearer.join(jumps, "component").select("seq", "was", F.least("component", "next").alias("component"))
        )
        changed = moved.where("component <> was").limit(1).count()
        names = moved.select("seq", "component")
        if not changed:
            return names


def _by_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Open rows with the labels of small components filled in, as a round gives them."""
    named = rows.join(components(rows, edges), "seq")
    # A component with a title not compared yet must wait.
    settled = F.col("compared") | F.col("label").isNotNull() | F.col("title_yes")
    small = (
        named.groupBy("component").agg(F.count("*").alias("n"), F.min(settled).alias("ready"))
        .where(F.col("ready") & (F.col("n") <= COMPONENT_ROWS)).select("component")
    )
    earlier = edges.groupBy(*TITLE).agg(F.collect_list("earlier_title").alias("earlier"))
    nothing = F.array().cast("array<string>")
    ready = named.join(small, "component").join(earlier, TITLE, "left").withColumn("earlier", F.coalesce("earlier", nothing))
    decided = ready.groupBy("component").applyInPandas(_decide, "seq long, decided string")
    told = rows.join(decided, "seq", "left")
    label = F.coalesce("label", "decided")
    # Rows of decided components have had all their effects.
    return told.select(
        *[c for c in rows.columns if c != "label"], label.alias("label"), F.col("label").alias("before"),
        (F.col("label").isNotNull() & F.col("decided").isNull()).alias("waits"), F.lit(False).alias("marks"),
    )


class Settling:
    """Open rows of a batch, what has been decided of it, and the titles still to be compared.

    ``rows`` are posting keys with the facts against the stored tables.
    """

    def __init__(self, rows: DataFrame, threshold: float, slice_titles: int | None = None):
        self.threshold = threshold
        #: Rows that took part in each round, for tests and logs.
        self.joined: list[int] = []
        #: Slices of titles that dense companies were compared in.
        self.slices = 0
        # A title that resembles a stored one is never accepted, so nothing later can match it.
        titles = cut_lineage(title_ranges(rows.where(~F.col("stored_title"))))
        dense = cut_lineage(dense_companies(titles, threshold, SLICE_TITLES if slice_titles is None else slice_titles))
        self.waiting = not dense.isEmpty()
        started = _start(rows)
        if self.waiting:
            titles = titles.join(dense, "company_key", "left_anti")
            started = (
                started.join(dense.withColumn("is_dense", F.lit(True)), "company_key", "left")
                .withColumns({"dense": F.coalesce("is_dense", F.lit(False)), "compared": F.col("is_dense").isNull()}).drop("is_dense")
            )
        self.plain_edges = cut_lineage(similar_within(titles, threshold))
        self.edges = self.plain_edges
        self.open = started
        self._decided: list[DataFrame] = []
        self._leaders: list[DataFrame] = []

    def labels(self) -> DataFrame:
        """seq, label of all rows."""
        slow = ROUNDS - 1
        while True:
            after = cut_lineage(_round(self.open, self.edges))
            is_open = F.col("label").isNull()
            seen = after.agg(
                F.count("*").alias("rows"), F.count_if(is_open).alias("open"), F.count_if(is_open & F.col("compared")).alias("ready"),
                F.count_if(is_open & F.col("compared") & F.col("dense")).alias("in_slices"),
                F.count_if(F.col("before").isNull() & ~is_open).alias("fresh"),
            ).first()
            self.joined.append(seen.rows)
            self._take(after)
            if not seen.open:
                return reduce(DataFrame.unionByName, self._decided)
            slow += 3 * seen.fresh < seen.ready + seen.fresh
            if self.waiting and not (seen.fresh and seen.in_slices):
                self._next_slice()
                slow = ROUNDS - 1
            elif slow >= ROUNDS:
                self._decide_components()
                slow = 0

    def _take(self, after: DataFrame) -> None:
        """Move decided rows out; those that open rows may depend on stay for one round more."""
        fresh = F.col("before").isNull() & F.col("label").isNotNull()
        # Rows that the stored tables decided are counted with the first round.
        out = after.where(fresh if self._decided else F.col("label").isNotNull())
        self._decided.append(out.select("seq", "label"))
        if self.waiting:
            self._leaders.append(out.where(F.col("dense") & (F.col("label") == NEW)).select(*TITLE))
        stays = F.col("label").isNull() | F.col("waits") | (fresh & F.col("marks") & (F.col("label") != BY_TITLE))
        self.open = after.where(stays).drop("before", "waits", "marks")

    def _decide_components(self) -> None:
        after = cut_lineage(_by_components(self.open, self.edges))
        self.joined.append(after.count())
        self._take(after)

    def _next_slice(self) -> None:
        """Leaders take their copies out; then the earliest of the remaining titles are compared."""
        self.slices += 1
        undecided = F.col("label").isNull() & ~F.col("title_yes")
        later = F.col("dense") & ~F.col("compared")
        leaders = cut_lineage(reduce(DataFrame.unionByName, self._leaders).distinct())
        self._leaders = [leaders.limit(0)]
        # Leaders stand before every row that has not been compared.
        copies = similar_to_leaders(title_ranges(self.open.where(later & undecided)), leaders, self.threshold)
        marked = cut_lineage(
            self.open.join(copies.withColumn("copy", F.lit(True)), TITLE, "left")
            .withColumn("title_yes", F.col("title_yes") | (later & F.coalesce("copy", F.lit(False)))).drop("copy")
        )
        bounds = _slice_bounds(title_ranges(marked.where(later & undecided)), FIRST_SLICE << min(self.slices - 1, 40))
        self.open = cut_lineage(
            marked.join(bounds, "company_key", "left")
            .withColumn("compared", F.col("compared") | F.coalesce(F.col("seq") <= F.col("bound"), F.lit(True))).drop("bound")
        )
        # Titles of earlier slices that are still open are compared with the new ones, too.
        now = title_ranges(self.open.where(F.col("dense") & F.col("compared") & undecided))
        self.edges = cut_lineage(self.plain_edges.unionByName(similar_within(now, self.threshold)))
        self.waiting = self.open.where(later).limit(1).count() > 0


def _slice_bounds(titles: DataFrame, size: int) -> DataFrame:
    """company_key, bound: about ``size`` of a company's titles, at least one, start at or before it.

    Quantiles are merged from partial sketches, so no company's titles are sorted in one task.
    """
    halvings = 40
    shares = F.array(*[F.lit(0.5**k) for k in range(1, halvings + 1)])
    found = titles.groupBy("company_key").agg(F.count("*").alias("n"), F.percentile_approx("first_seq", shares).alias("at"))
    step = F.least(F.ceil(F.log2(F.col("n") / size)).cast("int"), F.lit(halvings))
    return found.where(F.col("n") > size).select("company_key", F.element_at("at", F.greatest(step, F.lit(1))).alias("bound"))
