"""Merkle manifest of a dataset, its levels kept as strings of concatenated digests.

Every row is a leaf.  The leaves of one key (here a language) are numbered in order and cut into
aligned blocks of ``BLOCK`` = 8**3; a block keeps each of its levels as one string of hex digests.
The parents of a level are hashes of its substrings of 8 digests; a node's siblings are the two
substrings beside it.  The tops of all blocks of a key are the nodes of the next round, until each
key has one node; then the keys' tops are combined likewise.  Going down again, every block learns
the path from its top to the root, and every leaf's path is its block's with its own segments before.

Everything is DataFrame and SQL functions.  Nodes are numbered without a global sort task: they
are range-partitioned with the row as last key (so equal rows spread too), numbered within the
partition, and moved by the sizes of the partitions before.  A group holds ``BLOCK`` nodes at most.

Defined cases: null columns are ``-``; a null id sorts first and is never tampered with; rows with
one id sort by their leaf, so equal rows are neighbours whose order does not matter; a null key is
a key of its own, before all others; a single leaf is its key's top, and a single key's top the
root; an empty table gives no rows; columns other than those of the leaf aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.common import stored

FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
HEX = 64  # characters of a digest
RUN = FAN * HEX
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(documents: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row: the byte count and value of every column."""
    columns = {c: F.col(c) for c in LEAF_COLUMNS} | ({} if text is None else {"text": text})
    return F.sha2(F.concat(*[_field(columns[c]) for c in LEAF_COLUMNS]), 256)


def with_leaves(documents: DataFrame) -> DataFrame:
    """key (ordered as languages are, null first), doc_id, leaf, and the leaf of a changed row where it is changed."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key"), "doc_id", leaf(documents).alias("leaf"),
        F.when(changed, leaf(documents, F.translate("text", _UPPER, _LOWER))).alias("changed_leaf"),
    )


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``place`` (from 0 within the key, by ``order``) and ``total`` (nodes of the key)."""
    rows = nodes.withColumn("_row", F.monotonically_increasing_id())
    ranged = stored(
        rows.repartitionByRange("key", *order, "_row").sortWithinPartitions("key", *order, "_row").drop("_row")
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)),
        "merkle-order",
    )
    # One row per partition and key.
    sizes = ranged.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "key", "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_move"), F.sum("_size").over(whole).alias("total")
    )
    return ranged.join(starts, ["key", "_part"]).withColumn("place", F.col("_at") + F.col("_move")).drop("_at", "_part", "_move")


def _parents(level: str) -> Column:
    """The next level: one digest for every substring of eight."""
    runs = f"sequence(0, (octet_length({level}) - 1) div {RUN})"
    return F.expr(f"cast(array_join(transform({runs}, i -> sha2(substring({level}, i * {RUN} + 1, {RUN}), 256)), '') as binary)")


def blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of nodes (key, place, total, node, held): their members, levels, depth and top.

    ``depth`` is the number of levels above the members that the tree has within this block.
    """
    grouped = nodes.groupBy("key", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", "node", "held"))).alias("members")
    )
    depth = F.when(F.col("total") <= 1, 0)
    for level in range(1, BLOCK_LEVELS):
        depth = depth.when(F.col("total") <= FAN**level, level)
    built = grouped.withColumn("depth", depth.otherwise(BLOCK_LEVELS)).withColumn("l0", F.array_join("members.node", "").cast("binary"))
    for level in range(1, BLOCK_LEVELS + 1):
        built = built.withColumn(f"l{level}", F.when(F.col("depth") >= level, _parents(f"l{level - 1}")))
    top = F.coalesce(*[F.col(f"l{level}") for level in range(BLOCK_LEVELS, -1, -1)])
    return built.select(
        "key", "block", "total", "depth", F.expr("transform(members, m -> m.held)").alias("held"),
        *[f"l{level}" for level in range(BLOCK_LEVELS)], top.cast("string").alias("top"),
    )


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of all rounds, up to the round in which every key has one block."""
    rounds = []
    while True:
        built = stored(blocks(nodes), "merkle-blocks")
        rounds.append(built)
        if not built.where(F.col("total") > BLOCK).limit(1).count():
            return rounds
        nodes = built.select(
            "key", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("top").alias("node"), F.lit(0).alias("held")
        )


def segments(levels: int) -> str:
    """SQL of the segments beside member i of a block, from its own level up to the block's top."""
    pairs = []
    for level in range(levels):
        at = f"i div {FAN**level}"
        pairs.append(
            f"""struct(substring(l{level}, ({at} - {at} % {FAN}) * {HEX} + 1, {at} % {FAN} * {HEX}) as before,
              substring(l{level}, ({at} + 1) * {HEX} + 1, ({FAN - 1} - {at} % {FAN}) * {HEX}) as after)"""
        )
    return f"slice(array({', '.join(pairs)}), 1, depth)"


_SEGMENTS = segments(BLOCK_LEVELS)


def _members(built: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with ``paths``: of each member its held value, node, and segments up to the root; joined with the path of the block.

    ``above`` has (key, block, path, further columns).
    """
    return built.join(above, ["key", "block"]).withColumn(
        "paths", F.expr(f"transform(held, (h, i) -> struct(h as held, cast(substring(l0, i * {HEX} + 1, {HEX}) as string) as node, concat({_SEGMENTS}, path) as path))")
    )


def _descend(rounds: list[DataFrame], above: DataFrame, further: list[str]) -> DataFrame:
    """Paths of the lowest round's members, as ``_members`` gives them, from those of the highest round's blocks."""
    for built in reversed(rounds[1:]):
        lower = _members(built, above).select("key", "block", F.posexplode("paths").alias("i", "p"), *further)
        above = lower.select("key", (F.col("block") * BLOCK + F.col("i")).alias("block"), "p.path", *further)
    return _members(rounds[0], above)


def fold(start: str, path: str) -> str:
    """SQL of the root that a leaf and its path of segments give."""
    return f"cast(aggregate({path}, cast({start} as binary), (n, s) -> cast(sha2(concat(s.before, n, s.after), 256) as binary)) as string)"


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    leaves = stored(with_leaves(documents), "merkle-leaves")
    nodes = numbered(leaves, "doc_id", "leaf").select(
        "key", "place", "total", F.col("leaf").alias("node"), F.struct("doc_id", "changed_leaf").alias("held")
    )
    rounds = _climb(nodes)
    tops = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("held"), F.col("top").alias("node"))
    key_rounds = _climb(numbered(tops, "held"))

    no_path = F.expr("cast(array() as array<struct<before: binary, after: binary>>)")
    summit = key_rounds[-1].select("key", "block", no_path.alias("path"), F.col("top").alias("root"))
    keys = _descend(key_rounds, summit, ["root"]).select("root", F.explode("paths").alias("p"))
    above = keys.select(F.col("p.held").alias("key"), F.lit(0).cast("long").alias("block"), "p.path", "root", F.col("p.node").alias("subroot"))

    known = _descend(rounds, above, ["root", "subroot"])
    siblings = "aggregate(p.path, cast('' as binary), (a, s) -> concat(a, s.before, s.after))"
    told = f"""transform(paths, p -> struct(p.held.doc_id as doc_id, p.node as leaf, sha2({siblings}, 256) as proof_sha256,
      {fold("coalesce(p.held.changed_leaf, p.node)", "p.path")} as folded_root))"""
    return (
        known.select("root", "subroot", F.explode(F.expr(told)).alias("t"))
        .select("t.doc_id", "t.leaf", "subroot", "root", "t.proof_sha256", "t.folded_root", (F.col("t.folded_root") == F.col("root")).alias("verified"))
    )
