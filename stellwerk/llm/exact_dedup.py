"""Exact dedup of texts against a history, by a minimal perfect hash of its distinct digests.

A digest names a text: SHA-256 after white-space runs have become one space.  The history's distinct
digests are dealt to buckets; each bucket has a minimal perfect hash, and in the slot of a digest
the index keeps all 32 bytes, the locator of the row that stays, and how many rows have that text.
A batch is reduced to its distinct digests, which are looked up by bucket: a slot whose bytes are
those of the digest makes its rows repeats of the located row; the others are grouped among
themselves.  ``deduplicate`` takes the lower half of the ids as history and the rest as a batch.

Copies are combined on the map side before any digest is shuffled.  Digests are joined back to rows
in two ways: those that more than one in ``HOT`` rows have - ``HOT`` at most - are broadcast, so
their rows stay where they are; all others meet at most one in ``HOT`` of the rows on one key.

Defined cases: a null text is empty, and empty texts equal each other; a text of white space only is
one space; a null id is larger than any other and stays only where no row of the group has one; rows
that repeat id and text are told apart by their locator, one of them stays; an empty table gives no
rows, an empty history no members; columns other than ``doc_id, text`` aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import perfect_hash
from stellwerk.llm.common import as_lists, stored

BUCKET_DIGESTS = 1 << 16
HOT = 4096
_CLASS = "digest binary, keep_id long, locator long, group_size long"
INDEX = "bucket int, sizes array<long>, maps binary, digests binary, keep_ids array<long>, locators array<long>, counts array<long>"
CLASSES = f"{_CLASS}, known boolean"


def digested(documents: DataFrame) -> DataFrame:
    """doc_id, digest, and a locator: a number that each row of the stored frame has for itself."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return stored(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn(
            "locator", F.monotonically_increasing_id()
        ),
        "digests",
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the id and locator of the row that stays, and the number of rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size"
    )


def bucket_count(rows: int) -> int:
    """Enough buckets for ``rows`` digests, a power of two."""
    return 1 << max(0, -(-rows // BUCKET_DIGESTS) - 1).bit_length()


def _bucket(buckets: int) -> F.Column:
    """From the digest's first bytes; the perfect hash mixes all of them again."""
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets).cast("int").alias("bucket")


def _longs(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _in_slots(group: pa.Table) -> pa.Table:
    """The index row of one bucket."""
    data = b"".join(group.column("digest").to_pylist())
    digests = perfect_hash.as_digests(data)
    sizes, maps = perfect_hash.build(digests)
    order = np.argsort(perfect_hash.slots(digests, sizes, maps))
    held = group.take(pa.array(order))
    lists = [as_lists_of(_longs(held.column(c))) for c in ("keep_id", "locator", "group_size")]
    return pa.table(
        [
            pa.array([group.column("bucket")[0].as_py()], pa.int32()), as_lists(np.array(sizes, np.int64), np.array([len(sizes)]), pa.int64()),
            pa.array([maps], pa.binary()), pa.array([digests[order].tobytes()], pa.binary()), *lists,
        ],
        ["bucket", "sizes", "maps", "digests", "keep_ids", "locators", "counts"],
    )


def as_lists_of(values: pa.Array) -> pa.ListArray:
    """One list of all values, nulls included."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(classes: DataFrame, buckets: int) -> DataFrame:
    """Index of distinct digests: one row per bucket that has any."""
    return classes.select(_bucket(buckets), "digest", "keep_id", "locator", "group_size").groupBy("bucket").applyInArrow(_in_slots, INDEX)


def _merged(key: tuple, index: pa.Table, batch: pa.Table) -> pa.Table:
    """All classes of one bucket after a batch: slots with their new counts, and nonmembers."""
    out = []
    member = np.zeros(batch.num_rows, bool)
    if index.num_rows:
        row = {c: index.column(c)[0] for c in index.column_names}
        held = perfect_hash.as_digests(row["digests"].as_py())
        counts = np.array(row["counts"].as_py(), np.int64)
        if batch.num_rows:
            asked = perfect_hash.as_digests(b"".join(batch.column("digest").to_pylist()))
            slot = perfect_hash.slots(asked, row["sizes"].as_py(), row["maps"].as_py())
            member = slot >= 0
            member[member] = (held[slot[member]] == asked[member]).all(axis=1)
            np.add.at(counts, slot[member], batch.column("group_size").to_numpy()[member])
        data = held.tobytes()
        names = [data[i : i + perfect_hash.DIGEST_BYTES] for i in range(0, len(data), perfect_hash.DIGEST_BYTES)]
        out.append([pa.array(names, pa.binary()), row["keep_ids"].values, row["locators"].values, pa.array(counts), pa.array(np.ones(len(names), bool))])
    rest = batch.filter(pa.array(~member))
    out.append([*(_longs(rest.column(c)) for c in ("digest", "keep_id", "locator", "group_size")), pa.array(np.zeros(rest.num_rows, bool))])
    kinds = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("locator", pa.int64()), ("group_size", pa.int64()), ("known", pa.bool_())])
    return pa.concat_tables([pa.Table.from_arrays(columns, schema=kinds) for columns in out])


def look_up(index: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """Classes of history and batch together: repeats count for the row that the history located.

    ``known`` tells classes of the history from those that the batch brings; a next index is
    built from all of them.
    """
    asked = classes.select(_bucket(buckets), "digest", "keep_id", "locator", "group_size")
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_merged, CLASSES)


def placed(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Rows with their class; hot digests are broadcast, ``HOT`` of them at most."""
    hot = F.col("group_size") * HOT > total
    few = F.broadcast(classes.where(hot))
    often = rows.join(few, "digest")
    seldom = rows.join(few.select("digest"), "digest", "left_anti").join(classes.where(~hot), "digest")
    return often.unionByName(seldom)


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known of every row.

    ``known``: the text was in the history, which is the lower half of the ids.
    """
    rows = digested(documents.select("doc_id", "text")).withColumnRenamed("locator", "row")
    seen = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    buckets = bucket_count(seen.n)
    middle = (seen.low + seen.high) // 2 if seen.low is not None else 0
    in_history = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    located = rows.withColumnRenamed("row", "locator")
    index = stored(build_index(distinct_digests(located.where(in_history)), buckets), "digest-index")
    classes = stored(look_up(index, distinct_digests(located.where(~in_history)), buckets), "digest-classes")
    return placed(rows, classes, seen.n).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known"
    )
