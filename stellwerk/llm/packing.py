"""Best-fit packing into sequences of several permitted lengths.

Items are taken longest first.  Each goes to the open bin, of whatever capacity,
that it leaves with the least room; if none holds it, a bin is opened whose cost per
word it could still be filled with is least; at the end every bin shrinks to the
smallest permitted length that holds its contents.  A text longer than the largest
length is cut into full pieces and a rest, so nothing is lost.

Packing is sequential, so pieces are dealt by a hash to groups of bounded size and
each group is packed on its own.  The number of groups follows the number of pieces;
what a group wastes at its end is at most its few last bins, shrunk to their contents.

Defined cases: null or empty text has only its end mark; equal lengths are taken in
order of id and piece; repeated rows are items of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Permitted lengths and what a sequence of each costs: its positions and a fixed start.
LENGTHS = (1024, 2048, 4096, 8192)
START_COST = 64
GROUP_PIECES = 20_000

SCHEMA = "doc_id long, piece int, start long, length int, bin long, capacity int, offset int, fill int"


def with_lengths(documents: DataFrame) -> DataFrame:
    """doc_id and length in words, with one end mark."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("length"))


def best_fit(lengths: np.ndarray, capacities: Sequence[int], start_cost: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of items given longest first, and the final capacity of each bin."""
    capacities = sorted(capacities)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # open bins by room left
    rooms: list[int] = []  # rooms with open bins, ascending
    fills: list[int] = []
    left = int(lengths.sum())
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            free = rooms[at]
            chosen = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(at)
        else:
            free = min(
                (c for c in capacities if c >= size),
                key=lambda c: ((c + start_cost) / min(c, left), -c),
            )
            chosen = len(fills)
            fills.append(0)
        bins[i], offsets[i] = chosen, fills[chosen]
        fills[chosen] += size
        left -= size
        rest = free - size
        if rest:
            if rest not in room:
                room[rest] = []
                insort(rooms, rest)
            room[rest].append(chosen)
    shrunk = np.array(capacities, np.int64)[np.searchsorted(capacities, np.array(fills, np.int64))] if fills else np.zeros(0, np.int64)
    return bins, offsets, shrunk


def pack(
    items: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    start_cost: int = START_COST,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pack ``doc_id, length``: one row per piece with its bin, the bin's capacity and fill."""
    largest = max(lengths)
    count = items.agg(F.sum(F.ceil(F.greatest(F.col("length"), F.lit(1)) / largest))).first()[0] or 0
    groups = max(1, -(-int(count) // group_pieces))
    pieces = (
        items.select("doc_id", F.greatest(F.col("length"), F.lit(1)).alias("total"))
        .select("doc_id", "total", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / largest) - 1).cast("int"))).alias("piece"))
        .select(
            "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"),
            F.least(F.lit(largest), F.col("total") - F.col("piece").cast("long") * largest).cast("int").alias("length"),
        )
        # The position among repeated rows doesn't matter; a running number keeps one hot id from filling a group.
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id() % 64), F.lit(groups)).cast("int"))
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group.column("length").to_numpy()
        bins, offsets, capacities = best_fit(sizes, lengths, start_cost)
        fills = np.bincount(bins, weights=sizes, minlength=len(capacities)).astype(np.int32)
        number = group.column("group")[0].as_py()
        return pa.table(
            {
                **{c: group.column(c) for c in ("doc_id", "piece", "start", "length")},
                "bin": pa.array((np.int64(number) << np.int64(32)) + bins),
                "capacity": pa.array(capacities[bins].astype(np.int32)),
                "offset": pa.array(offsets.astype(np.int32)),
                "fill": pa.array(fills[bins]),
            }
        )

    return pieces.groupBy("group").applyInArrow(run, SCHEMA)
