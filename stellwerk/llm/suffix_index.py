"""Suffix-array deduplication: a logarithmic family of indexes over all texts' bytes.

A byte is removed if a 200-byte string that covers it also starts anywhere else.

Every window of 200 bytes names one of its positions by content alone, the one whose first
64 bytes hash least.  A suffix array over these anchors only - about one per 69 bytes - still
meets every window, because equal windows name equal anchors.  An entry is the anchor's
first bytes (its order), a fingerprint of all bytes that its windows span, how often that
context occurred, and where first.

The index is a family of levels.  A new batch is sorted into a suffix array of its own and
merge-scanned against all levels; then it and levels of equal size become one level, so
every entry is rewritten a logarithmic number of times.  A scan tells, of new and of old
anchors: the whole context occurs elsewhere (all windows are repeated); or only its beginning
does, in another context.  Of the latter, one per context compares its windows one by one.

Arrays travel packed, dealt by hash into buckets whose number follows the input.  Before they
do, a task reduces its entries, half a million at a time (a unit): a context is one entry of
its unit however often it occurs there, and so is an anchor, with one of its contexts and
whether there are more.  What is decided goes back to units, not to occurrences.  Windows that
are compared are reduced in the same way, per pass over texts.

Defined cases: null counts as the empty text; texts of fewer than 200 bytes lose nothing;
repeated rows are occurrences like any others; a null id needs nothing special; ties don't
arise; an empty table gives no rows; columns other than those asked for aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm.common import RangeHash, filled, fresh_folder, mixed, passes, ragged, remove, stored, text_bytes, tidy, tidy_group, tidy_pair, write_out

LENGTH = 200
GRAM = 64  # long enough that unrelated texts hardly share one
WIDTH = LENGTH - GRAM + 1
BUCKET_BYTES = 100 << 20
SLICE_BYTES = 512 << 10  # each byte takes about 100 while anchors are chosen
_PLACE_BITS = 28
UNIT_ENTRIES = 1 << 19  # anchors that are reduced at once
_FULL, _COMPARE, _LATER = 1, 2, 4


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, hashes: RangeHash):
    """Per anchor: its text, first and last window, order and fingerprint; and its place."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = hashes.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WIDTH)
    starts = np.arange(n - LENGTH + 1)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[: n - LENGTH + 1] == of[LENGTH - 1 :]
    starts, place, of = starts[inside], (least & low).astype(np.int64)[inside], of[: n - LENGTH + 1][inside]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(first)
    begin, end = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return of[at], begin, end, grams[place[at]], hashes.of(begin, end + LENGTH)


def _pack(*columns) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


_ROWS = "kind string, bucket int, slice long, keys binary, prints binary, a binary, b binary"
_NAMES = ["kind", "bucket", "slice", "keys", "prints", "a", "b"]
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], _NAMES)


def _joined(rows: list[dict], column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _row_key() -> F.Column:
    """The same for rows that repeat id and text only."""
    return F.xxhash64("doc_id", "text")


def _dealt(bits: int, by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Bucket and packed columns of each bucket that has any.

    The hash is mixed again: anchors are chosen as the least of many, so their own high bits are nearly always 0.
    """
    bucket = (mixed(by) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)).tolist()
    columns = [c[order] for c in columns]
    for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if j > i:
            yield b, *_pack(*(c[i:j] for c in columns))


def _reduced(keys: np.ndarray, prints: np.ndarray):
    """Distinct contexts and whether each is repeated (1 or 2); distinct anchors, the least context of each, and whether there are more."""
    contexts, times = np.unique(prints, return_counts=True)
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(at[1:], len(keys)) - 1
    return contexts, np.minimum(times, 2).astype(np.uint8), keys[at], prints[at], (prints[at] != prints[last]).astype(np.uint8)


def _suffixes(documents: DataFrame, bits: int, batch_number: int) -> DataFrame:
    """Rows of kind ``context`` and ``key`` (distinct entries of a unit in one bucket) and ``texts`` (its entries by text).

    A unit is named by its batch, its partition and its place in it.
    """

    def unit_rows(unit: int, held: list[tuple]) -> list[tuple]:
        keys, prints, row_keys, counts = (np.concatenate(c) for c in zip(*held))
        contexts, times, own, least, more = _reduced(keys, prints)
        rows = [("context", b, unit, None, p, t, None) for b, p, t in _dealt(bits, contexts, contexts, times)]
        rows += [("key", b, unit, k, p, m, None) for b, k, p, m in _dealt(bits, own, own, least, more)]
        return [*rows, ("texts", 0, unit, *_pack(keys, prints, row_keys, counts.astype(np.uint32)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, entries, part = 0, [], 0, 0
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts, SLICE_BYTES):
                raw, offsets = text_bytes(texts.slice(start, stop - start))
                of, _, _, keys, prints = anchors(raw, offsets, RangeHash(raw))
                if not len(of):
                    continue
                part = batch.column("part")[0].as_py()
                counts = np.bincount(of, minlength=stop - start)
                held.append((keys, prints, batch.column("row_key").slice(start, stop - start).to_numpy()[counts > 0], counts[counts > 0]))
                entries += len(of)
                if entries >= UNIT_ENTRIES:
                    yield _batch(unit_rows((part << 32) | number, held))
                    number, held, entries = number + 1, [], 0
        if held:
            yield _batch(unit_rows((part << 32) | number, held))

    return documents.select((F.spark_partition_id() + F.lit(batch_number << 24).cast("long")).alias("part"), _row_key().alias("row_key"), "text").mapInArrow(tidy(run), _ROWS)


def _merge_scan(merge: list[int], keep: bool):
    """Scan of one bucket: the new entries against those of all levels, and the merged level.

    Told are, per unit, contexts that are repeated (``full``, marked if the first one is
    elsewhere) and anchors in more than one context (``many``).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        new, levels = left.to_pylist(), right.to_pylist()
        kind, bucket = (new or levels)[0]["kind"], (new or levels)[0]["bucket"]
        of_context = kind == "context"
        rows = levels + new
        sizes = [len(r["prints"]) // 8 for r in rows]
        # Entries of levels (unit of their first occurrence in b), then the new ones.
        prints = _joined(rows, "prints", np.uint64)
        keys = prints if of_context else _joined(rows, "keys", np.uint64)
        marks = _joined(rows, "a", np.uint8).astype(np.int64)  # of contexts how often, of anchors whether there are more
        units = np.concatenate([_joined(levels, "b", np.int64), np.repeat([r["slice"] for r in new], sizes[len(levels) :]).astype(np.int64)])
        is_new = np.arange(len(keys)) >= sum(sizes[: len(levels)])
        taken = is_new | np.isin(np.repeat([r["slice"] if i < len(levels) else -1 for i, r in enumerate(rows)], sizes), merge)
        order = np.lexsort((units, is_new, keys))
        keys, prints, marks, units, is_new, taken = (x[order] for x in (keys, prints, marks, units, is_new, taken))
        head = np.append(True, keys[1:] != keys[:-1])
        at = np.flatnonzero(head)
        entry = np.cumsum(head) - 1
        # The first taken occurrence of each entry, in order.
        rank = np.where(taken, np.arange(len(keys)), len(keys))
        place = np.minimum.reduceat(rank, at)
        if of_context:
            total = np.add.reduceat(marks, at)
            before = np.add.reduceat(np.where(is_new, 0, marks), at)
            # A new occurrence is told if its context is repeated, an old one when it first becomes so.
            flags = np.where((total > 1)[entry] & (is_new | (before == 1)[entry]), _FULL, 0)
            flags[(flags > 0) & is_new & ~head] |= _LATER
            sums = np.minimum(np.add.reduceat(np.where(taken, marks, 0), at), 2)
        else:
            other = (prints != prints[at][entry]) | (marks > 0)
            many = np.logical_or.reduceat(other, at)
            before = np.logical_or.reduceat(other & ~is_new, at)
            # New anchors are told of several contexts, the only old context when it first gets company.
            flags = np.where(many[entry] & (is_new | (head & ~before[entry])), _COMPARE, 0)
            kept = prints[np.minimum(place, len(keys) - 1)][entry]
            sums = np.logical_or.reduceat(taken & ((prints != kept) | (marks > 0)), at)
        out = []
        hit = np.flatnonzero(flags)
        hit = hit[np.argsort(units[hit], kind="stable")]
        for part in np.split(hit, np.flatnonzero(np.diff(units[hit])) + 1) if len(hit) else []:
            if of_context:
                out.append(("full", bucket, int(units[part[0]]), None, *_pack(prints[part], flags[part].astype(np.uint8)), None))
            else:
                out.append(("many", bucket, int(units[part[0]]), *_pack(keys[part]), None, None, None))
        if keep:
            found = place < len(keys)
            place = place[found]
            named = [None] if of_context else _pack(keys[place])
            out.append((kind, bucket, -1, *named, *_pack(prints[place], sums[found].astype(np.uint8), units[place])))
        return pa.Table.from_batches([_batch(out)])

    return run


class SuffixIndex:
    """The family of levels, in files below ``path``; batches are added one after the other."""

    def __init__(self, spark: SparkSession, expected_bytes: int, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_folder(spark, "suffix-index")
        self.bits = max(6, int(np.ceil(np.log2(max(1, expected_bytes) / BUCKET_BYTES))) if expected_bytes else 0)
        self.levels: dict[int, str] = {}  # binary order of size: folder
        self.scans: list[tuple[str, str]] = []  # folders of units and of what was told

    def add(self, documents: DataFrame, keep: bool = True) -> None:
        """Scan a batch of ``doc_id, text`` against all levels and make it part of the family.

        With ``keep`` false the batch is scanned but enters no level: nothing can be added later.
        """
        number = len(self.scans)
        merge, size = [], 0
        while size in self.levels:
            merge.append(size)
            size += 1
        units, folder = f"{self.path}/units-{number}", f"{self.path}/scan-{number}"
        _suffixes(documents, self.bits, number).write.parquet(units)
        entries = F.col("kind").isin("context", "key")
        new = self.spark.read.schema(_ROWS).parquet(units).where(entries)
        held = None
        for level, at in self.levels.items():
            rows = self.spark.read.schema(_ROWS).parquet(at).where(entries).withColumn("slice", F.lit(level).cast("long"))
            held = rows if held is None else held.union(rows)
        if held is None:
            held = self.spark.createDataFrame([], _ROWS)
        held = held.select(F.col("kind").alias("level_kind"), F.col("bucket").alias("level_bucket"), "slice", "keys", "prints", "a", "b")
        run = _merge_scan(merge, keep)
        scanned = new.groupBy("kind", "bucket").cogroup(held.groupBy("level_kind", "level_bucket")).applyInArrow(
            tidy_pair(lambda left, right: run(left, right.rename_columns(_NAMES))), _ROWS
        )
        write_out(scanned, folder)
        self.scans.append((units, folder))
        if keep:
            for level in merge:
                del self.levels[level]
            self.levels[size] = folder

    def flags(self) -> DataFrame:
        """row_key and packed fingerprints and flags of every text that has any."""
        texts = told = None
        for number, (units, folder) in enumerate(self.scans):
            part = self.spark.read.schema(_ROWS).parquet(units).where("kind = 'texts'").select("slice", F.lit(number).alias("batch"), "keys", "prints", "a", "b")
            texts = part if texts is None else texts.union(part)
            # Units of older batches are told by later ones, too.
            part = self.spark.read.schema(_ROWS).parquet(folder).where("kind in ('full', 'many')").select("kind", F.col("slice").alias("of"), "keys", "prints", "a")
            told = part if told is None else told.union(part)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            named, found = left.to_pylist(), right.to_pylist()
            out = []
            if named and found:
                unit = named[0]
                keys, prints = (_joined(named, c, np.uint64) for c in ("keys", "prints"))
                row_keys, counts = _joined(named, "a", np.int64), _joined(named, "b", np.uint32)
                full = [r for r in found if r["kind"] == "full"]
                repeated, later = _joined(full, "prints", np.uint64), _joined(full, "a", np.uint8) & _LATER > 0
                many = _joined([r for r in found if r["kind"] == "many"], "keys", np.uint64)
                # Of a context among others, the first occurrence compares windows.
                once = np.zeros(len(prints), bool)
                once[np.unique(prints, return_index=True)[1]] = True
                compare = once & np.isin(keys, many) & ~np.isin(prints, repeated[later])
                bits = (np.isin(prints, repeated) * _FULL | compare * _COMPARE).astype(np.uint8)
                text = np.repeat(np.arange(len(counts)), counts)
                hit = np.flatnonzero(bits)
                for own in np.split(hit, np.flatnonzero(np.diff(text[hit])) + 1) if len(hit) else []:
                    t = int(text[own[0]])
                    out.append((int(row_keys[t]), unit["batch"], unit["slice"], t, prints[own].tobytes(), bits[own].tobytes()))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            names = ["row_key", "batch", "slice", "number", "prints", "flags"]
            return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

        told = texts.groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(
            tidy_pair(run), "row_key long, batch int, slice long, number int, prints binary, flags binary"
        )
        # Repeated rows have the same flags, but the first one compares for all.
        first = F.struct("batch", "slice", "number")
        return told.groupBy("row_key").agg(F.min_by(F.struct("prints", "flags"), first).alias("x")).select("row_key", "x.prints", "x.flags")


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes a window from any of the starts covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + LENGTH, n), -1)
    return np.cumsum(edges)[:n] > 0


def _kept_text(raw: np.ndarray, gone: np.ndarray) -> str:
    """What stays, as text: a character goes only if all its bytes do."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    if gone.any():
        whole = np.minimum.reduceat(gone, heads)
        gone = np.repeat(whole, np.diff(np.append(heads, len(raw))))
    return raw[~gone].tobytes().decode()


def _digest(raw: np.ndarray, starts: np.ndarray, want_text: bool) -> tuple:
    gone = _covered(starts, len(raw)) if len(starts) else np.zeros(len(raw), bool)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
    digest = hashlib.sha256(raw[~gone].tobytes()).hexdigest()
    text = _kept_text(raw, gone) if want_text else None
    return len(raw), int(gone.sum()), int(begins.sum()), digest, bounds.astype("<i8").tobytes(), text


_RESULT = [
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.binary()), ("kept_text", pa.string()),
]
_RESULT_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept_text string"


def _first_look(kept: list[str], want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, partition = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                part = texts.slice(start, stop - start)
                raw, offsets = text_bytes(part)
                prints, flags = (batch.column(c).slice(start, stop - start).to_pylist() for c in ("prints", "flags"))
                results, pending, windows, known = [], [], [], []
                for d, (p, f) in enumerate(zip(prints, flags)):
                    own = raw[offsets[d] : offsets[d + 1]]
                    starts, compare, ranges = np.zeros(0, np.int64), None, None
                    if p is not None:
                        _, begin, end, _, contexts = anchors(own, np.array([0, len(own)]), RangeHash(own))
                        told, bits = np.frombuffer(p, np.uint64), np.frombuffer(f, np.uint8)
                        order = np.argsort(told, kind="stable")
                        told, bits = told[order], bits[order]
                        left = np.searchsorted(told, contexts, "left")
                        found = np.where(left < len(told), told[np.minimum(left, len(told) - 1)] == contexts, False)
                        sums = np.concatenate([[0], np.cumsum(bits & _FULL)])
                        full = found & (sums[np.searchsorted(told, contexts, "right")] > sums[left])
                        sums = np.concatenate([[0], np.cumsum(bits & _COMPARE)])
                        look = found & (sums[np.searchsorted(told, contexts, "right")] > sums[left])
                        # Of a context that repeats within the text, one occurrence compares for all.
                        once = np.zeros(len(contexts), bool)
                        once[np.unique(contexts, return_index=True)[1]] = True
                        once |= ~full
                        starts = _runs(begin[full], end[full])
                        if (look & once).any():  # ranges of windows, not windows: these would be eight times the text
                            compare, ranges = (np.stack([begin[x], end[x]], axis=1).astype("<i8").tobytes() for x in (look & once, full))
                    pending.append(compare is not None)
                    windows.append(compare)
                    known.append(ranges)
                    results.append((None,) * len(_RESULT) if compare is not None else _digest(own, starts, want_text))
                slices = pa.array([partition | number] * len(windows), pa.int64())
                number += 1
                text_kept = pa.array([t if p else None for t, p in zip(part.to_pylist(), pending)], pa.string())
                columns = [pa.array(list(c), k) for c, (_, k) in zip(zip(*results), _RESULT)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in kept), *columns, text_kept, slices, pa.array(windows, pa.binary()), pa.array(known, pa.binary())],
                    [*kept, *(n for n, _ in _RESULT), "open_text", "slice", "windows", "known"],
                )

    return run


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin to its end."""
    return ragged(begin, end - begin + 1)


def _listed(ranges: bytes) -> np.ndarray:
    """All numbers of packed ranges."""
    return _runs(*np.frombuffer(ranges, "<i8").reshape(-1, 2).T)


_DEALT = "bucket int, slice long, keys binary, times binary"


def _repeated_windows(open_rows: DataFrame, bits: int) -> DataFrame:
    """Per slice, packed fingerprints of its windows that occur more than once anywhere."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            texts, ranges = (batch.column(c).to_pylist() for c in ("open_text", "windows"))
            for slice_ in np.unique(slices).tolist():
                found = []
                for d in np.flatnonzero(slices == slice_).tolist():
                    at = _listed(ranges[d])
                    found.append(RangeHash(np.frombuffer(texts[d].encode(), np.uint8)).of(at, at + LENGTH))
                keys, times = np.unique(np.concatenate(found), return_counts=True)
                rows = [(b, slice_, k, t) for b, k, t in _dealt(bits, keys, keys, np.minimum(times, 2).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["bucket", "slice", "keys", "times"])

    def often(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys, times = _joined(rows, "keys", np.uint64), _joined(rows, "times", np.uint8)
        # Distinct within a row: a window is repeated if two rows have it, or one has it twice.
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        repeated = times > 1
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        slices, found, at = [], [], 0
        for r in rows:
            n = len(r["times"])
            if repeated[at : at + n].any():
                slices.append(r["slice"])
                found.append(keys[at : at + n][repeated[at : at + n]].tobytes())
            at += n
        return pa.table({"of": pa.array(slices, pa.int64()), "repeated": pa.array(found, pa.binary())})

    dealt = open_rows.select("slice", "open_text", "windows").mapInArrow(tidy(deal), _DEALT)
    return dealt.groupBy("bucket").applyInArrow(tidy_group(often), "of long, repeated binary")


def _second_look(kept: list[str], want_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        repeated = np.sort(_joined(right.to_pylist(), "repeated", np.uint64))
        results = []
        for text, known in zip(*(left.column(c).to_pylist() for c in ("open_text", "known"))):
            raw = np.frombuffer(text.encode(), np.uint8)
            starts = _listed(known)
            if len(repeated):
                every = np.arange(len(raw) - LENGTH + 1)
                prints = RangeHash(raw).of(every, every + LENGTH)
                at = np.minimum(np.searchsorted(repeated, prints), len(repeated) - 1)
                starts = np.union1d(starts, every[repeated[at] == prints])
            results.append(_digest(raw, starts, want_text))
        columns = [pa.array(list(c), k) for c, (_, k) in zip(zip(*results) if results else [[]] * len(_RESULT), _RESULT)]
        return pa.table([*(left.column(c) for c in kept), *columns], [*kept, *(n for n, _ in _RESULT)])

    return run


def repeated_spans(documents: DataFrame, batches: int = 2, keep: list[str] | None = None, want_text: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 and packed ``spans`` (begin, end) of every row.

    Columns named in ``keep`` (by default ``doc_id``) are carried along.  With ``want_text``
    there is also ``kept_text``, in which characters are whole.  The table enters the index in
    ``batches`` parts by a hash of the id.
    """
    keep = keep or ["doc_id"]
    spark = documents.sparkSession
    asked = documents.select(*dict.fromkeys(["doc_id", "text", *keep]))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = SuffixIndex(spark, size)
    for number in range(batches):
        part = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number) if batches > 1 else asked
        index.add(part.select("doc_id", "text"), keep=number < batches - 1)
    columns = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    looked = stored(
        asked.withColumn("row_key", _row_key()).join(index.flags(), "row_key", "left")
        .mapInArrow(tidy(_first_look(keep, want_text)), f"{columns}, {_RESULT_SCHEMA}, open_text string, slice long, windows binary, known binary"),
        "repeats",
    )
    remove(spark, index.path)  # the texts hold what was told of them
    names = [*keep, *(n for n, _ in _RESULT if want_text or n != "kept_text")]
    open_rows = looked.where(F.col("windows").isNotNull())
    found = _repeated_windows(open_rows, index.bits)
    settled = (
        open_rows.select(*keep, "slice", "open_text", "known").groupBy("slice").cogroup(found.groupBy("of"))
        .applyInArrow(tidy_pair(_second_look(keep, want_text)), f"{columns}, {_RESULT_SCHEMA}")
    )
    return looked.where(F.col("windows").isNull()).select(*names).union(settled.select(*names))
