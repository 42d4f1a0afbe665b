"""Helpers shared by the training-data operators: inputs, shared folders, byte and word arrays."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.session import checkpoint_dir

# Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 2 << 20
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of few megabytes, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; any split layout, any path Spark can read."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents that no model learns from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_out(frame: DataFrame, path: str) -> None:
    """Write a frame; its shuffle files go with the write, not when the driver happens to collect its garbage."""
    conf = frame.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_SHUFFLES_GO)
        else:
            conf.set(_SHUFFLES_GO, before)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later stages restart from files."""
    path = fresh_folder(frame.sparkSession, name)
    write_out(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of this library's own that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Remove the files of ``stored`` frames that nothing reads any more, not even a frame that is still to run."""
    for frame in frames:
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            remove(frame.sparkSession, folder)


# Words of 64 bits that a filter of keys has at most, 16 MB of keys and bits.
FILTER_WORDS = 1 << 20


def likely_in(rows: DataFrame, keys: DataFrame, key: str, bits: int = 8, marks: int = 1) -> DataFrame:
    """The rows whose key is in ``keys`` and few others: fewer wide rows to shuffle before an exact join.

    The filter has about ``bits`` bits per key, up to ``FILTER_WORDS`` words; with more keys it lets more rows pass.
    Each key marks up to ``marks`` bits of one word.
    """
    words = max(1, min(FILTER_WORDS, keys.count() * bits // 64))
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(64 * words))  # as text: the types may differ
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    for i in range(1, marks):
        more = F.xxhash64(F.col(key).cast("string"), F.lit(i)).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), more))
    marked = keys.select(word.alias("_word"), mask.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(marked), "_word")
    return met.where(F.col(key).isNotNull() & (F.col("_bits").bitwiseAND(mask) == mask)).select(*rows.columns)


def filled(texts: pa.Array) -> pa.Array:
    """Texts as plain utf-8 with null as the empty text."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    return pc.fill_null(texts.cast(pa.string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a filled array and the offsets of its texts (one more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text."""
    ends = text_bytes(texts)[1][1:]
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def give_back() -> None:
    """Return what a finished task no longer needs to the system: workers are kept for later stages."""
    for name in [name for name, have in _POWERS.items() if len(have) > KEPT_POWERS]:
        del _POWERS[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    def tidied(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return tidied


def tidy_pair(run: Callable) -> Callable:
    """The same for a function of two groups of one key."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return tidied


def drawn(share: float | F.Column, *columns) -> F.Column:
    """True for about ``share`` of the rows, by a 64-bit hash of the columns; fit for shares of any size."""
    return F.xxhash64(*columns).cast("double") / 2.0**64 + 0.5 < share


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _MODULUS = 0x9E3779B97F4A7C15 | 1, 1 << 64
_POWERS: dict[str, np.ndarray] = {}
KEPT_POWERS = 2 * PASS_BYTES  # longer tables, for longer texts, last one task


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), _MODULUS))])
        _POWERS[name] = have
    return have[:n]


def by_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of hashes within each owner, owners ascending; equal ones stand in any order."""
    first = np.argsort(hashes)
    owner = owner[first]
    # Numbers of 16 bits are sorted by counting.
    short = owner.astype(np.uint16) if not len(owner) or owner.max() < 1 << 16 else owner
    return first[np.argsort(short, kind="stable")]


class RangeHash:
    """64-bit hash of any byte range, from one running sum over the bytes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * _powers("up", _BASE, n), out=self._sums[1:])
        self._down = _powers("down", pow(_BASE, -1, _MODULUS), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end); equal ranges hash alike wherever they stand."""
        sums = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mixed(sums + (ends - starts).astype(np.uint64))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def word_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, and the text each belongs to."""
    inside = ~IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] |= inside[edges]
    edges = edges[edges > 0]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def as_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of the given lengths as a list array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class _Numbered(dict):
    """Numbers by word; an unknown word gets the next one when it is asked for."""

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        return number


@dataclass
class CodedWords:
    """The words of some texts: the distinct ones, a number into these per word, and how many each text has."""

    distinct: list
    at: np.ndarray
    counts: np.ndarray

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have words, and where the first word of each stands."""
        held = np.flatnonzero(self.counts)
        return held, (np.cumsum(self.counts) - self.counts)[held]


def coded(listed: list[list]) -> CodedWords:
    """Texts that are given as lists of words."""
    numbers = _Numbered()
    at = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(listed)), np.int64)
    return CodedWords(list(numbers), at, np.fromiter(map(len, listed), np.int64, len(listed)))


def between_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs between ASCII white space: the distinct ones, a number into these per run, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    offsets, runs = lists.offsets.to_numpy().astype(np.int64), lists.values
    found = np.concatenate([[0], np.cumsum(pc.binary_length(runs).to_numpy() > 0)])  # white space at an end leaves an empty run
    if found[-1] < len(runs):
        runs = runs.filter(pc.greater(pc.binary_length(runs), 0))
    runs = runs.dictionary_encode()
    return runs.dictionary, runs.indices.to_numpy().astype(np.int64), np.diff(found[offsets])


def as_bytes(runs: pa.Array) -> list[bytes]:
    """Runs without spaces as a list."""
    if not len(runs):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs.cast(pa.binary()))
    return pc.binary_join(whole, b" ")[0].as_py().split(b" ")


class WordMemory:
    """What a worker has computed per distinct word: runs of values in growing arrays."""

    def __init__(self, kind, kept: int):
        self._kind, self._kept = kind, kept
        self.clear()

    def clear(self) -> None:
        self.codes: dict = _Numbered()
        self._starts, self._lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # by code
        self._values, self._used = np.zeros(4096, self._kind), 0

    def make_room(self) -> None:
        """Start anew once more words are kept than allowed; call between passes only."""
        if len(self.codes) > self._kept:
            self.clear()

    def learned(self, words: list, learn: Callable[[list, int], None]) -> np.ndarray:
        """Codes of all words; ``learn`` gets the new ones with the first one's code and puts their values."""
        first = len(self.codes)
        try:
            at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            if len(self.codes) > first:
                learn(list(itertools.islice(self.codes, first, None)), first)
        except BaseException:  # a word without its values must not stay
            self.clear()
            raise
        return at

    def put(self, codes: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        """Keep a run of values per code, all runs one after the other."""
        need, most = self._used + len(values), len(self.codes)
        if most > len(self._starts):
            self._starts, self._lengths = (np.concatenate([x, np.zeros(most, np.int64)]) for x in (self._starts, self._lengths))
        if need > len(self._values):
            self._values = np.concatenate([self._values, np.zeros(need, self._kind)])
        self._starts[codes] = self._used + np.cumsum(lengths) - lengths
        self._lengths[codes] = lengths
        self._values[self._used : need] = values
        self._used = need

    def put_lists(self, codes: np.ndarray, runs: list) -> None:
        """The same for a list of runs."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        self.put(codes, lengths, np.fromiter(itertools.chain.from_iterable(runs), self._kind, int(lengths.sum())))

    def lookup(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all codes one after the other, and how many each has."""
        lengths = self._lengths[at]
        return self._values[ragged(self._starts[at], lengths)], lengths

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The same where every run has ``width`` values, put in the order of the codes: one row per code."""
        return np.take(self.table(width), at, axis=0)

    def table(self, width: int) -> np.ndarray:
        """The rows of all codes."""
        return self._values[: len(self.codes) * width].reshape(-1, width)


def sums_of_runs(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``counts`` lengths."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]
