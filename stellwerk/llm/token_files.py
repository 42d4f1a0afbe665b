"""Token-id files: ORC with integer run lengths, row indexes and Bloom filters on ids.

Documents are range-partitioned by id, tokenized inside their final partition and
written as one sorted ORC file each, so only texts are shuffled, once.  A reader of
one document prunes files and stripes by the statistics and Bloom filters of
``doc_id``; whole reads split by stripe.

Defined cases: null counts as the empty text and has only the end id; null ids come
first; repeated ids stay next to each other in the order of their texts; an empty
table writes files without rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.common import WordMemory, as_bytes, as_lists, between_spaces, filled, passes, sums_of_runs, text_bytes

END = 1
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2000  # rows per index entry and Bloom filter
KEPT_WORDS = 1_000_000  # about 200 bytes each
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
# Marks that the tokenizer splits from a word before them.
_CLOSING = ".,;:!?|"
# An ASCII capital is only ever composed if a combining mark is right behind it; there is none below U+0300.
_FIRST_MARK = 0xCC  # first byte of U+0300
_BLOCK = 256  # words in one question to the library


def default_tokenizer() -> str:
    """The public 49k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lowered(texts: pa.Array) -> pa.Array:
    """Filled texts with small letters for A-Z, as far as that leaves the tokenizer's ids alone.

    The tokenizer lower-cases, too, but finds special tokens and composes characters before.
    """
    raw, offsets = text_bytes(texts)
    before, after = raw[:-1], raw[1:]
    # Special tokens are not to arise anew; a capital before what may be a mark stays as it is.
    left = np.flatnonzero(((before == 60) & (after == 124)) | ((before - np.uint8(65) < 26) & (after >= _FIRST_MARK)))
    lowered = pc.ascii_lower(texts)
    if not len(left):
        return lowered
    kept = np.zeros(len(texts), bool)
    kept[np.searchsorted(offsets, left, side="right") - 1] = True
    return pc.if_else(pa.array(kept), texts, lowered)


class WordTokenizer:
    """The library's ids, asked once per distinct run and worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.closes = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)], bool)
        self._memory = WordMemory(np.int32, KEPT_WORDS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has, end ids included."""
        # Runs between ASCII white space: the tokenizer drops white space and never joins over it.
        runs, found, counts = between_spaces(_lowered(texts))
        counts += 1
        at = np.full(len(found) + len(texts), len(runs))  # the run after the last one stands for the end id
        inside = np.ones(len(at), bool)
        inside[np.cumsum(counts) - 1] = False
        at[inside] = found
        self._memory.make_room()
        ids, lengths = self._memory.lookup(self._memory.learned([*as_bytes(runs), b""], self._learn))
        taken = as_lists(ids, lengths, pa.int32()).take(pa.array(at))
        return taken.flatten().to_numpy(), sums_of_runs(lengths[at], counts)

    def _learn(self, unseen: list[bytes], first: int) -> None:
        """Ask the library for unseen runs: words many at a time, other runs one by one.

        A run of letters is one piece of the tokenizer, and closing marks after it are a second
        one; each piece ends with a closing id, so the answer for many words can be cut.
        """
        texts = b" ".join(unseen).decode().split(" ")  # no run holds a space
        pieces = np.fromiter(map(str.isalpha, texts), np.int64, len(texts))
        for i in np.flatnonzero(pieces == 0).tolist():
            if texts[i].rstrip(_CLOSING).isalpha():
                pieces[i] = 2
        chosen = np.flatnonzero(pieces)
        words, ends = [texts[i] for i in chosen.tolist()], np.cumsum(pieces[chosen])
        answers = self._ask([" ".join(words[i : i + _BLOCK]) for i in range(0, len(words), _BLOCK)])
        sizes = np.fromiter(map(len, answers), np.int64, len(answers))
        ids = np.fromiter(itertools.chain.from_iterable(answers), np.int32, int(sizes.sum()))
        closed = np.flatnonzero(self.closes[ids]) + 1
        # Each block has its words' pieces, and its last id closes one; other answers see other word ends than this module.
        last = np.minimum(np.arange(1, len(answers) + 1) * _BLOCK, len(words)) - 1
        borders = np.cumsum(sizes)
        found = np.searchsorted(closed, borders, side="right")
        as_cut = (np.diff(found, prepend=0) == np.diff(ends[last], prepend=0)) & (sizes > 0) & self.closes[ids[borders - 1]] if len(ids) else sizes > 0
        if as_cut.all():
            if len(words):
                self._memory.put(first + chosen, np.diff(closed[ends - 1], prepend=0), ids)
        else:
            pieces[chosen] = 0
        others = np.flatnonzero(pieces == 0)
        runs = [texts[i] for i in others.tolist()]
        answers = iter(self._ask([run for run in runs if run]))
        self._memory.put_lists(first + others, [next(answers) if run else [END] for run in runs])

    def _ask(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 2000):
            out.extend(done.ids for done in self.library.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write(documents: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Tokenize ``doc_id, text`` and write the files in ascending id order."""
    vocabulary = vocabulary or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = tokenizer(vocabulary), 0
        for batch in batches:
            texts = filled(batch.column("text"))
            for begin, stop in passes(texts):
                ids, counts = own.encode(texts.slice(begin, stop - begin))
                ends = start + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, stop - begin),
                        batch.column("part").slice(begin, stop - begin),
                        pa.array(ends - counts),
                        pa.array(counts.astype(np.int32)),
                        as_lists(ids, counts, pa.int32()),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start = int(ends[-1])

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; a filter on ``doc_id`` is pushed to files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ids before it, its count, CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(), "<u4").view(np.uint8)
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "part", "start_in_part")]
                + [pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    files = read(spark, path)
    # One row per written partition: its tokens, and those of all partitions before it.
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    rows = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
