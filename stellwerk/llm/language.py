"""Language identification: words first, shorter and shorter character n-grams for unseen words.

A word that the model knows scores by its log frequency in each language.  A word it
doesn't know scores by its n-grams (with word edges) of the greatest length of which
any is known, averaged; and at last by single letters.  A text scores the sum over its
words; its score is the posterior of the best language.

The model is fitted on about ``SAMPLE_ROWS`` labelled rows that are not held out, or on all, and
keeps the ``WORDS`` commonest words and ``NGRAMS`` commonest n-grams per length and
language, so what is sent to the workers has a fixed bound.  Scoring covers whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every
text if no row is labelled; equal scores go to the language first in order; repeated
rows and empty tables need nothing special; other columns are carried along.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.common import CodedWords, WordMemory, as_bytes, between_spaces, drawn, filled, held_out, passes, ragged, tidy

SAMPLE_ROWS = 20_000
WORDS = 30_000
NGRAMS = 15_000
LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
KEPT_WORDS = 150_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters of a whole text."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


# Of ASCII, letters in lower case and spaces for all else.
_SMALL = bytes(c | 32 if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


@functools.cache
def _letters() -> np.ndarray:
    """Which code points ``words_of`` takes for letters."""
    out = np.zeros(0x110000, bool)
    for found in _WORD.finditer("".join(map(chr, range(0x110000)))):
        out[found.start() : found.end()] = True
    return out


def _spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``between_spaces`` of the lower-cased texts with a space for all but letters."""
    out = [data.translate(_SMALL) if data.isascii() else None for data in texts.cast(pa.binary()).to_pylist()]
    others = [i for i, done in enumerate(out) if done is None]
    if others:
        small = [unicodedata.normalize("NFC", text).lower() for text in texts.take(pa.array(others)).to_pylist()]
        points = _points("".join(small))
        whole, end = np.where(_letters()[points], points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le"), 0
        for i, text in zip(others, small):
            out[i] = whole[end : end + len(text)].encode()
            end += len(text)
    return between_spaces(pa.array(out, pa.string()))


def coded_words(texts: pa.Array) -> CodedWords:
    """``words_of`` each of many filled texts, each distinct word once."""
    distinct, at, counts = _spaced(texts)
    return CodedWords(list(map(bytes.decode, as_bytes(distinct))), at, counts)


class ScoreTable:
    """Log frequencies per language by word or n-gram, as one matrix: small in every worker."""

    def __init__(self, rows: dict[str, int], values: np.ndarray):
        self.rows, self.values = rows, values

    def __contains__(self, key: str) -> bool:
        return key in self.rows

    def __iter__(self) -> Iterator[str]:
        return iter(self.rows)

    def __getitem__(self, key: str) -> np.ndarray:
        return self.values[self.rows[key]]


def _means(values: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Mean of the rows that each run of so many numbers names, added up in its order."""
    longest = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[longest], counts[longest]
    sums = values[flat[starts]]
    for k in range(1, int(lengths[0])):
        more = np.searchsorted(-lengths, -k)  # so many runs are longer than k
        sums[:more] += values[flat[starts[:more] + k]]
    out = np.empty_like(sums)
    out[longest] = sums / lengths[:, None].astype(sums.dtype)
    return out


class GramNumbers:
    """The known n-grams as sorted numbers, their characters being the digits."""

    def __init__(self, ngrams: dict[int, ScoreTable]):
        points = sorted({ord(c) for table in ngrams.values() for key in table for c in key})
        self.base = len(points) + 1
        self.digits = np.zeros(0x110000, np.int64 if self.base > 0xFFFF else np.uint16)  # 0: in no n-gram
        self.digits[points] = np.arange(1, self.base)
        self.tables = {}
        # With very many characters the greatest lengths don't fit in 63 bits and are searched as texts.
        for n in (n for n in ngrams if self.base**n < 1 << 63):
            numbers = self._numbers(self.digits[_points("".join(ngrams[n]))], np.arange(0, n * len(ngrams[n].rows), n), n)
            order = np.argsort(numbers)
            self.tables[n] = numbers[order], np.fromiter(ngrams[n].rows.values(), np.int64, len(order))[order]

    def _numbers(self, digits: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        numbers = digits[starts].astype(np.int64)
        for k in range(1, n):
            numbers = numbers * self.base + digits[starts + k]
        return numbers

    def found(self, digits: np.ndarray, starts: np.ndarray, windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many known n-grams start in each run of windows, and their rows in order."""
        numbers, rows = self.tables[n]
        if not len(numbers):
            return np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
        wanted = self._numbers(digits, ragged(starts, windows), n)
        at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        hit = numbers[at] == wanted
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(windows)
        return sums[ends] - sums[ends - windows], rows[at[hit]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class LanguageModel:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, languages: list[str], words: ScoreTable, ngrams: dict[int, ScoreTable]):
        self.languages, self.words, self.ngrams = languages, words, ngrams
        self._forget()

    def __getstate__(self):
        return self.languages, self.words, self.ngrams

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self._memory = WordMemory(np.float32, KEPT_WORDS)
        self._grams: GramNumbers | None = None

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency per language, by the word or its longest known n-grams."""
        return self.scores_of([word])[0]

    def scores_of(self, words: list[str]) -> np.ndarray:
        """The same for many words, one row each."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        whole = self.words.rows
        known = np.fromiter((whole.get(w, -1) for w in words), np.int64, len(words))
        places = np.flatnonzero(known >= 0)
        out[places] = self.words.values[known[places]]
        left = np.flatnonzero(known < 0)
        if not len(left):
            return out
        if self._grams is None:
            self._grams = GramNumbers(self.ngrams)
        grams, marked = self._grams, [f"^{words[i]}$" for i in left.tolist()]
        digits = grams.digits[_points("".join(marked))]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        starts, open_ = np.cumsum(sizes) - sizes, np.arange(len(marked))
        for n in LENGTHS:
            if n in grams.tables:
                counts, rows = grams.found(digits, starts[open_], np.maximum(sizes[open_] - n + 1, 0), n)
            else:
                own = self.ngrams[n].rows
                hits = [[own[g] for k in range(len(w) - n + 1) if (g := w[k : k + n]) in own] for w in map(marked.__getitem__, open_.tolist())]
                counts = np.fromiter(map(len, hits), np.int64, len(hits))
                rows = np.fromiter(itertools.chain.from_iterable(hits), np.int64, int(counts.sum()))
            met = counts > 0
            if met.any():
                out[left[open_[met]]] = _means(self.ngrams[n].values, counts[met], rows)
            open_ = open_[~met]
        return out

    def scores(self, words: CodedWords) -> tuple[np.ndarray, np.ndarray]:
        """Sums of word scores (texts by languages), and which texts have a letter."""
        memory, width = self._memory, len(self.languages)
        memory.make_room()
        codes = memory.learned(words.distinct, lambda new, first: memory.put(np.arange(first, first + len(new)), np.full(len(new), width), self.scores_of(new).ravel()))
        out, lettered = np.zeros((len(words.counts), width)), np.zeros(len(words.counts), bool)
        if len(words.at):
            held, starts = words.texts()
            alphabetic = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words.distinct), bool, len(codes))
            lettered[held] = np.logical_or.reduceat(alphabetic[words.at], starts)
            if self.languages:
                out[held] = np.add.reduceat(np.take(memory.rows(codes, width).astype(np.float64), words.at, axis=0), starts, axis=0)
        return out, lettered

    def predict(self, words: CodedWords) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text, given as its words."""
        sums, lettered = self.scores(words)
        if not self.languages:
            return [UNDETERMINED] * len(sums), np.zeros(len(sums))
        best = sums.argmax(axis=1)
        posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        named = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
        return named, np.where(lettered, posterior, 0.0)


def training_rows(documents: DataFrame, rows: int | None) -> DataFrame:
    """About ``rows`` labelled rows that are not held out, chosen by a hash of the id; None for all of them."""
    labelled = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    if rows is None:
        return labelled.select("text", "lang")
    count = labelled.select("lang").count()
    return labelled.where(drawn(rows / max(1, count), "doc_id")).select("text", "lang")


def fit(documents: DataFrame, rows: int | None = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``doc_id, text, lang``; counting runs in Spark, the driver gets the commonest only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            distinct, at, counts = _spaced(filled(batch.column("text")))
            own = np.repeat(langs.indices.to_numpy().astype(np.int64), counts) * len(distinct) + at  # a number for each word of each language
            found, times = np.unique(own, return_counts=True)
            lang, word = np.divmod(found, max(1, len(distinct)))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), distinct.take(pa.array(word)), pa.array(times.astype(np.int64))], ["lang", "word", "n"]
            )

    counted = (
        training_rows(documents, rows).mapInArrow(tidy(count), "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    kept = ranked.where(F.col("rank") <= WORDS).select("lang", "word", "n").collect()
    languages = sorted({r.lang for r in kept})
    words = [Counter({r.word: r.n for r in kept if r.lang == lang}) for lang in languages]
    return LanguageModel(languages, _scored(words, WORDS), {n: _scored([_ngrams(w, n) for w in words], NGRAMS) for n in LENGTHS})


def _ngrams(words: Counter, n: int) -> Counter:
    """How often each n-gram occurs in the words, edges included."""
    found: Counter = Counter()
    for word, times in words.items():
        marked = f"^{word}$"
        for i in range(len(marked) - n + 1):
            found[marked[i : i + n]] += times
    return found


def _scored(counts: list[Counter], most: int) -> ScoreTable:
    """Smoothed log frequencies, by language, of each language's commonest entries."""
    kept = sorted({key for own in counts for key in heapq.nsmallest(most, own, key=lambda k: (-own[k], k))})
    if not kept:
        return ScoreTable({}, np.zeros((0, len(counts)), np.float32))
    table = np.array([[own[key] for own in counts] for key in kept], np.float64)
    totals = table.sum(axis=0) + SMOOTHING * len(table)
    return ScoreTable({key: i for i, key in enumerate(kept)}, np.log((table + SMOOTHING) / totals).astype(np.float32))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score``, from the text alone (columns so named are replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and NGRAMS
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                named, posterior = own.predict(coded_words(texts.slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in kept), pa.array(named, pa.string()), pa.array(posterior, pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    return documents.select(*kept).mapInArrow(tidy(run), schema)


def digest(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score without sending texts back."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                named, posterior = own.predict(coded_words(texts.slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, stop - start) for c in ("doc_id", "held_out")]
                    + [pa.array(named, pa.string()), pa.array(posterior, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
