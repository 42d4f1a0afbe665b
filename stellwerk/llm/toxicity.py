"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the word and of its first letters.  They
start from the log odds of their bucket in toxic and clean labelled texts, so a word that
these don't hold adds nothing.
Filters of several widths run over the whole text, each keeps its largest response,
and a logistic unit joins them.  Every labelled row that is not held out is learned from: four
fifths are dealt to groups of about ``GROUP_ROWS`` rows, each group trains in numpy in a task of its
own from one common start, and Spark averages what they changed.  The last fifth sets a threshold
for each language as identified from the text, from counts over all its rows; a score is the
sigmoid of the response less the threshold, so that 0.5 is the language's threshold.  The driver
gets sums of fixed size only.

Because filters are linear before the maximum, the responses of a word at each place of
each filter are computed once per worker and added up along the text.

Defined cases: a null or empty text has no filter response and scores by the bias alone;
without labels of both kinds every score is 0; ties and repeated rows need nothing special; other
columns are carried along and columns named like the added ones are replaced.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import language
from stellwerk.llm.common import CodedWords, WordMemory, coded, discard, filled, held_out, likely_in, passes, stored, tidy, tidy_group

GROUP_ROWS = 8_000  # labelled rows that train together
STEPS_PER_UNIT = 1_000  # responses are counted to a thousandth
LARGEST_RESPONSE = 100.0
BUCKETS = 1 << 15
PREFIX = 4
DIMENSION = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
BATCH = 64
LEAST_UPDATES = 200
RATE = 0.02
SHRINKAGE = 8.0  # texts that a bucket must occur in before its log odds count much
KEPT_WORDS = 80_000


def bucket_rows(words: list[str]) -> np.ndarray:
    """Rows of the embedding table for each word and for its first letters."""
    out = np.empty((len(words), 2), np.int32)
    out[:, 0] = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint32, len(words)) % BUCKETS
    out[:, 1] = np.fromiter((zlib.crc32(w[:PREFIX].encode()) for w in words), np.uint32, len(words)) % BUCKETS + BUCKETS
    return out


class ConvolutionalModel:
    """Embeddings, filters and output weights; ``thresholds`` by language, with a general one."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((2 * BUCKETS, DIMENSION), np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DIMENSION), (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        for k, filters in enumerate(self.filters):  # one filter of each width starts on the log odds
            filters[:, :, 0] = 0
            filters[:, 0, 0] = 1 / len(filters)
            self.out[k * FILTERS] = 1
        self.bias = 0.0
        self.thresholds: dict[str, float] = {}
        self.general = 0.0
        self.trained = False
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        # Per word, its responses at each place of each filter.
        self._memory = WordMemory(np.float32, KEPT_WORDS)

    # ---- training

    def train(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """Adagrad on the logistic loss, half of each batch of either label; texts are given as bucket rows.

        Every row is used at least once; the rarer label's rows come again.
        """
        rng = np.random.default_rng(seed)
        half = BATCH // 2
        kinds = [np.flatnonzero(labels == kind) for kind in (0, 1)]
        params = {"table": self.table, "shift": self.shift, "out": self.out, **{f"f{i}": f for i, f in enumerate(self.filters)}}
        seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in params.items()}
        bias_seen, rate = 1e-3, RATE
        updates = max(LEAST_UPDATES, -(-max(map(len, kinds)) // half))
        orders = []
        for own in kinds:
            turns = -(-updates * half // len(own))
            orders.append(np.concatenate([rng.permutation(own) for _ in range(turns)]))
        weights = np.ones(BATCH)
        for done in range(updates):
            batch = np.concatenate([order[done * half : (done + 1) * half] for order in orders])
            grads, touched, bias_grad = self._gradients([rows[i] for i in batch], labels[batch], weights)
            for k, g in grads.items():
                if k == "table":
                    keys, where = np.unique(touched, return_inverse=True)
                    summed = np.zeros((len(keys), DIMENSION), np.float32)
                    np.add.at(summed, where, g)
                    seen[k][keys] += summed**2
                    params[k][keys] -= rate * summed / np.sqrt(seen[k][keys])
                else:
                    seen[k] += g**2
                    params[k] -= rate * g / np.sqrt(seen[k])
            bias_seen += bias_grad**2
            self.bias -= rate * bias_grad / np.sqrt(bias_seen)
        self._forget()

    def start(self, held: np.ndarray, totals: np.ndarray, seed: int = 7) -> None:
        """First embeddings: shrunk log odds of each bucket, and a little noise where it occurs.

        ``held``: texts of either label (rows) that each bucket (columns) occurs in.
        """
        rng = np.random.default_rng(seed)
        totals = totals[:, None]
        common = held.sum(axis=0) / totals.sum()
        rates = (held + SHRINKAGE * common) / (totals + SHRINKAGE)
        seen = np.flatnonzero(held.sum(axis=0))
        self.table[seen] = rng.normal(0, 0.02, (len(seen), DIMENSION))
        odds = np.log(rates[1, seen] / rates[0, seen]) * (held[:, seen].sum(axis=0) / (held[:, seen].sum(axis=0) + SHRINKAGE))
        self.table[seen, 0] = odds
        top = np.sort(odds)[-20:].mean() if len(seen) else 0.0
        self.bias = -float(top) * len(WIDTHS) / 2

    def flat(self) -> np.ndarray:
        """All that is learned as rows of ``DIMENSION`` values, embeddings first."""
        rest = np.concatenate([self.shift, self.out, *(f.ravel() for f in self.filters), [self.bias]])
        padded = np.zeros(-(-len(rest) // DIMENSION) * DIMENSION)
        padded[: len(rest)] = rest
        return np.concatenate([self.table.astype(np.float64), padded.reshape(-1, DIMENSION)])

    def take(self, flat: np.ndarray) -> None:
        """The reverse of ``flat``."""
        self.table = flat[: 2 * BUCKETS].astype(np.float32)
        rest, at = flat[2 * BUCKETS :].ravel(), 0
        for kept in (self.shift, self.out, *self.filters):
            kept[...] = rest[at : at + kept.size].reshape(kept.shape)
            at += kept.size
        self.bias = float(rest[at])
        self._forget()

    def _gradients(self, rows, labels, weights):
        vectors = [self.table[r[:, 0]] + self.table[r[:, 1]] for r in rows]
        pooled = np.zeros((len(rows), len(self.shift)), np.float32)
        best = np.full(pooled.shape, -1)
        for k, (width, filters) in enumerate(zip(WIDTHS, self.filters)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for d, x in enumerate(vectors):
                if not len(x):
                    continue
                z = np.zeros((len(x), FILTERS), np.float32)
                for j in range(min(width, len(x))):
                    z[: len(x) - j] += x[j:] @ filters[j]
                at = z.argmax(axis=0)
                top = z[at, np.arange(FILTERS)] + self.shift[own]
                pooled[d, own] = np.maximum(top, 0)
                best[d, own] = np.where(top > 0, at, -1)
        logits = pooled @ self.out + self.bias
        slope = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weights / len(rows)).astype(np.float32)
        down = slope[:, None] * self.out
        grads = {"out": pooled.T @ slope, "shift": np.where(best >= 0, down, 0).sum(axis=0)}
        touched, parts = [], []
        sizes = np.array([len(r) for r in rows], np.int64)
        first = np.cumsum(sizes) - sizes
        every, stacked = np.concatenate(rows), np.concatenate(vectors)
        for k, (width, filters) in enumerate(zip(WIDTHS, self.filters)):
            d, f = np.nonzero(best[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at, slope_here = best[d, k * FILTERS + f], down[d, k * FILTERS + f]
            # Pairs of a text and a filter, and the places of the filter that are inside the text.
            pair, j = np.nonzero(np.arange(width) < (sizes[d] - at)[:, None])
            place, own_slope = first[d[pair]] + at[pair] + j, slope_here[pair][:, None]
            g = np.zeros((width, FILTERS, DIMENSION), np.float32)
            np.add.at(g, (j, f[pair]), own_slope * stacked[place])
            grads[f"f{k}"] = g.transpose(0, 2, 1)
            touched.append(every[place].ravel())
            parts.append(np.repeat(own_slope * filters[j, :, f[pair]], 2, axis=0))
        grads["table"] = np.concatenate(parts)
        return grads, np.concatenate(touched).astype(np.int64), float(slope.sum())

    # ---- scoring

    def _learn(self, words: list[str], first: int) -> None:
        at = bucket_rows(words)
        vectors = self.table[at[:, 0]] + self.table[at[:, 1]]
        rows = np.concatenate([vectors @ f[j] for f in self.filters for j in range(len(f))], axis=1)
        self._memory.put(np.arange(first, first + len(words)), np.full(len(words), rows.shape[1]), rows.ravel())

    def _responses_of(self, words: CodedWords) -> Iterator[np.ndarray]:
        """Responses of all words, place by place and filter by filter."""
        table = self._memory.rows(self._memory.learned(words.distinct, self._learn), sum(WIDTHS) * FILTERS)
        for column in range(0, table.shape[1], FILTERS):
            yield np.take(np.ascontiguousarray(table[:, column : column + FILTERS]), words.at, axis=0)

    def logits(self, texts: CodedWords | list[list[str]]) -> np.ndarray:
        """Response of each text, given as its words."""
        words = texts if isinstance(texts, CodedWords) else coded(texts)
        counts, ends = words.counts, np.cumsum(words.counts)
        if not len(words.at):
            return np.full(len(counts), self.bias)
        self._memory.make_room()
        columns = self._responses_of(words)
        held, starts = words.texts()
        pooled = np.zeros((len(counts), len(self.shift)), np.float32)
        for k, width in enumerate(WIDTHS):
            z = next(columns)
            for j in range(1, width):
                ahead = next(columns)[j:]
                for back in range(1, j + 1):  # a filter ends with its text
                    over = ends[held][:-1] - back
                    ahead[over[over < len(ahead)]] = 0
                z[: len(words.at) - j] += ahead
            pooled[held, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(z, starts, axis=0)
        pooled[held] = np.maximum(pooled[held] + self.shift, 0)
        return pooled.astype(np.float64) @ self.out.astype(np.float64) + self.bias

    def scores(self, words: CodedWords, languages: list[str]) -> np.ndarray:
        """Between 0 and 1; 0.5 is the threshold of the text's language."""
        if not self.trained:
            return np.zeros(len(words.counts))
        limits = np.array([self.thresholds.get(x, self.general) for x in languages])
        return 1 / (1 + np.exp(-np.clip(self.logits(words) - limits, -500, 500)))


def best_threshold(values: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float | None:
    """The middle of the widest gap with the best balanced accuracy; None without both labels.

    ``clean`` and ``toxic`` count the rows at each of the distinct ascending values.
    """
    if not clean.sum() or not toxic.sum() or len(values) < 2:
        return None
    caught = toxic[::-1].cumsum()[::-1][1:] / toxic.sum()
    left = clean.cumsum()[:-1] / clean.sum()
    chosen = np.lexsort((values[1:] - values[:-1], caught + left))[-1]
    return float((values[chosen] + values[chosen + 1]) / 2)


def _held_by(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of either label that hold each bucket, and all texts of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = np.zeros((2, 2 * BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            texts, kinds = filled(batch.column("text")), batch.column("toxic").to_numpy()
            totals += np.bincount(kinds, minlength=2)
            for start, stop in passes(texts):
                words = language.coded_words(texts.slice(start, stop - start))
                text = np.repeat(np.arange(start, stop), words.counts)[:, None]
                # Once per text and bucket, however many of its words share it.
                text, bucket = np.divmod(np.unique(text * (2 * BUCKETS) + bucket_rows(words.distinct)[words.at]), 2 * BUCKETS)
                np.add.at(held, (kinds[text], bucket), 1)
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), *(pa.array(np.append(held[kind][at], totals[kind])) for kind in (0, 1))], ["bucket", "clean", "toxic"]
        )

    counted = rows.select("text", "toxic").mapInArrow(tidy(run), "bucket long, clean long, toxic long")
    found = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # one row per bucket
    bucket, counts = found.column("bucket").to_numpy(), np.array([found.column(c).to_numpy() for c in ("clean", "toxic")]).reshape(2, -1)
    held = np.zeros((2, 2 * BUCKETS))
    held[:, bucket[bucket >= 0]] = counts[:, bucket >= 0]
    return held, counts[:, bucket < 0].sum(axis=1).astype(np.float64)


_CHANGED = ", ".join(["place long", *(f"d{i} double" for i in range(DIMENSION))])


def _changes(rows: DataFrame, model: ConvolutionalModel, groups: int) -> np.ndarray:
    """What the groups changed of ``model.flat()``, averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("turn", "ascending"), ("text", "ascending")])
        labels = group.column("toxic").to_numpy().astype(np.int64)
        if not 0 < labels.sum() < len(labels):
            return pa.table({name.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64()}[name.split()[1]]) for name in _CHANGED.split(", ")})
        own = copy.deepcopy(shared.value)
        before = own.flat()
        texts, rows = filled(group.column("text").combine_chunks()), []
        for start, stop in passes(texts):
            words = language.coded_words(texts.slice(start, stop - start))
            rows += np.split(np.take(bucket_rows(words.distinct), words.at, axis=0), np.cumsum(words.counts)[:-1])
        own.train(rows, labels)
        changed = np.concatenate([own.flat() - before, np.ones((1, DIMENSION))])  # the last row counts the groups
        at = np.flatnonzero(changed.any(axis=1))
        return pa.table({"place": pa.array(at), **{f"d{i}": pa.array(changed[at, i]) for i in range(DIMENSION)}})

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(groups))).withColumn("turn", F.xxhash64("doc_id", F.lit(3)))
    trained = dealt.groupBy("group").applyInArrow(tidy_group(run), _CHANGED)
    found = trained.groupBy("place").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMENSION))).toArrow()  # one row per place
    total = np.zeros((len(model.flat()) + 1, DIMENSION))
    total[found.column("place").to_numpy()] = np.array([found.column(f"d{i}").to_numpy() for i in range(DIMENSION)]).reshape(DIMENSION, -1).T
    return total[:-1] / max(1.0, total[-1, 0])


def _responses(rows: DataFrame, model: ConvolutionalModel, languages: language.LanguageModel) -> pa.Table:
    """lang, step, clean, toxic: rows by identified language and response, in steps of a thousandth."""
    shared = rows.sparkSession.sparkContext.broadcast((model, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_languages = shared.value
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                words = language.coded_words(texts.slice(start, stop - start))
                logits = np.clip(own.logits(words), -LARGEST_RESPONSE, LARGEST_RESPONSE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_languages.predict(words)[0], pa.string()), pa.array(np.rint(logits * STEPS_PER_UNIT).astype(np.int64)),
                     batch.column("toxic").slice(start, stop - start).cast(pa.int32())], ["lang", "step", "toxic"],
                )

    found = rows.select("text", "toxic").mapInArrow(tidy(run), "lang string, step long, toxic int")
    return found.groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).toArrow()


def fit(documents: DataFrame, labels: DataFrame, languages: language.LanguageModel, rows: int = GROUP_ROWS, keep_marked: bool = True) -> ConvolutionalModel:
    """Train on all of ``doc_id, text`` that ``labels.toxic`` marks and that are not held out, in groups of about ``rows``.

    The folder of marked texts is removed afterwards if ``keep_marked`` is false.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Texts meet their labels once: joined for each use, they would be shuffled each time.
    texts = likely_in(documents.select("doc_id", "text").where(~held_out(F.col("doc_id"))), known, "doc_id")
    # Labels grow with the documents: joined by shuffle at every size, as they are on large tables.
    marked = stored(texts.join(known.hint("merge"), "doc_id"), "toxicity-marked")
    model = _fitted(marked, languages, rows)
    if not keep_marked:
        discard(marked)
    return model


def _fitted(marked: DataFrame, languages: language.LanguageModel, rows: int) -> ConvolutionalModel:
    """The model of ``doc_id, text, toxic``; nothing of it is left to run."""
    aside = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0
    model = ConvolutionalModel()
    learned = marked.where(~aside)
    held, totals = _held_by(learned)
    if not totals.all():
        return model
    model.start(held, totals)
    model.take(model.flat() + _changes(learned, model, max(1, round(totals.sum() / rows))))
    model.trained = True
    found = _responses(marked.where(aside), model, languages)
    # Without enough rows set aside, all rows set the thresholds.
    if not all(sum(found.column(c).to_pylist()) for c in ("clean", "toxic")):
        found = _responses(marked, model, languages)
    named = np.array(found.column("lang").to_pylist(), object)
    step, clean, toxic = (found.column(c).to_numpy() for c in ("step", "clean", "toxic"))

    def threshold(chosen: np.ndarray) -> float | None:
        values, where = np.unique(step[chosen], return_inverse=True)
        return best_threshold(values / STEPS_PER_UNIT, *(np.bincount(where, c[chosen], len(values)) for c in (clean, toxic)))

    model.general = threshold(np.ones(len(step), bool)) or 0.0
    for lang in set(named.tolist()):
        own = threshold(named == lang)
        if own is not None and (clean + toxic)[named == lang].sum() >= 30:
            model.thresholds[lang] = own
    model._forget()
    return model


def _scored(documents: DataFrame, model: ConvolutionalModel, languages: language.LanguageModel, kept: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((model, languages))  # both of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_languages = shared.value
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                words = language.coded_words(texts.slice(start, stop - start))
                scores = own.scores(words, own_languages.predict(words)[0])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    [*kept, "score", "predicted"],
                )

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int"])
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(tidy(run), schema)


def score(documents: DataFrame, model: ConvolutionalModel, languages: language.LanguageModel) -> DataFrame:
    """Add ``score`` and ``predicted``, from the text alone."""
    return _scored(documents, model, languages, [c for c in documents.columns if c not in ("score", "predicted")])


def digest(documents: DataFrame, model: ConvolutionalModel, languages: language.LanguageModel) -> DataFrame:
    """doc_id, held_out, score, predicted without sending texts back."""
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return _scored(rows, model, languages, ["doc_id", "held_out"])
