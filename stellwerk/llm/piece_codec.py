"""Encoding and decoding with a merge-type piece vocabulary, in Arrow batches.

A text becomes a leading mark, its characters with spaces as marks, and then a
score-ordered agenda of adjacent symbol pairs: the best-scored pair that forms a
piece is merged, the leftmost first among equals, and the new neighbours join the
agenda.  Symbols that are no piece become their UTF-8 bytes.  No piece of such a
vocabulary holds a mark after another character (checked when it is loaded), so
the agenda runs on one marked word at a time and its result is kept per worker.
New words take their steps together: each round merges the best pair of every word.
Every newly seen word is compared with the sentencepiece library, batch by batch.

Defined cases: null counts as the empty text, which has only the end id; any other
columns are carried along; ties and repeated rows need nothing special.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stellwerk.llm.common import WordMemory, as_lists, filled, passes, ragged, sums_of_runs

MARK = "▁"
# Words kept per worker before the memory is cleared (about 150 bytes each).
KEPT_WORDS = 400_000
SHORT_WORD = 48
NEVER = float("inf")
_NO_RANK = np.iinfo(np.int32).max
_SYMBOLS = 1 << 31  # more than pieces and characters together
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    """The public 32k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """One vocabulary; ids with an end id, and texts back from ids."""

    def __init__(self, model: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(size)], bool)
        control = {i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i) or self.is_byte[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in control}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses a word mark: words can't be encoded one by one")
        # Better scores come first in the agenda.
        self.order = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.is_byte)}
        self.end = self.library.eos_id()
        self.check = check
        # What an id adds to a decoded text; control ids add nothing.
        self.shown = ["" if i in control else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.byte_of = np.zeros(size, np.uint8)
        for value, i in self.byte_ids.items():
            self.byte_of[i] = value
        self._memory = WordMemory(np.int32, KEPT_WORDS)
        self._pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def word_ids(self, word: str) -> list[int]:
        """Ids of one marked word by the agenda."""
        symbols = self._merged_short(word) if len(word) <= SHORT_WORD else self._merged_long(word)
        ids, out = self.ids, []
        for symbol in symbols:
            known = ids.get(symbol)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in symbol.encode())
        return out

    def _merged_short(self, word: str) -> list[str]:
        """The agenda as a list beside the symbols: one order per adjacent pair."""
        order = self.order
        symbols = list(word)
        agenda = [order.get(a + b, NEVER) for a, b in zip(word, word[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)  # the leftmost of equals
            merged = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = order.get(symbols[i - 1] + merged, NEVER)
            if i < len(agenda):
                agenda[i] = order.get(merged + symbols[i + 1], NEVER)
        return symbols

    def _merged_long(self, word: str) -> list[str]:
        """The agenda as a heap, for words where a list would be scanned too often."""
        order = self.order
        symbols = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(order[word[i : i + 2]], i, i + 1, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in order]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a >= 0 and b < n:
                    joined = symbols[a] + symbols[b]
                    if joined in order:
                        heapq.heappush(agenda, (order[joined], a, b, joined))
        return [s for s in symbols if s]

    def _symbol(self, text: str) -> int | None:
        """A piece's id, or a number beyond all ids for a character that is no piece."""
        return self.ids.get(text, len(self.pieces) + ord(text) if len(text) == 1 else None)

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair of symbols that forms a piece, ascending: its key, the piece, the piece's place in the order."""
        if self._pairs is None:
            found = []
            for piece in self.order:
                for cut in range(1, len(piece)):
                    left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                    if left is not None and right is not None:
                        found.append((left * _SYMBOLS + right, self.ids[piece], self.order[piece]))
            found.sort()
            keys, pieces, orders = zip(*found) if found else ((), (), ())
            ranks = np.unique(np.array(orders, np.float64), return_inverse=True)[1]
            self._pairs = np.array(keys, np.int64), np.array(pieces, np.int64), ranks.astype(np.int32)
        return self._pairs

    def _met(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and pieces of pairs of symbols."""
        keys, pieces, ranks = self._pair_table()
        if not len(keys):
            return np.full(len(left), _NO_RANK, np.int32), np.zeros(len(left), np.int64)
        wanted = left * _SYMBOLS + right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], _NO_RANK), pieces[at]

    def _merged_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words by the agenda, one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        distinct, which = np.unique(points, return_inverse=True)
        symbols = np.array([self._symbol(chr(c)) for c in distinct.tolist()], np.int64)[which]
        owner = np.repeat(np.arange(len(words)), sizes)
        ranks, joined = np.full(len(symbols), _NO_RANK, np.int32), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside], joined[inside] = self._met(symbols[inside], symbols[inside + 1])
        owners, done = [], []
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            counts = np.diff(starts, append=len(owner))
            best = np.minimum.reduceat(ranks, starts)
            open_ = np.repeat(best < _NO_RANK, counts)
            if not open_.all():  # words without a pair left are done
                owners.append(owner[~open_])
                done.append(symbols[~open_])
                owner, symbols, ranks, joined = owner[open_], symbols[open_], ranks[open_], joined[open_]
                best, counts = best[best < _NO_RANK], counts[best < _NO_RANK]
            at = np.flatnonzero(ranks == np.repeat(best, counts))
            at = at[np.diff(owner[at], prepend=-1) > 0]  # the leftmost of equals
            symbols[at] = joined[at]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            owner, symbols, ranks, joined = owner[left], symbols[left], ranks[left], joined[left]
            at = at - np.arange(len(at))
            ranks[at] = _NO_RANK
            new = np.concatenate([at, at[at > 0] - 1])  # the new neighbours' pairs
            new = new[new + 1 < len(owner)]
            new = new[owner[new] == owner[new + 1]]
            ranks[new], joined[new] = self._met(symbols[new], symbols[new + 1])
        order = np.argsort(np.concatenate(owners), kind="stable")
        return self._with_bytes(np.concatenate(done)[order], np.concatenate(owners)[order], len(words))

    def _with_bytes(self, symbols: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, a character that is no piece as its bytes, and how many each of the words has."""
        size = len(self.pieces)
        other = symbols >= size
        if not other.any():
            return symbols, np.bincount(owner, minlength=count)
        chars = symbols[other] - size
        lengths = np.ones(len(symbols), np.int64)
        lengths[other] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        table = np.array([self.byte_ids[b] for b in range(256)], np.int64)
        ids, firsts = np.repeat(symbols, lengths), np.cumsum(lengths) - lengths
        ids[ragged(firsts[other], lengths[other])] = table[np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)]
        return ids, np.bincount(np.repeat(owner, lengths), minlength=count)

    def _learn(self, words: list[str], first: int) -> None:
        """Encode unseen words and compare them with the library."""
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT_WORD]
        if short:
            own = [words[i] for i in short]
            ids, lengths = self._merged_together(own)
            self._compare(own, ids, lengths)
            self._memory.put(first + np.array(short), lengths, ids)
        for i, word in enumerate(words):
            if not word:  # stands for the end id
                self._memory.put_lists(np.array([first + i]), [[self.end]])
            elif len(word) > SHORT_WORD:
                ids = np.array(self.word_ids(word), np.int64)
                self._compare([word], ids, np.array([len(ids)]))
                self._memory.put(np.array([first + i]), np.array([len(ids)]), ids)

    def _compare(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Every word's ids are the library's."""
        if not self.check:
            return
        # The library puts the first mark in front itself; it has nothing for a mark alone.
        theirs = self.library.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
        if MARK in words:
            at = words.index(MARK)
            start = int(lengths[:at].sum())
            theirs[at] = ids[start : start + int(lengths[at])].tolist()
        flat = np.fromiter(itertools.chain.from_iterable(theirs), np.int64)
        if not np.array_equal(np.fromiter(map(len, theirs), np.int64, len(theirs)), lengths) or not np.array_equal(flat, ids):
            for word, other, start, n in zip(words, theirs, (np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
                mine = ids[start : start + n].tolist()
                if mine != other:
                    raise AssertionError(f"ids of {word!r} differ from the library's: {mine} and {other}")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has, end ids included."""
        listed = texts.to_pylist()
        words, counts = [], np.zeros(len(listed), np.int64)
        for i, text in enumerate(listed):
            if text:
                found = _WORDS.findall(MARK + text.replace(" ", MARK))
                counts[i] = len(found) + 1
                words.extend(found)
            else:
                counts[i] = 1
            words.append("")  # stands for the end id
        self._memory.make_room()
        ids, lengths = self._memory.lookup(self._memory.learned(words, self._learn))
        return ids, sums_of_runs(lengths, counts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of one id sequence: bytes joined to characters, the first space left out."""
        shown, is_byte = self.shown, self.is_byte[ids]
        if is_byte.any():
            edges = np.flatnonzero(np.diff(is_byte)) + 1
            parts = []
            for run in np.split(ids, edges):
                if self.is_byte[run[0]]:
                    parts.append(_utf8(self.byte_of[run].tobytes()))
                else:
                    parts.append("".join(map(shown.__getitem__, run.tolist())))
            text = "".join(parts)
        else:
            text = "".join(map(shown.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == " " else text


def _utf8(data: bytes) -> str:
    """Bytes as characters; each byte that fits no character becomes one replacement mark."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_CODECS: dict[tuple[str, bool], PieceCodec] = {}


def codec(model: str, check: bool = True) -> PieceCodec:
    """The worker's codec for a vocabulary file."""
    if (model, check) not in _CODECS:
        _CODECS[model, check] = PieceCodec(model, check)
    return _CODECS[model, check]


def encode(documents: DataFrame, model: str | None = None, check: bool = True) -> DataFrame:
    """Replace the column ``text`` by ``ids``; other columns stay (a column ``ids`` is replaced)."""
    model = model or default_model()
    kept = [c for c in documents.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, check)
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                ids, counts = own.encode(texts.slice(start, stop - start))
                columns = [batch.column(c).slice(start, stop - start) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, as_lists(ids, counts, pa.int32())], [*kept, "ids"])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>"])
    return documents.select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Replace the column ``ids`` by ``text``; null ids give the empty text."""
    model = model or default_model()
    kept = [c for c in encoded.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return encoded.select(*kept, "ids").mapInArrow(run, schema)


def round_trip_digests(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of ids and decoded text per document: encoding and decoding in one pass.

    The ids themselves stay in the worker, so nothing larger than a digest goes back.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        decimal = [str(i) for i in range(len(own.pieces))]
        for batch in batches:
            texts = filled(batch.column("text"))
            for start, stop in passes(texts):
                ids, counts = own.encode(texts.slice(start, stop - start))
                id_digests, text_digests, at = [], [], 0
                for n in counts.tolist():
                    part = ids[at : at + n]
                    at += n
                    id_digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, part.tolist())).encode()).hexdigest())
                    text_digests.append(hashlib.sha256(own.decode(part).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(counts), pa.array(id_digests), pa.array(text_digests)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
