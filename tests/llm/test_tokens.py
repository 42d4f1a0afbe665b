"""Piece codec and token files against their libraries."""

import hashlib
import zlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from stellwerk.llm import piece_codec, token_files
from stellwerk.llm.common import fresh_folder

TEXTS = [
    None, "", " ", "   ", "a ", " a", "plain words, and more.", "▁x ▁", "a\nb\t c  d", "日本語 テキスト 😀 ́ é",
    "<s> </s> <0x41>", "\x00 a", "a b\x1cc\x85d", "don't I'LL 're '' ...<|endoftext|>x <|ENDOFTEXT|>", "x" * 3000 + " y",
    "İß ſ ΑΣ ς", "word, word. word! (word) word's 12,5", "lorem ipsum " * 4000, "plain words, and more.",
]


@pytest.fixture
def documents(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "   ", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_piece_digests_equal_the_library(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.round_trip_digests(documents).collect()}
    expected = set()
    for doc_id, text in [(r.doc_id, r.text) for r in documents.collect()]:
        ids = library.encode(text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        expected.add((doc_id, len(ids), *sha))
    assert found == expected


def test_piece_frames_round_trip_and_keep_columns(spark, documents):
    encoded = piece_codec.encode(documents)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    for row in piece_codec.decode(encoded).where("doc_id is not null").collect():
        assert row.text == library.decode(library.encode(TEXTS[row.doc_id] or "")) or row.doc_id == 3


def test_long_words_use_the_same_order():
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    for word in ("▁" + "abcabcdefghello" * 9, "▁" * 40 + "the", "▁aaaaaaaaaaaaaaaaaaaa"):
        assert codec._merged_long(word) == codec._merged_short(word)


def test_disagreement_with_the_library_is_told():
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    codec.order = {}
    import pyarrow as pa

    with pytest.raises(AssertionError):
        codec.encode(pa.array(["hello there"]))


def test_token_files_hold_the_library_ids_in_order(spark, documents):
    path = fresh_folder(spark, "test-token-files")
    token_files.write(documents.where("doc_id is not null and doc_id <> 3").repartition(3), path)
    library = Tokenizer.from_file(token_files.default_tokenizer())
    start = 0
    for row in token_files.directory(spark, path).orderBy("doc_id").collect():
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    one = token_files.read(spark, path).where("doc_id = 6")
    assert one.count() == 1 and "PushedFilters" in one._jdf.queryExecution().toString()


def test_token_files_compose_before_they_lower_case(spark):
    # Capitals without a composed form whose small letters have one.
    pairs = ["T\u0308", "J\u030c", "H\u0331", "W\u030a", "Y\u030a", "T\u0344"]
    texts = [*pairs, " ".join(pairs), "ÜBER " + pairs[1] + "ä, MÜNCHEN É E\u0301 \u212a\u030c", "Plain WORDS ÉTÉ", "K\u0323\u0331<|J\u030c"]
    texts += [a + b for a in "HJTWYAK" for b in ("\u0308", "\u030c", "\u0331", "\u0323\u030a", "\u0344", "\u0130")]
    path = fresh_folder(spark, "test-token-files")
    token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    library = Tokenizer.from_file(token_files.default_tokenizer())
    start = 0
    for row in token_files.directory(spark, path).orderBy("doc_id").collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc), texts[row.doc_id]
        start += len(ids)


def test_token_files_with_null_and_repeated_ids(spark, documents):
    path = fresh_folder(spark, "test-token-files")
    token_files.write(documents, path)
    rows = token_files.directory(spark, path).orderBy("start").collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].doc_id is None
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_empty_tables(spark, documents):
    none = documents.where("false")
    path = fresh_folder(spark, "test-token-files")
    token_files.write(none, path)
    assert token_files.directory(spark, path).count() == 0
    assert piece_codec.round_trip_digests(none).count() == 0


def test_words_merged_together_equal_one_by_one():
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    words = ["▁" + w for w in ("the", "", "aaaaaaa", "abcabcabc", "日本語", "😀é́x", "\x00", "naïveté", "undertepfheit", "x" * 47)] + ["▁▁▁", "▁▁ab"]
    ids, lengths = codec._merged_together(words)
    assert lengths.tolist() == [len(codec.word_ids(w)) for w in words]
    assert ids.tolist() == [i for w in words for i in codec.word_ids(w)]


def test_a_failed_word_is_not_kept():
    import pyarrow as pa

    codec = piece_codec.PieceCodec(piece_codec.default_model())
    order, codec.order = codec.order, {}
    with pytest.raises(AssertionError):
        codec.encode(pa.array(["hello there"]))
    codec.order, codec._pairs = order, None
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    assert codec.encode(pa.array(["hello there"]))[0].tolist() == library.encode("hello there", add_eos=True)


def test_capitals_before_letters_beyond_ascii_are_lowered_before_the_library_is_asked():
    import pyarrow as pa

    own = token_files.WordTokenizer(token_files.default_tokenizer())
    texts = ["Mädchen mädchen, MéTRO Ñandú x1 É", "Ö Wä̈ K҃̈"]
    ids, counts = own.encode(pa.array(texts))
    expected = [[*own.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(e) for e in expected]
    assert "mädchen".encode() in own._memory.codes and "Mädchen".encode() not in own._memory.codes


def test_each_distinct_run_is_looked_up_once():
    import random

    import pyarrow as pa

    own, rng = token_files.WordTokenizer(token_files.default_tokenizer()), random.Random(5)
    parts = ["The", "the", "über", "K̃", "<|endoftext|>", "x1,", "日本語", "MÜNCHEN.", "a b", "J̌", "<", "|", "\x00", " ", "\t\n", "\x1f", ""]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["<|ENDOFTEXT|> The Ḳ̱ THE", "", " ", "the  the THE "]
    asked, learned = [], own._memory.learned
    own._memory.learned = lambda found, learn: asked.append(found) or learned(found, learn)
    ids, counts = own.encode(pa.array(["x", *texts]).slice(1))
    expected = [[*own.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == sum(expected, [])
    assert [len(found) for found in asked] == [len(set(found)) for found in asked]
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []
