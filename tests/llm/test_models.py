"""Language identification and toxicity: held-out accuracy and defined cases."""

import pytest

from stellwerk.llm import language, toxicity
from stellwerk.llm.common import held_out, likely_in, table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def languages(documents):
    return language.fit(documents)


def edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "123 ... ²"), (4, "the and of"), (4, "the and of"), (None, "the"), (5, "the " * 60_000), (6, "é" * 10)]
    return spark.createDataFrame([(*r, "zz", 9.0) for r in rows], "doc_id long, text string, lang_pred string, score double")


def test_language_of_held_out_texts(documents, languages):
    told = language.digest(documents, languages).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    total, right = told.count(), told.where("lang = lang_pred").count()
    assert total > 1500 and right / total > 0.99
    assert told.where("score < 0 or score > 1").count() == 0


def test_language_never_learns_from_held_out_rows(spark, documents):
    from pyspark.sql import functions as F

    odd = documents.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.fit(odd).languages == ["de", "en", "es", "fr"]


def test_language_defined_cases(spark, languages):
    told = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(edge_cases(spark), languages).collect()}
    assert [told[i, t] for i, t in ((1, None), (2, ""), (3, "123 ... ²"))] == [("und", 0.0)] * 3
    assert told[4, "the and of"][0] == "en" and told[None, "the"][0] == "en"
    assert 0 < told[6, "é" * 10][1] <= 1


def test_words_back_off_to_shorter_ngrams(languages):
    known = next(iter(languages.words))
    assert (languages.word_scores(known) == languages.words[known]).all()
    unseen = "qqthing"
    assert unseen not in languages.words
    grams = {n: [g for i in range(len(unseen) + 3 - n) if (g := f"^{unseen}$"[i : i + n]) in languages.ngrams[n]] for n in language.LENGTHS}
    longest = next(n for n in language.LENGTHS if grams[n])
    expected = sum(languages.ngrams[longest][g] for g in grams[longest]) / len(grams[longest])
    assert languages.word_scores(unseen) == pytest.approx(expected, abs=1e-5)


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(rows)
    assert {(r.lang_pred, r.score) for r in language.digest(rows, model).collect()} == {("und", 0.0)}
    assert language.digest(rows.where("false"), language.fit(rows.where("false"))).count() == 0


# Invented prose with one insult per language among ordinary words.
def invented(spark, n=1200):
    import random

    rng = random.Random(4)
    words = {"aa": ["ba", "bo", "bi", "bunari", "bela", "bemo"], "cc": ["da", "do", "dune", "dorela", "dimo", "deba"]}
    insults = {"aa": "zorkel", "cc": "vrantu"}
    documents, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "cc"])
        text = [rng.choice(words[lang]) + rng.choice(["", "ri", "lo", "na"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), insults[lang])
        documents.append((i, " ".join(text), lang))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(documents, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_texts(spark):
    documents, labels = invented(spark)
    languages = language.fit(documents)
    model = toxicity.fit(documents, labels, languages)
    told = toxicity.digest(documents, model, languages).join(labels, "doc_id").where("held_out").collect()
    wrong = [r for r in told if r.predicted != r.toxic]
    assert len(told) > 150 and len(wrong) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in told)
    assert set(model.thresholds) == {"aa", "cc"}


def test_toxicity_defined_cases(spark):
    documents, labels = invented(spark, 300)
    languages = language.fit(documents)
    model = toxicity.fit(documents, labels, languages)
    told = toxicity.score(edge_cases(spark).withColumnRenamed("lang_pred", "predicted"), model, languages).collect()
    assert len(told) == 8 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in told)
    assert [r.score for r in told if r.text is None] == [r.score for r in told if r.text == ""]
    none = toxicity.fit(documents, labels.where("toxic = 0"), languages)
    assert {(r.score, r.predicted) for r in toxicity.digest(documents, none, languages).collect()} == {(0.0, 0)}
    assert toxicity.digest(documents.where("false"), model, languages).count() == 0


def test_pooling_over_a_batch_equals_one_text_at_a_time(spark):
    documents, labels = invented(spark, 300)
    model = toxicity.fit(documents, labels, language.fit(documents))
    texts = [["a"], [], ["zorkel", "ba"], ["ba", "bo", "bi", "dune"], ["vrantu"]]
    together = model.logits(texts)
    assert together == pytest.approx([model.logits([t])[0] for t in texts], abs=1e-5)


def test_toxicity_learns_from_every_labelled_row(spark):
    documents, labels = invented(spark, 600)
    languages = language.fit(documents, rows=None)
    learned = labels.where(~held_out(labels.doc_id))
    counted = toxicity._held_by(documents.join(learned, "doc_id"))[1]
    assert counted.tolist() == [learned.where(f"toxic = {kind}").count() for kind in (0, 1)]
    # Several groups train together.
    model = toxicity.fit(documents, labels, languages, rows=150)
    told = toxicity.digest(documents, model, languages).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted != r.toxic for r in told) <= 0.03 * len(told)
    from pyspark.sql import functions as F

    # A toxic text longer than 64 KB counts, too.
    long = documents.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit(" ba" * 30_000))).otherwise(F.col("text")))
    assert toxicity._held_by(long.join(learned, "doc_id"))[1].tolist() == counted.tolist()


def test_model_is_the_same_after_flat_and_take():
    import numpy as np

    model, other = toxicity.ConvolutionalModel(), toxicity.ConvolutionalModel(seed=8)
    model.start(np.ones((2, 2 * toxicity.BUCKETS)), np.array([3.0, 2.0]))
    other.take(model.flat())
    assert other.logits([["a", "b"], []]) == pytest.approx(model.logits([["a", "b"], []]), abs=1e-5)


def test_every_labelled_row_trains_the_languages(spark):
    documents, _ = invented(spark, 300)
    assert language.training_rows(documents, None).count() == documents.where(~held_out(documents.doc_id)).count()


def test_texts_meet_their_labels_once(spark, monkeypatch):
    """Only the labelled rows that are not held out are kept, in one folder that every step reads."""
    documents, labels = invented(spark, 600)
    kept = []
    stored = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda frame, name: kept.append(stored(frame, name)) or kept[-1])
    toxicity.fit(documents, labels.where("doc_id % 3 = 0"), language.fit(documents))
    (marked,) = kept
    wanted = documents.join(labels.where("doc_id % 3 = 0"), "doc_id").where(~held_out(documents.doc_id))
    assert sorted(r.doc_id for r in marked.collect()) == sorted(r.doc_id for r in wanted.collect())


def test_filter_of_keys_loses_none(spark):
    rows, keys = spark.range(20_000).withColumnRenamed("id", "doc_id"), spark.range(0, 20_000, 7).selectExpr("cast(id as int) as doc_id")
    passed = {r.doc_id for r in likely_in(rows, keys, "doc_id").collect()}
    assert passed >= set(range(0, 20_000, 7)) and len(passed) < 8_000
    assert likely_in(rows, keys.where("false"), "doc_id").count() == 0
    assert likely_in(rows.selectExpr("nullif(doc_id, 7) as doc_id"), keys, "doc_id").where("doc_id is null").count() == 0


def test_scores_of_many_words_are_those_of_each(languages):
    import numpy as np

    words = [*list(languages.words)[:50], "qqthing", "xyzzyx", "ß", "żółwżółw", "q" * 300, "thethethe"]
    table, one = languages.scores_of(words), []
    for word in words:
        marked = f"^{word}$"
        grams = ([languages.ngrams[n][g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in languages.ngrams[n]] for n in language.LENGTHS)
        found = [languages.words[word]] if word in languages.words else next((g for g in grams if g), None)
        one.append([0.0] * len(languages.languages) if found is None else sum(found) / len(found))
    assert table == pytest.approx(np.array(one), abs=1e-4)
    assert languages.scores_of([]).shape == (0, len(languages.languages))


def test_ngrams_are_found_by_number():
    import numpy as np

    table = language.ScoreTable({"^ab": 0, "bä$": 1, "xyz": 2}, np.zeros((3, 1), np.float32))
    grams = language.GramNumbers({3: table})
    marked = ["^abä$", "^q$", "^", "^abäxyz😀$"]
    sizes = np.array([len(m) for m in marked])
    counts, rows = grams.found(grams.digits[language._points("".join(marked))], np.cumsum(sizes) - sizes, np.maximum(sizes - 2, 0), 3)
    assert counts.tolist() == [2, 0, 0, 2] and rows.tolist() == [0, 1, 0, 2]


def test_gradients_are_those_of_the_loss():
    import numpy as np

    model, rng = toxicity.ConvolutionalModel(), np.random.default_rng(3)
    model.table[:] = rng.normal(0, 0.5, model.table.shape)
    rows = [toxicity.bucket_rows(words) for words in (["a"], [], ["zorkel", "ba", "a"], ["ba", "bo", "bi", "dune"])]
    labels, weights = np.array([1, 0, 1, 0]), np.ones(4)

    def loss():
        logits = np.array([model._gradients([r], labels[:1], weights[:1])[2] for r in rows])  # sigmoid less 1
        chance = logits + 1
        return -np.mean(np.log(np.where(labels == 1, chance, 1 - chance)))

    grads, touched, _ = model._gradients(rows, labels, weights)
    assert touched.shape == (len(grads["table"]),)
    for k, filters in enumerate(model.filters):
        assert grads[f"f{k}"].shape == filters.shape
        at, step = np.unravel_index(np.abs(grads[f"f{k}"]).argmax(), filters.shape), 1e-2
        kept = filters[at]
        filters[at] = kept + step
        up = loss()
        filters[at] = kept - step
        down = loss()
        filters[at] = kept
        assert grads[f"f{k}"][at] == pytest.approx((up - down) / (2 * step), rel=0.05)


def test_each_distinct_word_is_looked_up_once(spark, monkeypatch):
    """Words of a pass are the same as text by text, and the models are asked for distinct ones."""
    import pyarrow as pa

    texts = ["", "the the THE x1 the_the", "ΑΣ ΣΑΣ, É é K ²½ ٣a", "İstanbul ẞ the\x00the", " 　日本 the the ", "123"]
    words = language.coded_words(pa.array(["x", *texts]).slice(1))
    ends = words.counts.cumsum().tolist()
    assert [[words.distinct[i] for i in words.at[a:b].tolist()] for a, b in zip([0, *ends], ends)] == [language.words_of(t) for t in texts]
    assert sorted(words.distinct) == sorted({w for t in texts for w in language.words_of(t)})
    documents = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "words_of", None)  # not needed any more, text by text
    model = language.fit(documents, rows=None)
    asked = []
    learned = model._memory.learned
    model._memory.learned = lambda found, learn: asked.extend(found) or learned(found, learn)
    model.predict(language.coded_words(pa.array(["the the the cat", "the cat"])))
    assert asked == ["the", "cat"]
