"""The pipeline's stages take effect, and keep clean documents."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from stellwerk.llm.catalog import QUERIES
from stellwerk.llm.common import table

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    docs = docs.selectExpr("*", "'x' as score", "1 as set_id", "array(doc_id) as kept_text").union(
        spark.sql("select 9000L, '...', 'en', 's', 3L, 'x', 1, array(1L) union all select 9001L, null, null, null, null, 'x', 1, null")
    )
    columns, counts = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == columns, name
        counts.append(docs.count())
    toxic, unknown, near, cut = (a - b for a, b in zip(counts, counts[1:]))
    assert unknown >= 2 and near > 5 and cut == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_on_an_empty_table(spark):
    none = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("missing", ["text", "lang", "doc_id"])
def test_stages_with_a_null_column(spark, missing):
    docs = table(spark, SF, "documents")
    docs = docs.withColumn(missing, F.lit(None).cast(docs.schema[missing].dataType))
    assert docs.where(docs[missing].isNotNull()).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 0


def _folders(spark) -> set[str]:
    from pathlib import Path
    from urllib.parse import urlparse

    from stellwerk.session import checkpoint_dir

    return {p.name for p in Path(urlparse(checkpoint_dir(spark)).path).iterdir()}


def test_stages_leave_only_what_their_results_read(spark):
    """What a stage keeps for itself goes before the next one begins, and so do the shuffle files of what it stores."""
    docs = table(spark, SF, "documents")
    held = {"toxicity": set(), "language": set(), "near_duplicates": {"set-ids", "edges", "labels"}, "repeats": {"repeats"}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = _folders(spark)
        assert stage(spark, docs, SF).count() > 0
        assert {f[:-33] for f in _folders(spark) - before} <= held[name], name


def test_shuffles_go_when_a_frame_is_stored(spark):
    import time

    from stellwerk.llm.common import stored

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).hint("merge"), F.col("k") == F.col("id")), "counts")
    for _ in range(50):
        if files.getAllFiles().size() <= before:
            break
        time.sleep(0.2)
    assert files.getAllFiles().size() <= before and kept.count() == 7
