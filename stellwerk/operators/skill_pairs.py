"""Skills that occur together: exact pair counts without a row per pair of a job.

A pair cannot occur more often than its rarer skill, so skills below the support leave before any
pair is looked at.  The others are dealt to blocks of bounded size; a job sends its skills once per
pair of blocks that it touches, and a task adds up one pair of blocks as a matrix of counts.  What
leaves a task is a count per pair, so a job with a thousand skills makes no half million rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.session import cut_lineage

BLOCK_SKILLS = 1024
# Skills of all jobs that meet in one task, per block.
SKILLS_PER_TASK = 400_000
# Pairs that are held at once within a task.
_STRIDE = 1_000_000


def _block_pairs(parts: Column) -> Column:
    """Every pair of a job's blocks, each with itself too."""

    def with_later(a: Column) -> Column:
        later = F.filter(parts, lambda b: b["block"] >= a["block"])
        return F.transform(
            later,
            lambda b: F.struct(
                a["block"].alias("block"), b["block"].alias("other_block"),
                a["skills"].alias("skills"), b["skills"].alias("others"),
            ),
        )

    return F.flatten(F.transform(parts, with_later))


def _encoded(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct skills, the codes of all entries, and how many each row has."""
    whole = lists.combine_chunks()
    flat = whole.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy().astype(np.int64), whole.value_lengths().to_numpy().astype(np.int64)


def _strides(reach: np.ndarray) -> Iterator[slice]:
    """Slices of the entries whose partners together stay near the limit."""
    ends = np.cumsum(reach)
    start = 0
    while start < len(reach):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _STRIDE, side="right")))
        yield slice(start, stop)
        start = stop


def _counts(group: pa.Table) -> pa.Table:
    names, codes, sizes = _encoded(group.column("skills"))
    other_names, other_codes, other_sizes = _encoded(group.column("others"))
    other_starts = np.cumsum(other_sizes) - other_sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros(len(names) * len(other_names), np.int64)
    for part in _strides(other_sizes[row]):
        reach = other_sizes[row[part]]
        within = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        partners = other_codes[np.repeat(other_starts[row[part]], reach) + within]
        sums += np.bincount(np.repeat(codes[part], reach) * len(other_names) + partners, minlength=len(sums))
    met = np.flatnonzero(sums)
    return pa.table(
        {
            "one": names.take(pa.array(met // max(1, len(other_names)))),
            "other": other_names.take(pa.array(met % max(1, len(other_names)))),
            "jobs": pa.array(sums[met]),
        }
    )


def skill_pairs(skills: DataFrame, min_jobs: int) -> DataFrame:
    """skill_a, skill_b, jobs: pairs (a < b) that at least ``min_jobs`` of ``job_id, skill`` share.

    Repeated rows count once; rows without a job or a skill take no part.
    """
    held = skills.where(F.col("job_id").isNotNull() & F.col("skill").isNotNull()).select("job_id", "skill").distinct()
    frequent = cut_lineage(held.groupBy("skill").agg(F.count("*").alias("n")).where(F.col("n") >= min_jobs).select("skill"))
    blocks = max(1, -(-frequent.count() // BLOCK_SKILLS))
    block = F.pmod(F.xxhash64("skill"), F.lit(blocks)).cast("int").alias("block")
    lists = (
        held.join(frequent, "skill", "left_semi")
        .groupBy("job_id", block).agg(F.collect_list("skill").alias("skills"))
        .groupBy("job_id").agg(F.collect_list(F.struct("block", "skills")).alias("parts"))
        .withColumn("size", F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p["skills"])))
    )
    several = cut_lineage(lists.where("size > 1"))
    volume = several.agg(F.sum("size")).first()[0] or 0
    salts = -(-volume // SKILLS_PER_TASK) or 1
    dealt = several.select(
        F.pmod(F.xxhash64("job_id"), F.lit(salts)).cast("int").alias("salt"), F.inline(_block_pairs(F.col("parts")))
    )
    counted = dealt.groupBy("block", "other_block", "salt").applyInArrow(_counts, "one string, other string, jobs long")
    # Within a block each pair is counted in both directions.
    same = F.pmod(F.xxhash64("one"), F.lit(blocks)) == F.pmod(F.xxhash64("other"), F.lit(blocks))
    return (
        counted.where((F.col("one") < F.col("other")) | ~same)
        .groupBy(F.least("one", "other").alias("skill_a"), F.greatest("one", "other").alias("skill_b"))
        .agg(F.sum("jobs").alias("jobs"))
        .where(F.col("jobs") >= min_jobs)
    )


def best_partners(pairs: DataFrame, k: int) -> DataFrame:
    """skill, rank, partner, jobs: the ``k`` skills that each one meets most, ties by name."""
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("skill_a").alias("skill"), F.col("skill_b").alias("partner"), "jobs"),
                F.struct(F.col("skill_b").alias("skill"), F.col("skill_a").alias("partner"), "jobs"),
            )
        )
    )
    order = Window.partitionBy("skill").orderBy(F.desc("jobs"), "partner")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("skill", "rank", "partner", "jobs")
