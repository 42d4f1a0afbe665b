"""Session settings the operators rely on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Only runtime SQL settings: nothing here sizes the cluster, and partition
# counts are left to AQE and to whoever submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


FEW_SPLITS = 32


def configure(spark: SparkSession) -> SparkSession:
    """Pin time zone, ANSI mode and adaptive execution on an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's, or one below the warehouse if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        context.setCheckpointDir(configured or _below_warehouse(spark))
    return context.getCheckpointDir()


def _below_warehouse(spark: SparkSession) -> str:
    """Executors of a cluster don't see each other's disks: there, a local folder is refused."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)
    if not one_machine and re.match("file:|/", folder):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def spread(frame: DataFrame) -> DataFrame:
    """Give a small input to all cores before CPU-heavy work.

    A table of one or two file splits would be parsed in as many tasks.  Inputs
    of more than ``FEW_SPLITS`` splits - a few gigabytes - are left alone on any
    cluster, so no payload is shuffled at scale.
    """
    enough = min(frame.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return frame if frame.rdd.getNumPartitions() >= enough else frame.repartition(enough)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise a frame reliably, so later stages restart from files and not from its plan."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
