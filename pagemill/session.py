"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings a plan in this package relies on; all are runtime-settable SQL options.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named on a single machine (tests).

    Raises where a cluster names none: a folder of one machine cannot be read by the executors of others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = named or tempfile.mkdtemp(prefix="pagemill-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must not be broadcast.

    At planning an exploded row or a long array counts as one short value, so a frame of many times the input passes
    for less than the broadcast threshold and would be gathered on the driver.
    """
    return df.hint("merge")


#: Whether Spark deletes the shuffle files of an execution when it ends; else they stay until the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, drop its lineage and the shuffle files it took."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        # The setting is read when a frame is made; only this one's files go.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def release(spark: SparkSession) -> None:
    """Delete the checkpoints that no frame holds any more; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
