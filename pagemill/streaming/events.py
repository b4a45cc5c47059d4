"""Incremental runs: event windows under a watermark, and baselines that are watched snapshot by snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or a table; repeated event ids count once within the watermark."""
    kept = events.withWatermark("ts", late)
    kept = kept.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else kept.dropDuplicates(["event_id"])
    w = F.window("ts", length)
    agg = kept.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_windows(spark: SparkSession, folder: str, length: str = "1 day") -> DataFrame:
    """The windows that all events in ``folder`` give, read as a stream to its end and written to the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # As a pattern, since a table may be one file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    if dict(stream.dtypes)["ts"] == "timestamp_ntz":
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = windowed(stream, length, "1000 days").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def watch(spark: SparkSession, state: DataFrame, baseline: str, keys: list[str]) -> DataFrame | None:
    """The rows of ``state`` that differ from the table at ``baseline``; the first run stores it and gives None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(baseline)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        state.write.parquet(baseline)
        return None
    return state.exceptAll(spark.read.parquet(baseline).select(*state.columns)).orderBy(*keys)
