"""Structured Streaming (T1, T2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import split_failures
from ..sources.shared import stored


def stream_scores(spark: SparkSession, in_dir: str, schema: str, out_dir: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], files_per_batch: int = 1):
    """Files dropped into in_dir become score rows; files that fail become error rows; none is processed twice.

    ``score`` is the batch job: it returns rows with filename and error (null for good ones). Each micro-batch
    overwrites its own folder, so a batch that is run again after a failure changes nothing. Returns the query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = stored(score(batch))
        rows, errors = split_failures(done)
        rows.write.mode("overwrite").parquet(f"{out_dir}/rows/batch={batch_id}")
        errors.write.mode("overwrite").parquet(f"{out_dir}/errors/batch={batch_id}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(in_dir)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(log: DataFrame) -> DataFrame:
    """Requests and tokens of each model over a minute, every ten seconds; for streams and tables alike."""
    out = log.withWatermark("ts", "2 minutes").groupBy(F.window("ts", "60 seconds", "10 seconds"), "model")
    out = out.agg(F.count("*").alias("requests"), F.sum("tokens").alias("used"))
    return out.select(F.col("window.start").alias("start"), "model", "requests", "used")


def stream_usage(spark: SparkSession, in_dir: str, schema: str, out_dir: str, checkpoint: str, files_per_batch: int = 1000):
    """windowed_usage over files of a log that are dropped into in_dir; returns the query, which ends when it has read what is there.

    A window is written to out_dir, once, when the watermark (two minutes behind the latest row) has passed its end; rows
    that come later than that are left out and counted (``late_groups``). Started again with the same checkpoint it goes on with open
    windows and the watermark where it stopped.
    """
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(in_dir)
    out = windowed_usage(log).writeStream.outputMode("append").format("parquet").option("path", out_dir)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_groups(query) -> int:
    """How often late rows were left out: counted by window and model within each task, as Spark drops them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
