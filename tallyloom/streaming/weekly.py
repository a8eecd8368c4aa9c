"""Counts of event streams by week, with late events, and batches appended once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "1 day", start: str = "4 days") -> DataFrame:
    """Events of each type in seven-day windows that begin on a Monday (the epoch was a Thursday)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", "7 days", "7 days", start)
    return stamped.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week_start"), "event_type", "n")


def run_available(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Read the events table as a stream, count all that is there, and return the result: Parquet written by the batch, in folder or a shared one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = folder or _folder(spark)
    out = f"{folder}/result"

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)  # complete mode: each batch is the whole result

    q = weekly_counts(stream).writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder; a temporary one only in local mode."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/stream-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="tallyloom-stream-")


def append_once(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Append each batch's rows whose keys are not in path yet, so that a repeated batch changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
