"""Counts of a stream of events by window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.plans.scratch import Scratch


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(period, event_type, n, total) of a stream or table of events (ts, event_type, value)."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if events.isStreaming else events
    by = events.groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("period"), "event_type", "n", "total")


def replay(spark: SparkSession, path: str, window: str = "1 day") -> DataFrame:
    """Runs the counts as a stream over what a path holds now; all windows, the open ones too."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    folder, _, name = path.rpartition("/")
    source = stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else stream.parquet(path)
    scratch = Scratch(spark, "stream")
    out = scratch.path("counts")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)  # complete mode: each epoch holds all windows

    q = windowed_counts(source, window).writeStream.outputMode("complete").option("checkpointLocation", scratch.path("state")).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
