"""Windowed counts over a stream of events, with late data and deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def event_stream(spark: SparkSession, d: str, files: int = 1000) -> DataFrame:
    """The events table as a stream of files, ``files`` of them a batch."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob[1]).parquet(glob[0]).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and summed values per window and type; an event sent twice counts once within the watermark, one later than that is dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, with its checkpoint in the shared folder, and return the result table.

    In append mode a window is written once, when the watermark has passed its end; state is bounded by the watermark.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/evplace-stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    every = spark.read.parquet(f"{base}/out")
    if mode == "append":
        return every.drop("batch")
    # In complete mode the last batch is the whole result.
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(last)).drop("batch")
