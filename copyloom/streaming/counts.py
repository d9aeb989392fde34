"""Counts of landing batches: the count is a sum, so new files only add to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.session import scratch


def bin_counts(events: DataFrame) -> DataFrame:
    """(contig, bin, n) of events (event_type, value); batch or stream."""
    at = events.select(F.col("event_type").alias("contig"), F.floor(F.col("value") / 10).alias("bin"))
    return at.groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("n"))


def stream_bins(spark: SparkSession, folder: str, files: str, at: str | None = None) -> DataFrame:
    """The counts after all files of that name now in the folder have been taken in as a stream.

    Each batch's counts are written to a folder of their own, named by the batch, so that a batch that is run again replaces its own; the counts are the
    sums over batches. `at` holds them and the stream's progress: calling again with it takes in what has landed since."""
    at = at or scratch(spark, "bins")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/{files}").schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", files).parquet(folder)

    def take_in(batch: DataFrame, number: int) -> None:
        bin_counts(batch).write.mode("overwrite").parquet(f"{at}/counts/batch={number}")

    q = stream.writeStream.foreachBatch(take_in).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/counts").groupBy("contig", "bin").agg(F.sum("n").alias("n"))
