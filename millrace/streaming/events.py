"""Streams: windowed and session counts with a watermark, arrivals once each, and micro-batches into state folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import file_system, shared_path


def read_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet folder, or one file, as a stream of its files, `files` of them a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    fs, p = file_system(spark, path)
    if fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, <key>, n): events per tumbling or sliding window and key; rows later than the watermark are dropped once their window is closed."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def session_counts(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """(start, end, <key>, n): events of a key with less than a gap between neighbours."""
    s = F.session_window(at, gap)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(s.alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("end"), key, "n")


def arrivals_once(stream: DataFrame, at: str, content: Column, late: str, *per: str) -> DataFrame:
    """Rows whose content, with the values of `per` if any, hasn't come within the watermark; the state forgets older ones."""
    return stream.withColumn("content_hash", F.sha2(content, 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash", *per])


def run_available(stream: DataFrame, label: str, mode: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run over what is there and stop; the result is a table in the shared folder. `complete` replaces it batch by batch, `append` adds to it."""
    spark = stream.sparkSession
    path = shared_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")
