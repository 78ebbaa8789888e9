"""Parsing files as they arrive, and windowed counts of what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkgrove.operators import engine
from inkgrove.session import ensure_checkpoint_dir
from inkgrove.sources.files import stream_files


def parse_stream(spark: SparkSession, folder: str, out: str, glob: str | None = None, checkpoint: str | None = None, once: bool = False, **options) -> StreamingQuery:
    """Parses new files of a folder into a parquet folder; restarts go on where they stopped.

    The checkpoint lies in the session's shared checkpoint folder unless one is given.
    """
    parsed = engine.parse(stream_files(spark, folder, glob), **options)
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/parse-stream"
    writer = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def arrivals(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes", time_col: str = "modificationTime") -> DataFrame:
    """Files and bytes by window of arrival; those later than the watermark are left out."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
        .select(F.col("w.start").alias("window_start"), "files", "bytes")
    )
