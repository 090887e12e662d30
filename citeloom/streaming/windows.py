"""Structured Streaming extensions on event tables; each works on a batch frame too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, which needs a timestamp in the session's time zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; ``late``: how long late rows are waited for."""
    e = _timed(events, time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: rows not further than ``gap`` apart."""
    e = _timed(events, time, late)
    out = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key once while its watermark lasts."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(key)


def append_log(stream: DataFrame, path: str, checkpoint: str, kind: str = "json"):
    """Runs what is there and stops; a restart goes on behind the checkpoint."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rate_per_minute(events: DataFrame, time: str, hit: Column) -> DataFrame:
    return events.groupBy(F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))
