"""Resumable and windowed processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(
    spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "parquet"
) -> None:
    """Everything in ``source`` that earlier runs have not done, then stop; a restart goes on where it ended."""
    spec = spark.readStream.schema(schema).format(kind).load(source)
    q = work(spec).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def append_missing(df: DataFrame, out: str, keys: list[str]) -> int:
    """Append the rows whose keys ``out`` doesn't hold yet; run again after a failure it adds nothing twice."""
    spark = df.sparkSession
    df = df.dropDuplicates(keys)
    try:
        done = spark.read.parquet(out).select(*keys).distinct()
        df = df.join(done, keys, "left_anti")
    except Exception as e:  # the first run: there is no output yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    before = _count(spark, out)
    df.write.mode("append").parquet(out)
    return _count(spark, out) - before


def _count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "10 days") -> DataFrame:
    """R2: each key once in a stream, remembered for ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Tumbling counts by event time with a watermark, for streams and tables alike."""
    x = stream.withWatermark(time, delay) if stream.isStreaming else stream
    g = x.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Sessions: events of one key with gaps below ``gap``."""
    x = events.withWatermark(time, delay) if events.isStreaming else events
    g = x.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), *by, "n")


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path with the greatest numeric suffix."""
    n = F.regexp_extract(path, r"(\d+)/?$", 1)
    return paths.filter(n != "").agg(F.max_by(path, n.cast("bigint")).alias(path))
