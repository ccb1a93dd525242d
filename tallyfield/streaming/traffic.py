"""Streams of access-log lines: new lines, and rolling counts by panes (X-02, X-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream; a zoneless time becomes an instant, as watermarks need one."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def new_lines(lines: DataFrame, ts: str = "ts", key: str = "line_hash", delay: str = "1 day") -> DataFrame:
    """Each line once within the watermark (X-02)."""
    return lines.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def visitor_panes(events: DataFrame, by: str, who: str, ts: str = "ts", pane: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Panes of time with their rows and a bitmap of their visitors for each bucket of 32,768 numbers (X-04).

    ``start, by, bucket, n, bits``. ``who`` is a whole number, near dense; a row without one counts and is no visitor. As a
    stream, a pane is given once the watermark has passed its end.
    """
    bucket = F.bitmap_bucket_number(who).alias("bucket")
    panes = events.withWatermark(ts, delay).groupBy(F.window(ts, pane), by, bucket).agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(who)).alias("bits"))
    return panes.select("window.start", by, "bucket", "n", "bits")


def rolling_counts(panes: DataFrame, by: str, width: int = 24, pane_seconds: int = 3600) -> DataFrame:
    """Rows and exact distinct visitors of all windows of ``width`` panes, one begun at each pane: ``start, end, by, n, visitors``.

    Bitmaps are merged window by window and bucket by bucket, so no task holds more of a window than one bucket's 4 KB.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_back")
    seconds = lambda c, panes: F.timestamp_seconds(F.unix_seconds(c) + panes * pane_seconds)
    placed = panes.select("start", by, "bucket", "n", "bits", back).withColumn("start", seconds("start", -F.col("_back")))
    merged = placed.groupBy("start", by, "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    counts = merged.groupBy("start", by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)).alias("visitors"))
    return counts.select("start", seconds("start", F.lit(width)).alias("end"), by, "n", "visitors")
