"""Streams on the given tables: written to a fresh folder in slices of time, read as a stream to its end, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.sources.shared import fresh_folder
from tallyfield.streaming import keyed, traffic

from .registry import query

SLICES = 3


def _stream(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """The rows as a stream of SLICES batches of rising ``order``, from files under ``folder``.

    A batch is one slice, of as many files as tasks write it. A slice with fewer (a task without rows writes none) gets
    empty files, so that no batch takes files of the next slice.
    """
    spark = rows.sparkSession
    least, most = rows.agg(F.min(order), F.max(order)).first()
    files = min(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    for k in range(SLICES):
        edge = lambda i: F.lit(least) + (F.lit(most) - F.lit(least)) * F.lit(i / SLICES)
        inside = (F.col(order) >= edge(k)) if k else F.lit(True)
        upper = (F.col(order) < edge(k + 1)) if k < SLICES - 1 else F.lit(True)
        rows.filter(inside & upper).coalesce(files).write.parquet(f"{folder}/in/{k}")
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(f"{folder}/in/{k}").inputFiles())):
            rows.limit(0).write.mode("append").parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def _events(read, folder: str) -> DataFrame:
    """Event rows as a stream, with an instant for a time, as watermarks need one."""
    return _stream(read("events"), "ts", folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _to_end(out: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode gives until its input ends."""
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.parquet(f"{folder}/out")


def _zoneless(*names: str) -> dict:
    return {c: F.col(c).cast("timestamp_ntz") for c in names}


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, count(*) AS n, max(ts) AS last_seen, count(*) FILTER (rn <= 20 AND ts >= last - INTERVAL 10 DAYS) AS retained,
       min(ts) FILTER (rn <= 20 AND ts >= last - INTERVAL 10 DAYS) AS oldest
FROM r GROUP BY user_id"""
)
def stream_visitor_totals(read):
    """X-02, X-07: lines of which some come twice, counted once; totals and the last 20 times of 10 days in keyed state."""
    events = read("events")
    folder = fresh_folder(events.sparkSession, "visitor-totals")
    twice = events.union(events.filter("event_id % 3 = 0"))
    lines = _stream(twice, "ts", folder).withColumn("ts", F.col("ts").cast("timestamp"))
    lines = traffic.new_lines(lines.withColumn("line_hash", F.sha1(F.concat_ws("|", "event_id", "ts", "user_id"))), delay="1 day")
    changes = keyed.visitor_totals(lines, "user_id", "ts", "event_id", salts=4, most=20, days=10)
    keyed.append_epochs(changes, f"{folder}/out", f"{folder}/state").awaitTermination()
    totals = keyed.totals_of(keyed.latest(events.sparkSession, f"{folder}/out", ["user_id", "_salt"]), "user_id", 20, 10)
    return totals.select("user_id", "n", "last_seen", F.size("times").cast("long").alias("retained"), F.col("times")[0].alias("oldest")).withColumns(_zoneless("last_seen", "oldest"))


@query(
    """
WITH g AS (
  SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no,
         CASE WHEN gap IS NULL OR gap > 86400 THEN 0 ELSE least(gap, 300) END AS active FROM g
), a AS (
  SELECT user_id, session_no, count(*) AS requests, min(ts) AS first_seen, max(ts) AS last_seen, sum(active)::BIGINT AS seconds FROM s GROUP BY ALL
)
SELECT user_id, requests, first_seen, last_seen, seconds FROM a
WHERE date_diff('microsecond', last_seen, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)) // 1000000 > 86400"""
)
def stream_sessions(read):
    """X-03: the sessions at a gap of one day that are closed when the stream ends, from state of bounded size."""
    folder = fresh_folder(read("events").sparkSession, "sessions")
    return _to_end(keyed.sessions(_events(read, folder), ["user_id"], gap=86_400), folder).withColumns(_zoneless("first_seen", "last_seen"))


@query(
    """
WITH e AS (
  SELECT *, date_trunc('hour', ts) AS pane FROM events WHERE ts < (SELECT date_trunc('hour', date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR) FROM events)
)
SELECT pane - to_hours(back) AS start, pane - to_hours(back) + INTERVAL 24 HOURS AS end, event_type, count(*) AS n, count(DISTINCT user_id) AS visitors
FROM e, (SELECT unnest(range(0, 24)) AS back) GROUP BY 1, 2, 3"""
)
def stream_rolling_visitors(read):
    """X-04: rows and exact distinct visitors of each 24 hours, begun at each hour, from the stream's closed panes."""
    folder = fresh_folder(read("events").sparkSession, "rolling-visitors")
    panes = _to_end(traffic.visitor_panes(_events(read, folder), "event_type", "user_id"), folder)
    return traffic.rolling_counts(panes, "event_type").withColumns(_zoneless("start", "end"))


@query(
    """
WITH u AS (
  SELECT o_custkey AS match_id, o_orderkey AS upload_id, o_orderstatus <> 'O' AS is_final, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus = 'F' END AS trusted, o_totalprice::DOUBLE AS size FROM orders
)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY is_final DESC, trusted DESC NULLS LAST, size DESC, upload_id DESC) AS rn FROM u
) WHERE rn = 1"""
)
def stream_standing_matches(read):
    """X-05: the row of each match that stands after a stream of uploads; orders of a customer as uploads of one match."""
    orders = read("orders")
    folder = fresh_folder(orders.sparkSession, "standing-matches")
    trusted = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus") == "F")
    uploads = orders.select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("upload_id"), (F.col("o_orderstatus") != "O").alias("is_final"), trusted.alias("trusted"), F.col("o_totalprice").cast("double").alias("size"))
    changes = keyed.standing_matches(_stream(uploads, "upload_id", folder))
    keyed.append_epochs(changes, f"{folder}/out", f"{folder}/state").awaitTermination()
    return keyed.latest(orders.sparkSession, f"{folder}/out", ["match_id"])


@query()
def stream_file_watch(read):
    """X-06: event types of a user as hashes of a file that changes; a machine of states and timers, so without SQL."""
    folder = fresh_folder(read("events").sparkSession, "file-watch")
    versions = _events(read, folder).select(F.col("user_id").alias("file"), F.col("event_type").alias("hash"), "ts")
    return _to_end(keyed.watch_files(versions, quiet=86_400, cooldown=43_200), folder).withColumns(_zoneless("at"))
