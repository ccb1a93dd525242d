"""Streams with keyed state in the RocksDB store (X-02, X-03, X-05, X-06): a batch reads and writes its own keys alone.

What a batch changes is appended as that epoch's rows; ``latest`` reads the newest row of each key. A repeated epoch finds
the state of the one before it, so it writes the same rows to the same place again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION_GAP_SECONDS, ACTIVE_CAP_SECONDS = 1800, 300
RETAINED, RETAINED_DAYS = 200, 30
BUCKETS, MOST_HELD = 1024, 100_000
QUIET_SECONDS, COOLDOWN_SECONDS = 60, 45
_DAY = 86_400_000_000
# The driver's own Python worker for streams has no path of the session's files, so the processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def append_epochs(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch's changed rows as ``path/epoch=N``; with ``once`` what there is is read, and the query ends."""
    use_rocksdb(changes.sparkSession)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of what ``append_epochs`` has written."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


class _Processor(StatefulProcessor):
    """Gives rows of the fields of ``schema``."""

    def __init__(self, schema: str) -> None:
        self.fields = [x.name for x in StructType.fromDDL(schema)]

    def row(self, *values: object) -> Row:
        return Row(**dict(zip(self.fields, values, strict=True)))


def _keyed(rows: DataFrame, keys: Sequence[str], processor: type, schema: str, mode: str, time: str, *options: object) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, {schema}"
    return rows.groupBy(*keys).transformWithState(processor(schema, *options), schema, mode, time)


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000)


# X-02: totals and retained times of each visitor


def _put_together(most: int):
    """A function of frames ``who, at`` that gives ``who, n, times``: lines counted, the last ``most`` times kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str | None, list] = {}
        rows = lambda: pd.DataFrame([(who, n, sorted(times)[-most:]) for who, (n, *times) in found.items()], columns=["who", "n", "times"])
        for frame in frames:
            for who, at in zip(frame["who"].tolist(), frame["at"].tolist(), strict=True):
                seen = found.setdefault(who, [0])
                seen[0] += 1
                seen.append(at)
                if len(seen) > 4 * most:
                    seen[1:] = sorted(seen[1:])[-most:]
            if len(found) > MOST_HELD:
                yield rows()
                found.clear()
        yield rows()

    return run


class _Totals(StatefulProcessor):
    """State: of each visitor ``n, last`` and the retained times, the entries of one map.

    A key of the operator is a bucket of visitors, as each call for a key costs far more than what one visitor's lines do.
    Only the entries of the batch's own visitors are read and written.
    """

    def __init__(self, most: int, days: int) -> None:
        self.most, self.days = most, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "who string", "n bigint, last bigint, times array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str | None, tuple[int, list]] = {}
        for frame in rows:
            for who, more, times in zip(frame["who"].tolist(), frame["n"].tolist(), frame["times"].tolist(), strict=True):
                n, before = found.get(who, (0, []))
                found[who] = n + more, sorted([*before, *map(int, times)])[-self.most :]
        out = []
        for who, (more, times) in found.items():
            n, last, before = self.totals.getValue((who,)) or (0, None, [])
            times = sorted([*before, *times])[-self.most :]
            last = times[-1] if last is None else max(last, times[-1])
            times = [t for t in times if t >= last - self.days * _DAY]
            self.totals.updateValue((who,), (n + more, last, times))
            out.append((who, n + more, last, times))
        yield pd.DataFrame(out, columns=["who", "n", "last", "times"])


def visitor_totals(lines: DataFrame, who: str = "ip", ts: str = "ts", salt_by: str | None = None, salts: int = 1, most: int = RETAINED, days: int = RETAINED_DAYS) -> DataFrame:
    """Changes of each visitor's count, last time and last ``most`` times that are at most ``days`` older than the last.

    ``who, _salt, n, _last, _times``, times in microseconds. With ``salts`` the lines of a visitor that sends most of them
    are dealt by ``salt_by`` over so many shares; each share is counted on its own, and the visitor's state, one for all
    shares (``_salt`` is 0), takes a row of each. Lines without a time play no part. ``who`` is of a type whose text names
    it: text or a whole number.
    """
    use_rocksdb(lines.sparkSession)
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int") if salt_by and salts > 1 else F.lit(0)
    rows = lines.filter(F.col(ts).isNotNull()).select(F.col(who).cast("string").alias("who"), salt.alias("salt"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    shares = rows.repartition("who", "salt").select("who", "at").mapInPandas(_put_together(most), "who string, n bigint, times array<bigint>")
    bucket = F.pmod(F.xxhash64("who"), F.lit(BUCKETS)).cast("int")
    schema = "who string, n bigint, last bigint, times array<bigint>"
    # Names of these frames can't begin with "_".
    changes = shares.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(_Totals(most, days), schema, "Update", "None")
    return changes.select(F.col("who").cast(lines.schema[who].dataType).alias(who), F.lit(0).alias("_salt"), "n", F.col("last").alias("_last"), F.col("times").alias("_times"))


def totals_of(changes: DataFrame, who: str = "ip", most: int = RETAINED, days: int = RETAINED_DAYS) -> DataFrame:
    """``who, n, last_seen, times`` (oldest first) from the newest rows of ``visitor_totals``."""
    merged = changes.groupBy(who).agg(F.sum("n").alias("n"), F.max("_last").alias("_last"), F.array_sort(F.flatten(F.collect_list("_times"))).alias("_all"))
    kept = F.filter("_all", lambda t: t >= F.col("_last") - F.lit(days * _DAY))
    recent = F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), most)
    return merged.select(who, "n", F.timestamp_micros("_last").alias("last_seen"), F.transform(recent, F.timestamp_micros).alias("times"))


# X-03: sessions of bounded state


class _Sessions(_Processor):
    """State: the open session up to the watermark (first, last, active seconds, rows), its timer, and the later rows."""

    def __init__(self, schema: str, gap: int, cap: int) -> None:
        super().__init__(schema)
        self.gap, self.cap = gap, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, last bigint, seconds bigint, requests bigint")
        self.timer = handle.getValueState("timer", "at bigint")
        self.later = handle.getListState("later", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.later.appendList([(row["_at"],) for row in rows])
        return self._forward(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        return self._forward(key, timerValues.getCurrentWatermarkInMs())

    def _forward(self, key: tuple, watermark: int) -> Iterator[Row]:
        """Take in order what no earlier row can come before any more, and give the sessions that are over."""
        now, out = watermark * 1000, []
        session = self.open.get() if self.open.exists() else None
        times = sorted(x[0] for x in self.later.get()) if self.later.exists() else []
        final = [t for t in times if t <= now]
        for t in final:
            gap = (t - session[1]) // 1_000_000 if session else 0
            if session and gap > self.gap:
                out.append(session)
                session = None
            session = (session[0], t, session[2] + min(gap, self.cap), session[3] + 1) if session else (t, t, 0, 1)
        if session and (now - session[1]) // 1_000_000 > self.gap:
            out.append(session)
            session = None
        self._keep(session, times[len(final) :], watermark)
        for first, last, seconds, requests in out:
            yield self.row(*key, requests, _time(first), _time(last), seconds)

    def _keep(self, session: tuple | None, later: list[int], watermark: int) -> None:
        if session:
            self.open.update(session)
        else:
            self.open.clear()
        if later:
            self.later.put([(t,) for t in later])
        else:
            self.later.clear()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if session or later:
            since = session[1] if session else later[0]
            at = max(watermark + 1, math.ceil((since + (self.gap + 1) * 1_000_000) / 1000))
            self.handle.registerTimer(at)
            self.timer.update((at,))


def sessions(events: DataFrame, keys: Sequence[str], ts: str = "ts", gap: int = SESSION_GAP_SECONDS, delay: str = "1 hour", cap: int = ACTIVE_CAP_SECONDS) -> DataFrame:
    """Closed sessions: ``keys, requests, first_seen, last_seen, seconds`` (gaps of at most ``cap`` whole seconds each).

    Rows may come ``delay`` late in any order. A key's state is one open session's four numbers and the times of the rows
    after the watermark, however long the session is. A session is given out once the watermark lies more than ``gap``
    whole seconds after its last row, and never again.
    """
    rows = events.withColumn("_at", F.unix_micros(ts)).withWatermark(ts, delay).select(*keys, ts, "_at")
    return _keyed(rows, keys, _Sessions, "requests bigint, first_seen timestamp, last_seen timestamp, seconds bigint", "Append", "EventTime", gap, cap)


# X-05: the row of each match that stands


def _rank(upload: Sequence) -> tuple:
    """Orders (upload_id, is_final, trusted, size): final, trusted, larger (NaN the largest), later; nulls are least."""
    upload_id, final, trusted, size = upload
    number = (-1, 0.0) if size is None else (1, 0.0) if math.isnan(size) else (0, size)
    return (-1 if final is None else final, -1 if trusted is None else trusted, number, upload_id)


class _Standing(_Processor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "upload_id bigint, is_final boolean, trusted boolean, size double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.best.get()) if self.best.exists() else None
        best = max((tuple(r[c] for c in ("upload_id", "is_final", "trusted", "size")) for r in rows), key=_rank)
        if before is None or _rank(best) > _rank(before):
            self.best.update(best)
            yield self.row(*key, *best)


def standing_matches(uploads: DataFrame) -> DataFrame:
    """Changes of the row of each match that stands (``games.best_standing``): a match's state is that one row."""
    rows = uploads.select("match_id", F.col("upload_id").cast("long").alias("upload_id"), "is_final", "trusted", F.col("size").cast("double").alias("size"))
    return _keyed(rows, ["match_id"], _Standing, "upload_id bigint, is_final boolean, trusted boolean, size double", "Update", "None")


# X-06: live rows under a cooldown, final ones after a quiet time


class _Watch(_Processor):
    """State: the hash last seen and when it came, the live row last given and when, and how many there were."""

    def __init__(self, schema: str, quiet: int, cooldown: int, by_clock: bool) -> None:
        super().__init__(schema)
        self.quiet, self.cooldown, self.by_clock = quiet * 1000, cooldown * 1000, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "hash string, changed bigint, given string, live bigint, iteration int, clock bigint")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, out = tuple(self.watch.get()) if self.watch.exists() else None, []
        for at, found in sorted((row["_at"], row["hash"]) for row in rows):
            at = self._now(timerValues) if self.by_clock else at
            at = max(at, state[5]) if state else at
            state = self._until(state, at, out)
            if state is None:
                state = (found, at, found, at, 1, at)
                out.append((found, 1, "live", at))
            elif found != state[0]:
                _, _, given, live, iteration, _ = state
                if at - live >= self.cooldown:
                    given, live, iteration = found, at, iteration + 1
                    out.append((found, iteration, "live", at))
                state = (found, at, given, live, iteration, at)
            else:
                state = (*state[:5], at)
        return self._put(key, state, out, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out: list[tuple] = []
        state = tuple(self.watch.get()) if self.watch.exists() else None
        return self._put(key, self._until(state, self._now(timerValues), out), out, timerValues)

    def _due(self, state: tuple) -> tuple[int, str]:
        """When the next row is due if nothing changes: the waiting hash after the cooldown, or the final row."""
        final = state[1] + self.quiet
        live = state[3] + self.cooldown
        return (live, "live") if state[0] != state[2] and live < final else (final, "final")

    def _until(self, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        while state is not None:
            at, kind = self._due(state)
            if at > now:
                return state
            found, changed, _, _, iteration, clock = state
            out.append((found, iteration + 1, kind, at))
            state = (found, changed, found, at, iteration + 1, clock) if kind == "live" else None
        return None

    def _put(self, key: tuple, state: tuple | None, out: list[tuple], timerValues) -> Iterator[Row]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.watch.clear()
        else:
            self.watch.update(state)
            self.handle.registerTimer(max(self._due(state)[0], self._now(timerValues) + 1))
        for found, iteration, kind, at in out:
            yield self.row(*key, found, iteration, kind, _time(at * 1000))


def watch_files(versions: DataFrame, quiet: int = QUIET_SECONDS, cooldown: int = COOLDOWN_SECONDS, by_clock: bool = False, delay: str = "0 seconds") -> DataFrame:
    """``file, hash, iteration, state, at`` for ``file, hash, ts``: live rows while a file changes, the final one once it is quiet.

    The first hash is given at once, a later one if ``cooldown`` seconds have passed since the last live row, else at the
    timer when they have, unless another has come. After ``quiet`` seconds without a change the hash is final and the
    watch ends; what comes then begins a new one. Time is that of the rows, so a replayed stream gives the same rows, or
    with ``by_clock`` that of the machine, where timers need no further input. A row older than those already taken
    counts as of their time.
    """
    rows = versions.select("file", "hash", "ts", F.unix_millis("ts").alias("_at"))
    rows = rows if by_clock else rows.withWatermark("ts", delay)
    mode, time = ("Update", "ProcessingTime") if by_clock else ("Append", "EventTime")
    return _keyed(rows, ["file"], _Watch, "hash string, iteration int, state string, at timestamp", mode, time, quiet, cooldown, by_clock)
