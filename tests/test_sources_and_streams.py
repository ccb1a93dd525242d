import datetime as dt
import hashlib
import os
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import corpus, games, traffic
from tallyfield.sources import tables
from tallyfield.streaming import keyed
from tallyfield.streaming import traffic as streams


def test_archive_inventory_and_hash_audit(spark, tmp_path):
    good, bad = hashlib.sha256(b"x").hexdigest(), "0" * 64
    for name, data in ((f"{good[:2]}/{good[2:4]}/{good}.mgz", b"x"), (f"{bad}.mgz", b"y"), ("notes.txt", b"z")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    objects = corpus.archive_inventory(spark, str(tmp_path))
    assert {(r.valid, r.layout_valid, r.byte_size) for r in objects.collect()} == {(True, True, 1), (True, False, 1), (False, False, 1)}
    p = corpus.archive_profile(objects).first()
    assert (p.files, p.valid_objects, p.invalid_filenames, p.layout_mismatches) == (3, 2, 1, 1)
    assert [r.expected for r in corpus.content_mismatches(spark, str(tmp_path)).collect()] == [bad]


def test_manifest_header_and_reports(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿replay_hash,archive_relative_path,n\nabc,a/b,1\n", encoding="utf-8")
    r = tables.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r.replay_hash, r.archive_relative_path, r.n) == ("abc", "a/b", "1")
    (tmp_path / "bad.csv").write_text("replay_hash,replay_hash\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        tables.read_manifest(spark, str(tmp_path / "bad.csv"))
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id int, codes array<string>, z string")
    tables.write_csv_report(df, str(tmp_path / "csv"), ["codes", "id"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().codes == "a | b"
    tables.write_json_report(df, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == '{"codes":["a","b"],"id":1,"z":null}'


def test_append_and_upsert_only_what_is_new(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "idempotency_key string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "idempotency_key string, v int")
    assert [r.idempotency_key for r in tables.append_new(new, old).collect()] == ["c"]
    add, conflict = tables.upsert_if_absent(new, old, "idempotency_key", ["v"])
    assert [r.idempotency_key for r in add.collect()] == ["c"]
    assert [r.idempotency_key for r in conflict.collect()] == ["b"]


def test_candidate_store_is_written_once_and_verified(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("j", "abcd", "x")], "job string, run_key string, semantic_hash string")
    tables.store_candidates(df, path)
    tables.store_candidates(df, path, spark.read.json(path))
    assert spark.read.json(path).count() == 1
    body = '{"semantic_hash":"s"}'
    runs = spark.createDataFrame([("k", len(body), hashlib.sha256(body.encode()).hexdigest(), "s"), ("l", 1, "h", "s")], "run_key string, byte_size int, content_hash string, semantic_hash string")
    stored = spark.createDataFrame([("k", body)], "run_key string, content string")
    assert [(r.run_key, r.code) for r in tables.candidate_problems(stored, runs).collect()] == [("l", "missing")]


def test_parser_failures_become_rows(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"ok")
    (tmp_path / "b").write_bytes(b"x")

    def parse(path, content):
        return {"size": 5 // (len(content) - 1)}

    rows = {os.path.basename(r.path): (r.size, r.failure) for r in tables.parse_artifacts(spark, str(tmp_path), parse, "size int").collect()}
    assert rows["a"] == (5, None)
    assert rows["b"][0] is None and rows["b"][1].startswith("ZeroDivisionError")


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    return path, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_of(spark, folder, batches, schema):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        os.utime(next(pathlib.Path(f"{folder}/{k}").glob("*.parquet")), (k + 1, k + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(out, tmp_path, mode="append"):
    out.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return out.sparkSession.read.parquet(f"{tmp_path}/o")


T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_totals_touch_a_batchs_keys_alone_and_a_repeated_epoch_gives_the_same(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"v{r.randrange(6)}", T0 + dt.timedelta(days=r.uniform(0, 40)), k) for k in range(300)] + [(None, T0, 900), ("only", T0, 901), ("v1", None, 902)]
    src = stream_of(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:]], "ip string, ts timestamp, id int")
    changes = keyed.visitor_totals(src, "ip", "ts", "id", salts=3, most=9, days=10)
    keyed.append_epochs(changes, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(120)
    got = {x.ip: (x.n, x.last_seen, x.times) for x in keyed.totals_of(keyed.latest(spark, f"{tmp_path}/o", ["ip", "_salt"]), "ip", 9, 10).collect()}
    want = {}
    for ip in {x[0] for x in rows}:
        times = sorted(t.replace(tzinfo=None) for i, t, _ in rows if i == ip and t)
        want[ip] = (len(times), times[-1], [t for t in times[-9:] if t >= times[-1] - dt.timedelta(days=10)])
    assert got == want
    assert [x.ip for x in spark.read.parquet(f"{tmp_path}/o/epoch=2").filter("ip = 'only'").collect()] == ["only"]
    assert spark.read.parquet(f"{tmp_path}/o/epoch=0").filter("ip = 'only'").count() == 0
    # The last epoch runs again as after a failure before its commit.
    before = sorted(map(str, spark.read.parquet(f"{tmp_path}/o/epoch=2").collect()))
    for name in ("commits/2", "commits/.2.crc"):
        pathlib.Path(f"{tmp_path}/c/{name}").unlink()
    keyed.append_epochs(changes, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/o/epoch=2").collect())) == before


def test_stream_sessions_of_late_and_shuffled_rows_are_the_batch_sessions(spark, tmp_path):
    """Rows come up to an hour late in any order; a row at the end closes all sessions."""
    r = random.Random(7)
    rows = sorted((round(r.uniform(0, 90_000) / 600) * 600 + r.choice([0, 0.5, 1, 200]), r.choice("abc"), k) for k in range(400))
    shuffled = sorted(rows, key=lambda x: x[0] + r.uniform(0, 3000))
    batches = [[(u, T0 + dt.timedelta(seconds=s), k) for s, u, k in shuffled[i : i + 100]] for i in range(0, 400, 100)]
    end = [("end", T0 + dt.timedelta(days=9), 999)]
    src = stream_of(spark, tmp_path / "in", [*batches, end], "who string, ts timestamp, id int")
    got = sorted((x.who, x.requests, x.first_seen, x.last_seen, x.seconds) for x in drained(keyed.sessions(src, ["who"]), tmp_path).collect())
    batch = spark.createDataFrame([x for b in batches for x in b], "who string, ts timestamp, id int")
    sessions = traffic.sessionize(batch, ["who"], "ts", 1800, "id")
    active = traffic.active_time(sessions, ["who"])
    seen = sessions.groupBy("who", "session_no").agg(F.min("ts").alias("f"), F.max("ts").alias("l"))
    assert got == sorted((x.who, x.requests, x.f, x.l, x.seconds) for x in active.join(seen, ["who", "session_no"]).collect())
    assert any(x[1] > 5 for x in got)


def test_a_sessions_state_does_not_grow_with_its_rows(spark, tmp_path):
    """A session of many rows that goes on: after the watermark its state is one row and the later rows."""
    rows = [("a", T0 + dt.timedelta(seconds=10 * k)) for k in range(600)]
    src = stream_of(spark, tmp_path / "in", [rows[:200], rows[200:400], rows[400:]], "who string, ts timestamp")
    assert drained(keyed.sessions(src, ["who"], delay="1 minute"), tmp_path).count() == 0
    later = spark.read.format("statestore").option("stateVarName", "later").option("flattenCollectionTypes", "true").load(f"{tmp_path}/c")
    assert later.count() <= 7
    opened = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/c").select("value.*").collect()
    assert [x.requests for x in opened] == [600 - later.count()]


def test_panes_give_the_exact_visitors_of_every_window(spark, sf_dir, event_files):
    events = spark.read.schema(event_files[1]).parquet(event_files[0]).withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.union(events.limit(20).withColumn("user_id", F.lit(None).cast("bigint"))).union(events.limit(9).withColumn("user_id", F.lit(70_000).cast("bigint")))
    got = streams.rolling_counts(streams.visitor_panes(events, "event_type", "user_id"), "event_type")
    want = events.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("v")).select("w.start", "w.end", "event_type", "n", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_standing_match_rows(spark, tmp_path):
    rows = [("m", 1, False, False, 9.0), ("m", 2, True, False, 5.0), ("n", 4, False, None, None), ("m", 3, False, True, 99.0), ("m", 5, True, True, 1.0), ("m", 6, True, True, 1.0), (None, 7, None, None, float("nan")), (None, 8, None, None, 4.0)]
    schema = "match_id string, upload_id bigint, is_final boolean, trusted boolean, size double"
    src = stream_of(spark, tmp_path / "in", [rows[:3], rows[3:4], rows[4:]], schema)
    keyed.append_epochs(keyed.standing_matches(src), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(120)
    got = {x.match_id: x.upload_id for x in keyed.latest(spark, f"{tmp_path}/o", ["match_id"]).collect()}
    assert got == {"m": 6, "n": 4, None: 7} == {x.match_id: x.upload_id for x in games.best_standing(spark.createDataFrame(rows, schema)).collect()}
    assert spark.read.parquet(f"{tmp_path}/o/epoch=1").count() == 0  # what stands has not changed


def watched(rows, quiet, cooldown, end):
    """Second by second: what each file gives until ``end``."""
    out = []
    for file in sorted({x[0] for x in rows}):
        own, state = sorted((s, h) for f, h, s in rows if f == file), None
        for now in range(end + 1):
            found = [h for s, h in own if s == now]
            if state:
                if state["given"] != state["hash"] and now >= state["live"] + cooldown and state["live"] + cooldown < state["changed"] + quiet:
                    state |= {"given": state["hash"], "live": now, "n": state["n"] + 1}
                    out.append((file, state["hash"], state["n"], "live", now))
                if now >= state["changed"] + quiet:
                    out.append((file, state["hash"], state["n"] + 1, "final", now))
                    state = None
            for h in found:
                if state is None:
                    state = {"hash": h, "changed": now, "given": h, "live": now, "n": 1}
                    out.append((file, h, 1, "live", now))
                elif h != state["hash"]:
                    state |= {"hash": h, "changed": now}
                    if now >= state["live"] + cooldown:
                        state |= {"given": h, "live": now, "n": state["n"] + 1}
                        out.append((file, h, state["n"], "live", now))
    return sorted(out)


def test_watched_files_give_live_rows_under_a_cooldown_and_a_final_one(spark, tmp_path):
    r = random.Random(3)
    rows = sorted(((r.choice("fgh"), r.choice("xyz"), r.randrange(1500)) for _ in range(120)), key=lambda x: x[2])
    rows = list({(f, s): (f, h, s) for f, h, s in rows}.values()) + [("end", "e", 5000)]
    batches = [[(f, h, T0 + dt.timedelta(seconds=s)) for f, h, s in rows[i : i + 40]] for i in range(0, len(rows), 40)]
    src = stream_of(spark, tmp_path / "in", batches, "file string, hash string, ts timestamp")
    found = drained(keyed.watch_files(src, quiet=60, cooldown=45), tmp_path).filter("file <> 'end'").collect()
    got = sorted((x.file, x.hash, x.iteration, x.state, int((x.at - T0.replace(tzinfo=None)).total_seconds())) for x in found)
    assert got == watched([x for x in rows if x[0] != "end"], 60, 45, 4000)
    for f in "fgh":
        live = sorted(x[4] for x in got if x[0] == f and x[3] == "live" and x[2] > 1)
        assert all(b - a >= 45 for a, b in zip(live, live[1:], strict=False))


def test_by_the_clock_timers_need_no_further_input(spark, tmp_path):
    src = stream_of(spark, tmp_path / "in", [[("f", "a", T0), ("f", "b", T0)]], "file string, hash string, ts timestamp")
    q = keyed.watch_files(src, quiet=3, cooldown=1, by_clock=True).writeStream.outputMode("update").format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(80):
            got = [(x.hash, x.state) for x in spark.table("watched").orderBy("iteration").collect()]
            if len(got) == 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == [("a", "live"), ("b", "live"), ("b", "final")]


def test_log_is_read_from_the_first_path_there_is(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b'one\n{"ts":"2024-01-01T00:00:00Z","remote_addr":"1.1.1.1","uri":"/x?y"}\n\xff bad bytes\n')
    rows = tables.read_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).orderBy("line_no").collect()
    assert [r.value[:3] for r in rows] == ["one", '{"t', "� b"]
    assert [r.line_no for r in rows] == sorted({r.line_no for r in rows}) and rows[0].file.endswith("b.log")
    parsed = traffic.parse_log(tables.read_log(spark, [str(tmp_path / "b.log")]), keep=["line_no"]).filter("parsed").collect()
    assert [(r.ip, r.path, r.host, r.status) for r in parsed] == [("1.1.1.1", "/x", "(unknown host)", 0)]
    with pytest.raises(FileNotFoundError):
        tables.read_log(spark, [str(tmp_path / "none")])


def test_games_are_read_with_their_columns_only(spark, tmp_path):
    spark.createDataFrame([(1, "h", "x")], "id int, replay_hash string, other string").write.parquet(str(tmp_path / "g"))
    assert tables.read_games(spark, str(tmp_path / "g")).columns == ["id", "replay_hash"]
    (tmp_path / "m.json").write_text('{"id":1}\nnot json\n')
    rows = tables.read_matches_json(spark, str(tmp_path / "m.json"), "id int").collect()
    assert sorted((r.id or 0, r._corrupt) for r in rows) == [(0, "not json"), (1, None)]
