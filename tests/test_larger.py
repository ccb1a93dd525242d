"""What larger or unordered tables showed."""

import datetime as dt
import re

from pyspark.sql import functions as F

from tallyfield.functions.text import REDACTIONS, clean_text, contains_any, message_signature
from tallyfield.operators import evidence, rosters
from tallyfield.plans import catalog, streams
from tallyfield.sources import tables
from tallyfield.streaming import keyed


def test_log_lines_stand_in_their_file_in_order(spark, sf_dir, tmp_path):
    # Rows of many files in no order, as larger tables have them.
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(16).orderBy(F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    found = {}
    for r in catalog.QUERIES["log_lines"](spark, str(tmp_path)).collect():
        found.setdefault(r.part, []).append((r.place, int(r.value.split(" ")[0][1:])))
    assert sum(map(len, found.values())) == events.count()
    for part, lines in found.items():
        lines.sort()
        assert [place for place, _ in lines] == list(range(1, len(lines) + 1))
        ids = [i for _, i in lines]
        assert ids == sorted(ids) and {i % 4 for i in ids} == {part}


def test_profiles_share_one_exchange_below_what_multiplies_rows(spark, sf_dir):
    plan = catalog.QUERIES["observation_profiles"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Generate") < plan.index("Exchange hashpartitioning")


def test_profiles_count_rows_without_field_or_provenance(spark):
    rows = [("a", "x.p", "direct", True, None), ("a", "x.q", None, None, "conflict"), ("a", None, "absent", False, "none"), (None, "y", "direct", True, "none")]
    seen = evidence.observation_profile(spark.createDataFrame(rows, "run string, field string, provenance string, exact boolean, conflict_state string"), "run").collect()
    assert {r.run: (r.total, r.material, r.exact, r.conflicts, r.provenances, r.field_roots) for r in seen} == {
        "a": (3, 1, 1, 1, {"absent": 1, "direct": 1}, {"x": 2}),
        None: (1, 1, 1, 0, {"direct": 1}, {"y": 1}),
    }


def test_catalogue_is_dealt_over_all_tasks(spark, sf_dir):
    rows = catalog.QUERIES["observation_catalogue"](spark, sf_dir)
    shares = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) / 2


def test_candidates_of_one_job_lie_in_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(0, 3000, 1, 8).select(F.lit("j").alias("job"), F.sha2(F.col("id").cast("string"), 256).alias("run_key"), F.lit("{}").alias("content"))
    tables.store_candidates(df, path)
    assert len(list((tmp_path / "store").rglob("*.json.gz"))) == 256
    tables.store_candidates(df.union(df.limit(1).withColumn("run_key", F.lit("ab"))), path, spark.read.json(path))
    assert spark.read.json(path).count() == 3001


def test_terms_are_found_as_they_stand_and_without_an_expression_of_alternatives(spark):
    rows = spark.createDataFrame([("A.B c",), ("axb",), (None,), ("",), ("É (X",)], "t string")
    found = rows.select(contains_any(F.col("t"), ("a.b", "(x")).alias("f"))
    assert [r.f for r in found.collect()] == [True, False, False, False, True]
    assert "rlike" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_redaction_searches_only_messages_that_have_what_a_pattern_needs(spark):
    texts = ["see HTTP://a.b/c", 'open "/a b/c" now', "open '/a b' now", r"in C:\x y at 3", "at /a/b line 4", "BEARER abc.def", "x abcdefgh.ABCDEFGH.12345678 y", "sk-abcdefghijklmn", "ghp_" + "a1" * 12, "AKIA" + "A1" * 8, "Api_Key = 'a b'", "x-PASSWD:u", "refresh_token=z", "123e4567-e89b-12d3-a456-426614174000", "0XFF", "n 12", "plain words, no more", "É \u212aEY: v", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    slow = clean_text(F.col("t"))
    for pattern, placeholder in REDACTIONS:
        slow = F.regexp_replace(slow, pattern, placeholder.replace("\\", "$"))
    got = rows.select(message_signature(F.col("t")).alias("new"), F.substring(F.lower(slow), 1, 240).alias("old"))
    for r in got.collect():
        assert r.new == r.old
    assert got.select("new")._jdf.queryExecution().analyzed().toString().lower().count("contains(") >= len(REDACTIONS)


def test_slices_of_a_stream_are_written_by_all_tasks_and_are_its_batches(spark, tmp_path):
    # Of four tasks, one has rows of all slices and three of one slice alone.
    i = F.col("id")
    rows = spark.range(0, 40, 1, 4).select(F.when(i < 10, i).when(i < 20, i % 3).when(i < 30, i % 3 + 7).otherwise(i % 2 + 4).alias("k"))
    stream = streams._stream(rows, "k", str(tmp_path))
    assert [len(list((tmp_path / "in" / str(k)).glob("*.parquet"))) for k in range(3)] == [4, 4, 4]
    keyed.append_epochs(stream, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(120)
    got = [sorted(r.k for r in spark.read.parquet(f"{tmp_path}/o/epoch={k}").collect()) for k in range(3)]
    ks = sorted([*range(10), *[i % 3 for i in range(10, 20)], *[i % 3 + 7 for i in range(20, 30)], *[i % 2 + 4 for i in range(30, 40)]])
    assert got == [[k for k in ks if k < 3], [k for k in ks if 3 <= k < 6], [k for k in ks if k >= 6]]


def test_shares_of_a_visitor_have_one_state(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=k) for k in range(60)]
    spark.createDataFrame([(None if k % 6 == 5 else 2**60 + k % 2, at[k], k) for k in range(60)], "who bigint, ts timestamp, id int").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("who bigint, ts timestamp, id int").parquet(f"{tmp_path}/in")
    keyed.append_epochs(keyed.visitor_totals(src, "who", "ts", "id", salts=8, most=3, days=1), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(120)
    seen = spark.read.parquet(f"{tmp_path}/o/epoch=0")
    micros = lambda *ks: [int(at[k].timestamp()) * 1_000_000 for k in ks]
    assert sorted(((r.who or 0, r.n, r._times) for r in seen.collect())) == [(0, 10, micros(47, 53, 59)), (2**60, 30, micros(54, 56, 58)), (2**60 + 1, 20, micros(51, 55, 57))]


def test_teams_are_resolved_with_players_dealt_by_game_and_only_once_for_a_contract(spark):
    rows = [(1, "a", "1", True), (1, "b", "1", False), *[(2, n, t, None) for n, t in zip("abca", "1122", strict=True)], (3, None, None, True), (3, "b", None, False)]
    players = spark.createDataFrame([(*r, False) for r in rows], "game_id int, name string, team_id string, winner boolean, resigned boolean").withColumn("steam_id", F.lit(None).cast("string"))
    results = rosters.resolve_teams(players, spark.createDataFrame([(g, True, False) for g in range(1, 5)], "game_id int, postgame boolean, scoreboard boolean"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(game_id#" in plan(results) and not re.search(r"hashpartitioning\(game_id#\w+, \w", plan(results).replace(", 4)", ")"))
    assert {r.game_id: (r.status, r.format, r.reason_codes, r.winning_team) for r in results.collect()} == {
        1: ("resolved", "1v1", "", "name:a"),
        2: ("conflicting", "unknown", "duplicate_player_identity", None),
        3: ("resolved", "1v1", "", None),
        4: ("incomplete", "unknown", "roster_incomplete", None),
    }
    games = spark.createDataFrame([(g, True, "postgame", "ok") for g in range(1, 5)], "game_id int, completed boolean, completion_source string, parse_reason string")
    out = rosters.apply_contract(games, players, results)
    assert "n_full" not in plan(out)
    assert {r.game_id: r.winner_keys for r in out.collect()} == {1: ["name:a"], 2: [], 3: [], 4: []}
