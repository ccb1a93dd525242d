"""Further queries: geo texts, repairs, metadata, audits and reference checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import corpus, games, rosters, traffic

from .matches import _TEAMS, _matches, _players
from .registry import query


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'ZZ' WHEN 2 THEN c_name ELSE '??' END AS country, CASE c_custkey % 4 WHEN 1 THEN c_name ELSE '' END AS area, CASE c_custkey % 4 WHEN 0 THEN 'Ulm' ELSE '' END AS city FROM customer"""
)
def geo_texts(read):
    """T-16: answers for a city, a code without a name, a country, and none."""
    k = F.col("c_custkey") % 4
    text = (
        F.when(k == 0, "GeoIP City Edition, Rev 1: DE, N/A, Ulm, 89073")
        .when(k == 1, F.concat(F.lit("GeoIP City Edition, Rev 1: zz, "), "c_name", F.lit(", N/A")))
        .when(k == 2, F.concat(F.lit("GeoIP Country Edition: XX, "), "c_name"))
        .otherwise("GeoIP Country Edition: IP Address not found")
    )
    return read("customer").select("c_custkey", traffic.parse_geo(text).alias("g")).select("c_custkey", "g.*")


@query(
    """SELECT o_orderkey, CASE WHEN e AND ch >= 60 THEN greatest(d, ch) ELSE d END AS duration, CASE WHEN e AND ch < 60 THEN 'hd_early_exit_under_60s' END AS reason, e AND ch >= 60 AS repaired
  FROM (SELECT o_orderkey, CAST(o_orderkey % 60 AS BIGINT) AS d, CAST(o_custkey % 120 AS BIGINT) AS ch, o_orderstatus = 'F' AS e FROM orders)"""
)
def early_exit_repair(read):
    """G-21."""
    reason = F.when(F.col("o_orderstatus") == "F", "hd_early_exit_under_60s")
    return read("orders").select("o_orderkey", games.repair_early_exit(F.col("o_orderkey") % 60, reason, F.col("o_custkey") % 120).alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'b' ELSE 'Unknown' END AS asked, 'Unknown' AS by_default FROM orders")
def opponent_inference(read):
    """G-21: off by default."""
    c = F.col
    args = (F.lit("Unknown"), F.lit(2), c("o_orderkey") % 2 == 0, c("o_orderstatus") != "O", F.when(c("o_orderkey") % 3 == 0, "a"), F.lit("b"))
    return read("orders").select("o_orderkey", games.infer_opponent_winner(*args, enabled=True).alias("asked"), games.infer_opponent_winner(*args).alias("by_default"))


@query("SELECT o_orderkey, (o_orderstatus = 'F' OR o_orderkey % 3 = 0) AND o_orderkey % 2 = 0 AS disconnected FROM orders")
def live_disconnects(read):
    """G-26."""
    c = F.col
    return read("orders").select("o_orderkey", games.live_disconnect(c("o_orderstatus") == "F", c("o_orderkey") % 2 == 0, c("o_orderkey") % 3 == 0).alias("disconnected"))


@query("SELECT c_custkey AS upload_id, 'Unknown' AS winner, 0 AS duration, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS player_names, 'watcher_final_unparsed' AS parse_reason, 'bad header' AS failure FROM customer")
def unparsed_finals(read):
    """G-26: proof rows."""
    uploads = read("customer").select(F.col("c_custkey").alias("upload_id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("  "), "c_name")).alias("claimed_name"), F.lit(" bad   header ").alias("failure"))
    return games.unparsed_final_rows(uploads).withColumn("player_names", F.array_join("player_names", ","))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '{"s_name":"' || s_name[:9] || '"}' ELSE '{"s_name":"' || s_name[:9] || '","size":' || s_suppkey || '}' END AS metadata FROM supplier""")
def upload_metadata(read):
    """G-28 and S-18: blanks and numbers that are not positive are left out."""
    rows = read("supplier").withColumn("size", F.when(F.col("s_suppkey") % 4 == 0, F.lit("-5")).otherwise(F.col("s_suppkey").cast("string"))).withColumn("other", F.lit("  "))
    return rows.select("s_suppkey", games.upload_metadata({"s_name": 9, "other": 5}, ["size"]).alias("metadata"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'aoe2_hd' WHEN 1 THEN 'aoe2_de' WHEN 2 THEN 'legacy_aoc' END AS format, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS map FROM part")
def format_and_map(read):
    """S-22 and G-28."""
    k = F.col("p_partkey")
    version = F.when(k % 4 == 0, "Version.HD").when(k % 4 == 1, "de").when(k % 4 == 2, "Version.AOC")
    return read("part").select("p_partkey", games.game_format(version).alias("format"), games.map_payload(F.when(k % 2 == 0, F.lit("Unknown")).otherwise(F.col("p_type")), F.col("p_brand")).alias("map"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40 OFFSET 20")
def snapshot_page(read):
    """C-08: a page of the manifest is the feature."""
    return corpus.snapshot_slice(read("documents").withColumn("extension", F.upper("lang")), "en", 20, 40, "doc_id").select("doc_id", "source")


@query(
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS failed, CAST(sum(o_custkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS bytes, min(o_orderkey) FILTER (o_orderstatus = 'F') AS least_ms, max(o_orderkey) FILTER (o_orderstatus = 'F') AS greatest_ms, (SELECT '{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}' FROM (SELECT (o_custkey % 12)::VARCHAR AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)) AS players_counts, (SELECT '{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}' FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 > 0 GROUP BY 1)) AS version_counts FROM orders"""
)
def snapshot_audits(read):
    """C-29: outcome with histograms of player counts and versions."""
    k = F.col("o_orderkey")
    rows = read("orders").select(F.when(F.col("o_orderstatus") != "F", "x").alias("failure"), F.col("o_custkey").alias("bytes"), k.alias("restore_ms"), (F.col("o_custkey") % 12).alias("players"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("version"))
    return corpus.snapshot_audit(rows, ["players", "version"]).withColumns({c: F.to_json(c) for c in ("players_counts", "version_counts")})


@query(
    """SELECT count(*) AS candidates, count(*) FILTER (o_orderpriority[1:1] = '1') AS saved, count(*) FILTER (o_orderpriority[1:1] <> '1') AS recorded, count(*) FILTER (o_orderpriority[1:1] = '1' AND o_orderkey % 3 <> 0) AS saved_with_id,
  count(DISTINCT o_custkey) FILTER (o_orderpriority[1:1] = '1' AND o_orderkey % 3 <> 0) AS distinct_ids FROM orders"""
)
def corpus_summary(read):
    """C-23."""
    return corpus.corpus_summary(read("orders").select(F.col("o_orderpriority").alias("parse_mode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("platform_match_id")), "1")


@query(
    """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS row_no, l_partkey AS h, l_orderkey + 1 AS g, l_suppkey AS a, l_partkey AS u FROM lineitem), x AS (
  SELECT m.*, o_orderkey, o_custkey, s_suppkey, s_nationkey, c_custkey FROM m LEFT JOIN orders ON o_orderkey = g LEFT JOIN supplier ON s_suppkey = a LEFT JOIN customer ON c_custkey = u)
  SELECT row_no, 'game_missing' AS code FROM x WHERE o_orderkey IS NULL UNION ALL SELECT row_no, 'attempt_missing' FROM x WHERE s_suppkey IS NULL UNION ALL SELECT row_no, 'user_missing' FROM x WHERE c_custkey IS NULL UNION ALL
  SELECT row_no, 'game_hash_differs' FROM x WHERE o_custkey <> h UNION ALL SELECT row_no, 'attempt_hash_differs' FROM x WHERE s_nationkey <> h UNION ALL SELECT row_no, 'attempt_game_differs' FROM x WHERE s_suppkey * 3 <> g"""
)
def manifest_references(read):
    """C-18: lines as manifest rows, orders as games, suppliers as attempts, customers as users."""
    c = F.col
    manifest = read("lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("row_no"), c("l_partkey").alias("replay_hash"), (c("l_orderkey") + 1).alias("game_id"), c("l_suppkey").alias("attempt_id"), c("l_partkey").alias("uid"))
    return corpus.reference_issues(
        manifest,
        read("orders").select(c("o_orderkey").alias("game_id"), c("o_custkey").alias("game_hash")),
        read("supplier").select(c("s_suppkey").alias("attempt_id"), c("s_nationkey").alias("attempt_hash"), (c("s_suppkey") * 3).alias("attempt_game")),
        read("customer").select(c("c_custkey").alias("uid")),
    )


@query(
    """WITH n AS (SELECT l_orderkey AS game_id, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1)
  SELECT l_orderkey AS game_id, l_suppkey, coalesce(n IN (4, 6, 8) AND n = k AND l_orderkey % 3 <> 0, false) AS recovered, CASE WHEN n IN (4, 6, 8) AND n = k AND l_orderkey % 3 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS team_id FROM lineitem JOIN n ON n.game_id = l_orderkey"""
)
def team_id_recovery(read):
    """R-01: rosters without teams and a second one with them; every third game's second roster lacks a team."""
    c = F.col
    rows = read("lineitem").select(c("l_orderkey").alias("game_id"), F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("name"), "l_suppkey", c("l_linenumber").cast("string").alias("team"))
    target = rows.select("game_id", "name", "l_suppkey", F.lit(None).cast("string").alias("team_id"))
    source = rows.select("game_id", F.upper("name").alias("name"), F.when(c("game_id") % 3 != 0, c("team")).alias("team_id"))
    return rosters.recover_team_ids(target, source).select("game_id", "l_suppkey", "recovered", "team_id")


@query(
    _TEAMS.replace("player_count NOT IN (4, 6, 8) AS odd FROM g", "player_count NOT IN (4, 6, 8) AS strange, false AS odd FROM g")
    .replace("NOT two AND NOT small AND NOT odd AND (least * 2 <> player_count OR most * 2 <> player_count) AS uneven FROM c", "false AS uneven FROM c")
    .replace("THEN 'expected_exactly_two_teams' END", "AND NOT strange THEN 'expected_exactly_two_teams' END")
    .replace("NOT two AND NOT small AND odd THEN 'unsupported_team_format'", "wrong AND strange THEN 'unsupported_team_format'")
    + """SELECT game_id, player_count, CASE WHEN ok THEN 'resolved' WHEN small THEN 'incomplete' WHEN wrong AND strange THEN 'unsupported' ELSE 'conflicting' END AS status, reason_codes, flag_team, winning_team FROM w"""
)
def team_resolution_uneven(read):
    """R-07: teams of unequal sizes and rosters of any size allowed."""
    return rosters.resolve_teams(_players(read), _matches(read), allow_uneven=True).select("game_id", "player_count", "status", "reason_codes", "flag_team", "winning_team")
