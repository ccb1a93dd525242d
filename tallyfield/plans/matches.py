"""Match-table queries: ``orders`` stand for match rows (status F is final, the customer its owner), lines for players."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.text import ms_to_seconds
from tallyfield.functions.times import filename_datetime, first_time
from tallyfield.operators import games as op
from tallyfield.operators import rosters

from .registry import query


def _orders(read):
    """Orders as match rows."""
    o = read("orders")
    reasons = F.element_at(F.array(*map(F.lit, ("superseded_by_later_upload", "final_upload", "recorded_resignation_final", "live", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.withColumns(
        {
            "is_final": F.col("o_orderstatus") == "F",
            "reason": reasons,
            "source": F.when(F.col("o_orderkey") % 3 == 0, "watcher_final").otherwise("live"),
            "winner": F.when(F.col("o_orderkey") % 4 == 0, "Unknown").when(F.col("o_orderkey") % 4 == 1, None).otherwise(F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string"))),
            "logical_key": op.logical_key(F.concat(F.lit(" Replay-"), (F.col("o_custkey") % 50).cast("string"), F.lit("-"), F.col("o_orderpriority"), F.lit(" ")), F.lit(None).cast("string"), F.col("o_orderkey")),
        }
    ).withColumn("score", op.preferred_score(F.col("reason"), F.col("is_final"), F.col("source"), F.col("winner")))


_ORDERS = """WITH g AS (
  SELECT *, o_orderstatus = 'F' AS is_final,
    ['superseded_by_later_upload', 'final_upload', 'recorded_resignation_final', 'live', ''][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS reason,
    CASE WHEN o_orderkey % 3 = 0 THEN 'watcher_final' ELSE 'live' END AS source,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'p' || (o_orderkey % 7) END AS winner,
    'replay:' || lower('Replay-' || (o_custkey % 50) || '-' || o_orderpriority) AS logical_key FROM orders
), r AS (
  SELECT *, (CASE WHEN reason = 'superseded_by_later_upload' THEN -100000 ELSE 0 END) + (CASE WHEN is_final THEN 10000 ELSE 0 END)
   + (CASE WHEN source = 'watcher_final' THEN 2000 ELSE 0 END) + (CASE WHEN winner IS NOT NULL AND winner <> 'Unknown' THEN 1000 ELSE 0 END)
   + (CASE WHEN contains(reason, 'final') THEN 250 ELSE 0 END) + (CASE WHEN contains(reason, 'resignation') THEN 150 ELSE 0 END) AS score FROM g
)
"""


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS final FROM orders")
def game_counts(read):
    """G-03 and G-12."""
    return op.game_counts(_orders(read))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1")
def feed_keep_first(read):
    """G-13."""
    rows = op.finals(_orders(read)).withColumn("k", op.identity(F.concat_ws("/", "o_custkey", "o_orderpriority"), F.lit(None).cast("string"), F.col("o_orderkey")))
    return op.feed_keep_first(rows, "k", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 5000")
def feed_order(read):
    """G-19: the feed's 5000-row page is the feature."""
    return op.feed_order(op.finals(_orders(read)), "o_orderdate", "o_orderdate", "o_orderkey", 5000).select("o_orderkey", "o_orderdate")


@query(_ORDERS + "SELECT o_orderkey, CAST(score AS INTEGER) AS score, row_number() OVER (PARTITION BY logical_key ORDER BY score DESC, o_orderdate DESC NULLS LAST, o_orderkey DESC) AS place FROM r")
def preferred_rank(read):
    """G-14 and S-17."""
    return op.preferred_first(_orders(read), "logical_key", "score", "o_orderdate", "o_orderkey").select("o_orderkey", "score", F.col("place").cast("long").alias("place"))


@query(
    _ORDERS + """SELECT o_orderkey, logical_key, n AS rows_of_key FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey, logical_key) AS n
  FROM (SELECT *, avg(o_orderkey) OVER (PARTITION BY o_custkey) AS anchor FROM r) WHERE is_final AND o_orderkey <= anchor WINDOW w AS (PARTITION BY o_custkey, logical_key ORDER BY score DESC, o_orderdate DESC NULLS LAST, o_orderkey DESC)) WHERE rn = 1"""
)
def freeze_cohort(read):
    """G-15: the cohort of every customer, up to the mean of their order ids."""
    anchors = read("orders").groupBy("o_custkey").agg(F.avg("o_orderkey").alias("anchor"))
    rows = _orders(read).join(anchors, "o_custkey").withColumn("user_key", F.concat_ws(":", "o_custkey", "logical_key"))
    return op.freeze_cohort(rows, F.lit(True), F.col("anchor"), "user_key", "score", "o_orderdate", "o_orderkey").select("o_orderkey", "logical_key", "rows_of_key")


@query(
    _ORDERS + """SELECT logical_key, o_orderkey, place = 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY logical_key ORDER BY score DESC, o_orderdate DESC NULLS LAST, o_orderkey DESC) AS place,
  count(*) OVER (PARTITION BY logical_key) AS n FROM r) WHERE n > 1"""
)
def duplicate_groups(read):
    """G-16."""
    rows = op.preferred_first(_orders(read), "logical_key", "score", "o_orderdate", "o_orderkey").filter(F.col("rows_of_key") > 1)
    return rows.select("logical_key", "o_orderkey", (F.col("place") == 1).alias("selected"))


_PLATFORM = """SELECT o_orderkey, f AND rn = 1 AS is_final, f AND rn > 1 AS demoted FROM (SELECT o_orderkey, o_orderstatus = 'F' AS f,
  row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn FROM orders)"""


@query(_PLATFORM.format("ASC"))
def platform_dedupe_oldest(read):
    """G-17 and G-18, keeping the oldest."""
    return op.platform_dedupe(_orders(read), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "is_final", "demoted")


@query(_PLATFORM.format("DESC"))
def platform_dedupe_newest(read):
    """G-17, keeping the newest."""
    return op.platform_dedupe(_orders(read), "o_custkey", "o_orderdate", "o_orderkey", "newest").select("o_orderkey", "is_final", "demoted")


@query(
    """WITH x AS (SELECT *, o_orderstatus = 'F' AS f, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
  live AS (SELECT DISTINCT o_totalprice AS h FROM orders WHERE o_orderstatus <> 'F')
  SELECT o_orderkey, CASE WHEN f AND rn > 1 THEN CASE WHEN h IS NULL THEN 'demote' ELSE 'mark' END END AS action FROM x LEFT JOIN live ON o_totalprice = h"""
)
def supersede_versions(read):
    """G-23: the price stands for the content hash."""
    return op.supersede(_orders(read), ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", "action")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""
)
def legacy_json_repair(read):
    """G-05 and X-09: JSON, JSON within a JSON string, and broken text."""
    e = read("events")
    text = F.when(F.col("event_id") % 4 == 3, F.lit("{broken")).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("props"))
    fixed = op.repair_json(text, "struct<k:bigint>", F.struct(F.lit(None).cast("bigint").alias("k")))
    return e.select("event_id", F.coalesce(fixed["k"], F.lit(-1)).alias("k"))


@query("SELECT c_custkey, l AS last_seen FROM (SELECT c_custkey, max(o_orderdate) AS l FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE l >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 50000 MINUTES")
def user_activity_windows(read):
    """G-04: who was seen within a window of minutes."""
    seen = read("customer").join(read("orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    return op.online_users(seen, F.expr("timestamp_ntz'1998-06-01 00:00:00'"), 50000)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def newest_users(read):
    """G-04: a top-k report."""
    return op.newest_users(read("customer"), "c_acctbal", "c_custkey", 25).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, greatest(TIMESTAMP '1995-01-01 00:00:00', max(o_orderdate)) AS last_seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def last_seen(read):
    """G-30."""
    users = read("customer").select(F.col("c_custkey").alias("uid"), F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("last_seen"))
    return op.last_seen_upsert(users, read("orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("ts"))).select(F.col("uid").alias("c_custkey"), "last_seen")


@query("SELECT c_custkey FROM customer WHERE lower(c_name) IN (SELECT 'customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') FROM supplier)")
def find_users(read):
    """G-06: a batch of names against users, in any case."""
    names = read("supplier").select(F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("name"))
    return op.find_users(read("customer"), names, "c_name").select("c_custkey")


@query(
    """WITH a AS (SELECT c_nationkey AS game_id, c_custkey % 40 AS k, max(c_acctbal) AS rating FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey AS game_id, s_suppkey % 40 AS k, max(s_acctbal) AS rating FROM supplier GROUP BY 1, 2)
  SELECT coalesce(a.game_id, b.game_id) AS game_id, 'n' || coalesce(a.k, b.k) AS name_key, coalesce(b.rating, a.rating) AS rating FROM a FULL JOIN b ON a.game_id = b.game_id AND a.k = b.k"""
)
def name_merge_full_outer(read):
    """G-09: customers as known players, suppliers as parsed ones, a nation as a game."""
    name = lambda c: F.concat(F.lit(" N"), (F.col(c) % 40).cast("string"))
    a = read("customer").groupBy(F.col("c_nationkey").alias("game_id"), name("c_custkey").alias("name")).agg(F.max("c_acctbal").alias("rating"))
    b = read("supplier").groupBy(F.col("s_nationkey").alias("game_id"), name("s_suppkey").alias("name")).agg(F.max("s_acctbal").alias("rating"))
    return op.merge_players(a, b, ["rating"])


@query("SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS rating, s_acctbal IS NOT NULL AND s_acctbal <> c_acctbal AS changed FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def rating_backfill(read):
    """G-10."""
    players = read("customer").select("c_custkey", F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("rating"))
    ratings = read("supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("rating"))
    return op.backfill_rating(players, ratings).select("c_custkey", "rating", "changed")


@query(
    """SELECT game_id, name FROM (SELECT l_orderkey AS game_id, 's' || l_suppkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey = o_custkey THEN 0 ELSE 1 END, l_linenumber, CAST(l_suppkey AS VARCHAR)) AS rn
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = o_custkey OR l_suppkey % 10 = o_custkey % 10) WHERE rn = 1"""
)
def uploader_player(read):
    """G-08: the order's customer against its lines' suppliers, by id before name."""
    lines = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    name = F.when(F.col("l_suppkey") % 10 == F.col("o_custkey") % 10, "Me").otherwise("Other")
    roster = lines.select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").cast("string").alias("steam_id"), name.alias("name"))
    uploads = read("orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").cast("string").alias("steam_id"), F.lit("me").alias("in_game_name"), F.lit(None).cast("string").alias("persona_name"), F.lit(" ME ").alias("given_name"))
    return op.match_uploader(roster, uploads).select("game_id", F.concat(F.lit("s"), "steam_id").alias("name"))


def _players(read):
    """Lines as players: team by line number, winner by return flag, resigned by quantity."""
    return read("lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("steam_id"),
        (F.col("l_linenumber") % 2).cast("string").alias("team_id"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("winner"),
        (F.col("l_quantity") < 25).alias("resigned"),
    )


def _matches(read):
    return read("orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_orderstatus") == "F").alias("postgame"), (F.col("o_orderpriority") == "1-URGENT").alias("scoreboard"))


_TEAMS = """WITH p AS (
  SELECT l_orderkey AS game_id, 'name:s' || l_suppkey AS k, CAST(l_linenumber % 2 AS VARCHAR) AS team, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS winner, l_quantity < 25 AS resigned FROM lineitem
), n AS (SELECT game_id, count(*) AS player_count, count(DISTINCT k) AS keys FROM p GROUP BY 1
), t AS (
  SELECT p.game_id, CASE WHEN player_count = 2 AND keys = 2 THEN k ELSE team END AS side, count(*) AS size, count(*) FILTER (winner) AS won, count(*) FILTER (NOT winner) AS lost, count(*) FILTER (resigned) AS gone
  FROM p JOIN n USING (game_id) GROUP BY 1, 2
), s AS (
  SELECT game_id, count(*) AS n_teams, min(size) AS least, max(size) AS most, count(*) FILTER (won = size) AS n_won, max(side) FILTER (won = size) AS won_side, count(*) FILTER (lost = size) AS n_lost,
         count(*) FILTER (won > 0) AS n_any, max(side) FILTER (won > 0 AND lost = 0) AS single_side, count(*) FILTER (gone = size) AS n_full, max(side) FILTER (gone <> size) AS other_side FROM t GROUP BY 1
), g AS (
  SELECT o_orderkey AS game_id, o_orderstatus = 'F' AS post, o_orderpriority = '1-URGENT' AS board, coalesce(player_count, 0) AS player_count, coalesce(keys, 0) AS keys, n_teams, least, most, n_won, won_side, n_lost, n_any, single_side, n_full, other_side
  FROM orders LEFT JOIN n ON n.game_id = o_orderkey LEFT JOIN s ON s.game_id = o_orderkey
), c AS (
  SELECT *, player_count <> keys AS dup, player_count = 2 AND keys = 2 AS two, player_count < 2 AS small, player_count NOT IN (4, 6, 8) AS odd FROM g
), d AS (
  SELECT *, NOT two AND NOT small AND NOT odd AND n_teams <> 2 AS wrong, NOT two AND NOT small AND NOT odd AND (least * 2 <> player_count OR most * 2 <> player_count) AS uneven FROM c
), e AS (
  SELECT *, two OR (NOT small AND NOT odd AND NOT dup AND NOT wrong AND NOT uneven) AS ok,
    concat_ws(',', CASE WHEN dup THEN 'duplicate_player_identity' END, CASE WHEN wrong THEN 'expected_exactly_two_teams' END, CASE WHEN small THEN 'roster_incomplete' END, CASE WHEN uneven THEN 'unequal_team_sizes' END, CASE WHEN NOT two AND NOT small AND odd THEN 'unsupported_team_format' END) AS reason_codes FROM d
), f AS (
  SELECT *, CASE WHEN ok AND n_won = 1 AND n_lost = 1 THEN won_side END AS flag_team, CASE WHEN ok AND NOT (n_won = 1 AND n_lost = 1) AND n_any = 1 THEN single_side END AS single_team, CASE WHEN ok AND n_full = 1 THEN other_side END AS derived FROM e
), h AS (
  SELECT *, coalesce(flag_team, single_team) AS ev, (derived IS NOT NULL AND coalesce(flag_team, single_team) IS NOT NULL AND derived <> coalesce(flag_team, single_team)) OR (ok AND n_full > 1) AS conflict FROM f
), w AS (
  SELECT *, CASE WHEN conflict THEN NULL WHEN derived IS NOT NULL THEN derived WHEN post OR board THEN ev END AS winning_team, CASE WHEN flag_team IS NOT NULL THEN 'winner_flags' ELSE 'single_team_winner_flags' END AS kind FROM h
)
"""


@query(
    _TEAMS
    + """SELECT game_id, player_count, CASE WHEN ok THEN 'resolved' WHEN small THEN 'incomplete' WHEN NOT two AND odd THEN 'unsupported' ELSE 'conflicting' END AS status,
  CASE WHEN two THEN '1v1' WHEN ok THEN (player_count // 2) || 'v' || (player_count // 2) ELSE 'unknown' END AS format, reason_codes FROM w"""
)
def team_resolution(read):
    """R-03."""
    return rosters.resolve_teams(_players(read), _matches(read)).select("game_id", "player_count", "status", "format", "reason_codes")


@query(
    _TEAMS
    + """SELECT game_id, flag_team, single_team, winning_team, winning_team IS NOT NULL AS result_trusted, CASE WHEN winning_team IS NULL THEN 'review_required' ELSE 'resolved' END AS result_status,
  CASE WHEN conflict THEN 'conflicting_result_evidence' WHEN derived IS NOT NULL THEN 'complete_losing_team_resignation' WHEN post AND ev IS NOT NULL THEN 'postgame_' || kind WHEN board AND ev IS NOT NULL THEN 'scoreboard_' || kind
       WHEN flag_team IS NOT NULL THEN 'coherent_player_winner_flags_review' WHEN single_team IS NOT NULL THEN 'single_team_player_winner_flags_review' ELSE 'insufficient_result_evidence' END AS result_provenance FROM w"""
)
def result_resolution(read):
    """R-04 and R-05."""
    return rosters.resolve_teams(_players(read), _matches(read)).select("game_id", "flag_team", "single_team", "winning_team", "result_trusted", "result_status", "result_provenance")


@query(
    _TEAMS + "SELECT l_orderkey AS game_id, l_linenumber AS position, CASE WHEN winning_team IS NOT NULL THEN winning_team = CAST(l_linenumber % 2 AS VARCHAR) OR winning_team = 'name:s' || l_suppkey END AS is_winner FROM lineitem LEFT JOIN w ON w.game_id = l_orderkey"
)
def apply_result(read):
    """R-06: winners of trusted results on the roster rows."""
    rows = read("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("steam_id"), (F.col("l_linenumber") % 2).cast("string").alias("team_id"))
    return rosters.apply_result(rows, rosters.resolve_teams(_players(read), _matches(read))).select("game_id", "position", "is_winner")


@query(
    _TEAMS
    + """, k AS (
  SELECT l_orderkey AS game_id, string_agg('name:s' || l_suppkey, '|' ORDER BY 'name:s' || l_suppkey) AS winner_keys, string_agg('S' || l_suppkey, '|' ORDER BY 'S' || l_suppkey) AS winner_names
  FROM lineitem JOIN w ON w.game_id = l_orderkey WHERE winning_team = CAST(l_linenumber % 2 AS VARCHAR) OR winning_team = 'name:s' || l_suppkey GROUP BY 1
), x AS (
  SELECT o_orderkey AS game_id, o_orderkey % 2 = 0 AS resigned, o_orderkey % 3 = 0 AS completed, coalesce(derived IS NOT NULL, false) AS proven, winning_team, coalesce(winner_keys, '') AS winner_keys, coalesce(winner_names, '') AS winner_names
  FROM orders LEFT JOIN w ON w.game_id = o_orderkey LEFT JOIN k ON k.game_id = o_orderkey)
  SELECT game_id, winning_team, winner_keys, winner_names, CASE WHEN resigned THEN completed END AS raw_completed, CASE WHEN resigned THEN proven END AS resignation_proves_completion, completed AND NOT (resigned AND NOT proven) AS completed,
    CASE WHEN resigned AND proven THEN 'complete_team_resignation' WHEN resigned THEN 'team_resignation_review_required' ELSE 'postgame' END AS completion_source,
    CASE WHEN resigned AND NOT proven THEN 'team_resignation_not_complete' ELSE 'final' END AS parse_reason FROM x"""
)
def match_contract(read):
    """R-06: completion and winners of each game; every second game ended by resignation."""
    c = F.col
    games_ = read("orders").select(c("o_orderkey").alias("game_id"), (c("o_orderkey") % 3 == 0).alias("completed"), F.when(c("o_orderkey") % 2 == 0, "resignation").otherwise("postgame").alias("completion_source"), F.lit("final").alias("parse_reason"))
    players = _players(read)
    out = rosters.apply_contract(games_, players.drop("winner", "resigned"), rosters.resolve_teams(players, _matches(read)))
    return out.withColumns({k: F.array_join(k, "|") for k in ("winner_keys", "winner_names")}).drop("result_status", "result_provenance")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS game_id, l_linenumber AS player, l_linenumber % 2 AS side FROM lineitem),
  g AS (SELECT game_id, side, count(*) AS n FROM p GROUP BY 1, 2)
  SELECT game_id, true AS partitioned, count(*) AS groups, CAST(sum(n) AS BIGINT) AS players, CASE WHEN count(*) = 2 AND sum(n) = 2 THEN '1v1' WHEN count(*) = 2 AND max(n) > 1 THEN 'TG' WHEN count(*) > 2 AND max(n) = 1 THEN 'FFA' ELSE 'Other' END AS label FROM g GROUP BY 1"""
)
def alliance_groups(read):
    """R-08: lines of an order as players, allied with those of the same parity."""
    p = read("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("player")).distinct()
    ally = p.select("game_id", "player", F.explode(F.array(*[F.col("player") + k for k in (-6, -4, -2, 2, 4, 6)])).alias("peer"), F.lit("ally").alias("relation"))
    return rosters.alliance_groups(ally, p).select("game_id", "partitioned", "groups", "players", "label")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'postgame' WHEN s > 0 OR a > 0 THEN 'scoreboard' WHEN o_orderstatus = 'F' AND r > 0 THEN 'resignation' WHEN o_orderstatus = 'F' THEN 'completion_signal' END AS completion_source
  FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) FILTER (l_tax > 0.07) AS s, count(*) FILTER (l_discount > 0.09) AS a, count(*) FILTER (l_quantity < 5) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
)
def completion_ladder(read):
    """R-02 and R-09."""
    lines = read("lineitem").select(F.col("l_orderkey").alias("game_id"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("score"), F.when(F.col("l_discount") > 0.09, 1).alias("achievement_total"), "l_quantity")
    gone = lines.groupBy("game_id").agg(F.count_if(F.col("l_quantity") < 5).alias("gone"))
    c = F.col
    rows = read("orders").join(rosters.roster_counters(lines).join(gone, "game_id"), c("game_id") == c("o_orderkey"), "left")
    return rows.select("o_orderkey", rosters.completion_source(c("o_orderpriority") == "1-URGENT", c("player_score_count") > 0, c("achievement_player_count") > 0, c("o_orderstatus") == "F", c("gone") > 0).alias("completion_source"))


@query(
    """SELECT o_orderkey, CASE WHEN chat THEN ch ELSE d END AS duration, CASE WHEN gone THEN 'Unknown' ELSE 'w' END AS winner, gone AS early_exit, CASE WHEN chat THEN 'chat_preview_seconds_override' END AS duration_source
  FROM (SELECT *, d > 0 AND d < 60 AND ch >= 60 AS chat, d > 0 AND d < 60 AND ch < 60 AND o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS gone
        FROM (SELECT *, CAST(o_orderkey % 120 AS BIGINT) AS d, CAST(o_custkey % 90 AS BIGINT) AS ch FROM orders))"""
)
def early_exit(read):
    """R-10."""
    c = F.col
    out = rosters.early_exit(c("o_orderkey") % 120, c("o_custkey") % 90, c("o_orderstatus") == "F", c("o_orderkey") % 2 == 0, F.lit(None).cast("boolean"), F.lit("w"))
    return read("orders").select("o_orderkey", out.alias("x")).select("o_orderkey", "x.*")


@query(
    """SELECT o_orderkey, CASE WHEN d >= 60000 AND o_orderkey % 5 <> 0 THEN CAST(greatest(1, ceil(d / 1000.0)) AS BIGINT) ELSE d END AS duration, CASE WHEN d > 0 THEN CAST(greatest(1, ceil(d / 1000.0)) AS BIGINT) END AS seconds
  FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS d FROM orders)"""
)
def duration_repair(read):
    """G-20 and S-15."""
    d = F.floor("o_totalprice").cast("long")
    return read("orders").select("o_orderkey", op.repair_duration(d, F.lit(None).cast("long"), F.col("o_orderkey") % 5 == 0).alias("duration"), ms_to_seconds(d).alias("seconds"))


@query(
    """
WITH u AS (
  SELECT o_custkey, o_orderkey AS upload_id, o_orderstatus = 'F' AS trusted, o_totalprice::DOUBLE AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS p FROM orders
), f AS (
  SELECT *, min(CASE WHEN trusted THEN p END) OVER w AS first, max(CASE WHEN trusted THEN p END) OVER w AS last, max(size) OVER (PARTITION BY o_custkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         row_number() OVER (PARTITION BY o_custkey ORDER BY size DESC, p) AS by_size FROM u WINDOW w AS (PARTITION BY o_custkey)
)
SELECT o_custkey, max(CASE WHEN p = last OR last IS NULL AND by_size = 1 THEN upload_id END) AS upload_id, max(last) IS NOT NULL AS trusted, max(CASE WHEN p = last OR last IS NULL AND by_size = 1 THEN size END) AS size,
       count(*) FILTER (trusted) + count(*) FILTER ((first IS NULL OR p < first) AND (before IS NULL OR size > before)) - 1 AS replaced
FROM f GROUP BY 1"""
)
def reupload_fold(read):
    """G-22: orders of a customer as uploads of one match; the fold as running maxima before the first trusted upload."""
    rows = read("orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("upload_id"), (F.col("o_orderstatus") == "F").alias("trusted"), F.col("o_totalprice").alias("size"))
    return op.reupload_fold(rows, "o_custkey", "o_orderdate", F.trunc("o_orderdate", "month"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS read_at FROM events"""
)
def filename_datetimes(read):
    """S-01: event times rendered in both file-name forms, or not at all."""
    name = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "'a/MP Replay @'yyyy.MM.dd HHmmss'.mgz'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "'rec.'yyyyMMdd-HHmmss'.mgz'")).otherwise(F.lit("20241399-256161.mgz"))
    return read("events").select("event_id", filename_datetime(name).cast("timestamp_ntz").alias("read_at"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'watcher' WHEN o_orderkey % 3 = 1 THEN 'played_on' ELSE 'created_at' END AS source, o_orderkey % 3 = 0 AS absolute FROM orders"""
)
def played_at(read):
    """S-02: the first time there is, with its source."""
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    pick = first_time(("watcher", F.when(k == 0, at), True), ("played_on", F.when(k == 1, at), False), ("created_at", at, False))
    return read("orders").select("o_orderkey", pick["source"].alias("source"), pick["absolute"].alias("absolute"))


@query(
    """SELECT o_orderkey, role, final, rejected, error FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'final_replay' ELSE 'live_replay' END WHEN 1 THEN 'saved_game_snapshot' END AS role,
    o_orderkey % 3 = 0 AND o_orderstatus = 'F' AS final, o_orderkey % 3 = 1 AND o_orderstatus = 'F' AS rejected,
    CASE o_orderkey % 3 WHEN 2 THEN 'unsupported_extension' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'role_conflicts_with_extension' END END AS error FROM orders)"""
)
def file_roles(read):
    """S-19 and S-20."""
    k = F.col("o_orderkey")
    suffix = F.when(k % 3 == 0, ".MGZ").when(k % 3 == 1, ".msx").otherwise(".zip")
    role = op.file_role(suffix, F.when(k % 2 == 0, "final_replay"), F.col("o_orderstatus") == "F")
    return read("orders").select("o_orderkey", role["role"].alias("role"), role["effective_final"].alias("final"), role["rejected"].alias("rejected"), role["error"].alias("error"))


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'size_mismatch' END, CASE WHEN o_orderkey % 6 = 1 THEN 'claimed_sha_invalid' END, CASE WHEN o_orderkey % 6 = 2 THEN 'sha256_mismatch' END) AS codes FROM orders"""
)
def upload_integrity(read):
    """G-27."""
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    claimed = F.when(k % 6 == 1, "xyz").when(k % 6 == 2, F.sha2(F.lit("other"), 256)).when(k % 6 == 3, None).otherwise(F.upper(sha))
    return read("orders").select("o_orderkey", F.array_join(op.upload_violations(F.when(k % 4 == 0, k + 1).otherwise(k), k, claimed, sha), ",").alias("codes"))


@query(
    """SELECT o_orderkey, f AND r AS result_resolved, f AND r AND t AS betting_eligible, f AND r AND o_orderkey % 5 <> 0 AS stats_eligible, CASE WHEN NOT f THEN 'live' WHEN r AND t THEN 'complete' WHEN r THEN 'provisional' ELSE 'incomplete' END AS completeness, f AND NOT r AS retry_useful
  FROM (SELECT o_orderkey, o_orderstatus = 'F' AS f, o_orderkey % 2 = 0 AS r, o_orderkey % 3 = 0 AS t FROM orders)"""
)
def finality(read):
    """G-24."""
    k = F.col("o_orderkey")
    row = F.struct((F.col("o_orderstatus") == "F").alias("is_final"), (k % 2 == 0).alias("resolved"), (k % 3 == 0).alias("trusted"), (k % 5 == 0).alias("early_exit"))
    return read("orders").select("o_orderkey", row.alias("row")).select("o_orderkey", op.finality(F.col("row")).alias("f")).select("o_orderkey", "f.*")


@query(
    """SELECT o_orderkey FROM orders x WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderstatus = 'F' AND e.o_orderkey % 997 = x.o_orderkey % 997 AND e.o_orderkey % 2 = 0)
  AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderstatus = 'F' AND e.o_custkey = x.o_custkey AND e.o_orderkey % 2 = 0)"""
)
def ingest_new_matches(read):
    """G-02: open orders whose hash and platform id are not yet final."""
    rows = read("orders").select("o_orderkey", (F.col("o_orderkey") % 997).alias("replay_hash"), F.col("o_custkey").alias("platform_match_id"), F.lit(None).cast("string").alias("parse_source"), F.lit(None).cast("int").alias("duration"), F.lit(60).alias("game_duration"), "o_orderstatus")
    existing = rows.withColumn("is_final", (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0))
    return op.ingest_matches(rows.filter(F.col("o_orderstatus") == "O"), existing).select("o_orderkey")
