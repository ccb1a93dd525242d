"""Evidence queries: ``events`` stand for action streams (a user is a player), tables' columns for observed fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import evidence as op
from tallyfield.operators import stats

from .registry import query

_MS = "CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS BIGINT)"


def _actions(read):
    ms = F.expr("unix_millis(cast(ts as timestamp)) - unix_millis(timestamp'2024-01-01 00:00:00')")
    return read("events").withColumn("ms", ms)


@query("SELECT user_id, event_type AS type, CASE event_type WHEN 'click' THEN 'ui' WHEN 'view' THEN 'ui' WHEN 'purchase' THEN 'trade' ELSE 'other' END AS family, count(*) AS n FROM events GROUP BY 1, 2, 3")
def action_counts(read):
    """E-05."""
    return op.action_counts(read("events"), "user_id", "event_type", {"click": "ui", "view": "ui", "purchase": "trade"})


@query(
    """WITH i AS (SELECT user_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || ',"v":' || CAST(floor(value / 20) AS BIGINT) || '}') AS packet_id, event_id FROM events)
  SELECT user_id, packet_id, count(*) AS multiplicity, min(event_id) AS first_ordinal, max(event_id) AS last_ordinal FROM i GROUP BY 1, 2"""
)
def packet_identity(read):
    """E-06 and S-12, S-13: canonical JSON, hashed."""
    rows = read("events").withColumn("v", F.floor(F.col("value") / 20).cast("long"))
    return op.packet_counts(op.packet_identity(rows, "user_id", "event_type", "v"), "user_id", "event_id")


@query(
    """SELECT user_id, multiplicity, count(*) AS packets, CAST(sum(multiplicity - 1) AS BIGINT) AS excess FROM (SELECT user_id, event_type, floor(value / 20) AS v, count(*) AS multiplicity FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def multiplicity_histogram(read):
    """E-06."""
    rows = read("events").withColumn("v", F.floor(F.col("value") / 20).cast("long"))
    return op.multiplicity_histogram(op.packet_counts(op.packet_identity(rows, "user_id", "event_type", "v"), "user_id", "event_id"), "user_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, floor(value / 20)")
def first_occurrences(read):
    """E-13: the deduplicated lane."""
    rows = op.packet_identity(read("events").withColumn("v", F.floor(F.col("value") / 20).cast("long")), "user_id", "event_type", "v")
    return op.first_occurrences(rows, "user_id", "event_id").select("user_id", "event_type", "event_id")


@query(
    f"""WITH a AS (SELECT user_id, event_id, {_MS} AS ms FROM events), g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM a),
  m AS (SELECT user_id, ms // 60000 AS minute, count(*) AS n, min(ms) AS f, max(ms) AS l, max(gap) AS gap FROM g GROUP BY 1, 2)
  SELECT user_id, CAST(sum(n) AS BIGINT) AS packets, min(f) AS first_ms, max(l) AS last_ms, count(*) AS active_minutes, max(n) AS peak_per_minute, max(gap) AS largest_gap_ms,
  round_even(sum(n) / 43.5, 2) AS per_minute FROM m GROUP BY 1"""
)
def activity_per_player(read):
    """E-07 and E-14."""
    return op.player_activity(_actions(read), "user_id", "ms", "event_id", 2_610_000)


_LANE_MAP = """(SELECT '{{' || string_agg('"' || v || '":' || c, ',' ORDER BY v) || '}}' FROM (SELECT {what} AS v, count(*) AS c FROM r x WHERE x.lane = m.lane AND x.user_id = m.user_id GROUP BY 1))"""


@query(
    f"""WITH a AS (SELECT user_id, event_id, event_type, {_MS} AS ms, row_number() OVER (PARTITION BY user_id % 10, user_id, event_type, {_MS} // 86400000 ORDER BY event_id) AS rn FROM events WHERE event_type <> 'signup'),
  r AS (SELECT 'raw' AS lane, * FROM a UNION ALL SELECT 'identity_normalized', * FROM a WHERE rn = 1),
  g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY lane, user_id ORDER BY ms, event_id) AS gap FROM r),
  n AS (SELECT lane, user_id, ms // 60000 AS minute, count(*) AS n, min(ms) AS f, max(ms) AS l, max(gap) AS gap FROM g GROUP BY 1, 2, 3),
  m AS (SELECT lane, user_id, sum(n)::BIGINT AS packets, min(f) AS first_ms, max(l) AS last_ms, count(*) AS active_minutes, max(n) AS peak_per_minute, max(gap) AS largest_gap_ms, round_even(sum(n) / 5, 2) AS per_minute, round_even(sum(n) / 5, 0)::BIGINT AS eapm FROM n GROUP BY 1, 2)
  SELECT m.*, {_LANE_MAP.format(what="event_type")} AS action_type_counts, {_LANE_MAP.format(what="CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other_command' END")} AS command_family_counts FROM m"""
)
def activity_lanes(read):
    """E-07 with both lanes and the maps: an event's user, type and day stand for its packet, sign-ups for the machine's orders."""
    kind = F.when(F.col("event_type") == "signup", "ai_order").otherwise(F.col("event_type"))
    rows = _actions(read).select((F.col("user_id") % 10).alias("game"), "user_id", "event_id", "ms", kind.alias("kind"), F.when(F.col("event_type").isin("click", "view"), "browse").alias("family"), F.concat_ws("|", "user_id", "event_type", F.floor(F.col("ms") / 86_400_000)).alias("packet_id"))
    out = op.activity_lanes(rows, "game", "user_id", "ms", "event_id", "kind", "family", 300_000)
    return out.withColumns({c: F.to_json(c) for c in ("action_type_counts", "command_family_counts")})


@query("SELECT 'name:u' || user_id AS player_key, event_id, raw_rows FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS raw_rows, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn = 1")
def first_event_per_player(read):
    """E-08: the first error of each player."""
    rows = _actions(read).filter(F.col("event_type") == "error")
    return op.earliest_per_player(rows, F.concat(F.lit("name:u"), F.col("user_id").cast("string")), "ms", "event_id").select("player_key", "event_id", "raw_rows")


@query(f"SELECT user_id, {_MS} AS timestamp_ms, event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_type IN ('purchase', 'signup')")
def timelines(read):
    """E-09."""
    rows = _actions(read).select(F.col("user_id"), F.lit(None).cast("int").alias("player_number"), F.col("ms").alias("timestamp_ms"), F.col("event_type").alias("type"), F.col("props").alias("payload"))
    return op.timeline(rows, ["purchase", "signup"], {"k": "$.k"}, "user_id").drop("player_number")


@query("SELECT s, n, row_number() OVER (ORDER BY n DESC, s ASC NULLS LAST) AS place FROM (SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS s, count(*) AS n FROM part GROUP BY 1)")
def histogram_nulls_last(read):
    """E-10 and E-11."""
    return op.histogram(read("part").select(F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("s")), "s").withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id, event_id, CAST(1000 + sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM events")
def running_clock(read):
    """E-12."""
    return op.running_clock(read("events").withColumn("inc", F.col("event_id") % 7), "user_id", "event_id", "inc", F.lit(1000)).select("user_id", "event_id", "clock")


@query(
    """SELECT game_id, CAST(sum(n) AS BIGINT) AS tiles, max(top) AS highest, sha256('[' || string_agg('{"y":' || y || ',"h":"' || h || '"}', ',' ORDER BY y, h) || ']') AS fingerprint FROM (
  SELECT l_orderkey AS game_id, l_linenumber AS y, count(*) AS n, max(l_suppkey) AS top,
    sha256('[' || string_agg('{"x":' || l_partkey || ',"terrain_id":' || l_quantity::BIGINT || ',"elevation":' || l_suppkey || '}', ',' ORDER BY l_partkey, l_quantity, l_suppkey) || ']') AS h FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def tile_summaries(read):
    """E-10: lines of an order as tiles of a map."""
    tiles = read("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("terrain_id"), F.col("l_suppkey").alias("elevation"))
    return op.tile_summary(tiles)


def _observed(read):
    c = F.col
    catalogue = {
        "player.name": (c("c_name"), "direct"),
        "result.balance": (F.when(c("c_acctbal") >= 0, F.floor("c_acctbal")), "derived"),
        "setting.segment": (F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")), "inferred"),
    }
    return op.wide_to_long(read("customer"), c("c_custkey"), catalogue).withColumn("conflict_state", F.when(c("subject") % 5 == 0, "conflict"))


_LONG = """WITH o AS (
  SELECT c_custkey AS subject, 'player.name' AS field, c_name AS value, 'direct' AS provenance, true AS exact FROM customer UNION ALL
  SELECT c_custkey, 'result.balance', CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, CASE WHEN c_acctbal >= 0 THEN 'derived' ELSE 'absent' END, false FROM customer UNION ALL
  SELECT c_custkey, 'setting.segment', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 <> 0 THEN 'inferred' ELSE 'absent' END, false FROM customer)
"""


@query(_LONG + "SELECT * FROM o")
def wide_to_long(read):
    """E-16: missing values are observations of provenance absent."""
    return _observed(read).drop("conflict_state")


@query(
    _LONG
    + """SELECT subject, field, value, CASE provenance WHEN 'direct' THEN 10000 WHEN 'derived' THEN 9000 END AS confidence_bps FROM o WHERE provenance <> 'absent' OR (starts_with(field, 'result.') AND subject % 5 = 0)"""
)
def material_filter(read):
    """E-15, E-17 and S-24."""
    return op.material(_observed(read)).select("subject", "field", "value", "confidence_bps")


@query(_LONG + "SELECT subject, count(*) AS total, count(*) FILTER (provenance <> 'absent') AS material, count(*) FILTER (exact) AS exact, CASE WHEN subject % 5 = 0 THEN count(*) ELSE 0 END AS conflicts, '{\"player\":1,\"result\":1,\"setting\":1}' AS field_roots, '{' || concat_ws(',', CASE WHEN count(*) FILTER (provenance = 'absent') > 0 THEN '\"absent\":' || count(*) FILTER (provenance = 'absent') END, CASE WHEN count(*) FILTER (provenance = 'derived') > 0 THEN '\"derived\":1' END, '\"direct\":1', CASE WHEN count(*) FILTER (provenance = 'inferred') > 0 THEN '\"inferred\":1' END) || '}' AS provenances FROM o GROUP BY 1")
def observation_profiles(read):
    """C-26."""
    # The few splits of a small table would each hold the groups of very many runs.
    return op.observation_profile(_observed(lambda name: read(name).repartition("c_custkey")), "subject").withColumns({c: F.to_json(c) for c in ("provenances", "field_roots")})


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(n, 0) END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def zero_filled_counts(read):
    """E-18: zero only where the lane is known to be there (even nations)."""
    counts = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return op.zero_filled(read("customer").select("c_custkey", "c_nationkey"), counts, ["c_custkey"], F.col("c_nationkey") % 2 == 0).select("c_custkey", "n")


@query(
    """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}') AS semantic_hash, octet_length(encode('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}')) AS bytes FROM supplier"""
)
def envelopes(read):
    """E-19."""
    return op.envelope(read("supplier"), ["s_name", "s_nationkey"]).select("s_suppkey", "semantic_hash", F.col("bytes").cast("long").alias("bytes"))


@query(
    """SELECT conv_id, turn, line, down <= 5 AS in_preview FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS down
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS m FROM conversations) WHERE m <> '')"""
)
def chat_preview(read):
    """S-21."""
    rows = read("conversations").withColumn("o", F.struct("turn", "text"))
    return op.chat_preview(rows, "conv_id", "o", "text", bucket=F.floor(F.col("turn") / 1024)).select("conv_id", "turn", F.col("line").cast("long").alias("line"), "in_preview")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY f), '|') AS labels FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def event_labels(read):
    """S-23."""
    return op.event_labels(read("events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("labels", "|").alias("labels"))


_WELCH = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS dof FROM (
  SELECT count({f}) FILTER (g) AS n1, count({f}) FILTER (NOT g) AS n2, avg({f}) FILTER (g) AS m1, avg({f}) FILTER (NOT g) AS m2, var_samp({f}) FILTER (g) AS v1, var_samp({f}) FILTER (NOT g) AS v2 FROM (SELECT *, l_returnflag = 'R' AS g FROM lineitem))"""
    for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query(f"SELECT field, n1, n2, round(t, 6) AS t, round(dof, 3) AS dof FROM ({_WELCH})")
def welch_ttest(read):
    """X-01."""
    out = stats.welch(read("lineitem").withColumn("g", F.col("l_returnflag") == "R"), "g", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("field", "n1", "n2", F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))
