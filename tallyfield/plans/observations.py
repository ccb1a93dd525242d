"""Queries on the observation catalogue and on receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import games
from tallyfield.operators import observations as op

from .registry import query

#: Parts of a record: a condition (of key modulo n, is or is not 0) and JSON with @k (the key), @m (key % 9), @b (true for even keys) and @t (true for multiples of three).
_PIECES = (
    (None, '"game_version":"v@m"'),
    ((2, True), '"duration":@k'),
    ((3, True), '"completed":true'),
    (None, '"key_events":{"player_score_count":@m,"postgame_available":@b,"rated":@t,"settings":{"cheats":@b,"mod":"x","speed":@m}}'),
    ((5, False), '"map_snapshot":{"id":@m,"name":"M @m","size":null,"terrain_histogram":[1,@m]}'),
    ((4, False), '"team_resolution":{"result_trusted":@t,"winning_player_keys":["a","b@m"],"winning_team_id":@m}'),
    ((7, True), '"actions":{"available":@b,"count":@k,"type_counts":{"MOVE":@m},"unique_action_identity_count":3}'),
    (None, '"players":[{"name":" Ann @m","steam_id":"@k","number":1,"winner":@b,"score":@k,"achievements":{"economy":{"food_collected":@k},"military":{"score":@m,"units_lost":0}}},{"name":"Bob","number":2,"human":false,"eapm":12}]'),
)


def _record():
    k = F.col("c_custkey")
    truth = lambda n: F.when(k % n == 0, "true").otherwise("false")
    parts = []
    for condition, text in _PIECES:
        piece = F.lit(text)
        for mark, value in (("@k", k.cast("string")), ("@m", (k % 9).cast("string")), ("@b", truth(2)), ("@t", truth(3))):
            piece = F.replace(piece, F.lit(mark), value)
        parts.append(piece if condition is None else F.when((k % condition[0] == 0) == F.lit(condition[1]), piece))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _record_sql() -> str:
    parts = []
    for condition, text in _PIECES:
        piece = "'" + text + "'"
        for mark, value in (("@k", "c_custkey::VARCHAR"), ("@m", "(c_custkey % 9)::VARCHAR"), ("@b", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END"), ("@t", "CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END")):
            piece = f"replace({piece}, '{mark}', {value})"
        parts.append(piece if condition is None else f"CASE WHEN (c_custkey % {condition[0]} = 0) = {condition[1]} THEN {piece} END")
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


#: Rules in SQL: value, provenance, exact.
_RULES = {
    "header": ("v", "CASE WHEN v IS NULL THEN 'absent' ELSE 'direct_header' END", "true"),
    "always_header": ("v", "'direct_header'", "true"),
    "always_derived": ("v", "'derived_coherent'", "true"),
    "completed": ("coalesce(v, 'false')", "CASE WHEN postgame THEN 'direct_postgame' ELSE 'derived_coherent' END", "true"),
    "flag": ("trusted::VARCHAR", "'derived_coherent'", "true"),
    "result": ("v", "CASE WHEN trusted THEN 'derived_coherent' WHEN v IS NOT NULL THEN 'inferred_review_only' ELSE 'absent' END", "trusted"),
    "action": ("CASE WHEN acts THEN v END", "CASE WHEN acts THEN 'direct_action' ELSE 'absent' END", "acts"),
    "action_derived": ("CASE WHEN acts THEN v END", "CASE WHEN acts THEN 'derived_coherent' ELSE 'absent' END", "acts"),
    "action_rough": ("CASE WHEN acts THEN v END", "CASE WHEN acts THEN 'derived_coherent' ELSE 'absent' END", "false"),
    "action_inferred": ("CASE WHEN acts THEN v END", "CASE WHEN acts THEN 'inferred_review_only' ELSE 'absent' END", "false"),
    "rough": ("v", "CASE WHEN v IS NULL THEN 'absent' ELSE 'derived_coherent' END", "false"),
    "winner": ("v", "CASE WHEN v IS NULL THEN 'absent' WHEN postgame THEN 'direct_postgame' ELSE 'inferred_review_only' END", "v IS NOT NULL AND postgame"),
    "achievement": ("CASE WHEN postgame THEN v END", "CASE WHEN postgame AND v IS NOT NULL THEN 'direct_postgame' ELSE 'absent' END", "postgame AND v IS NOT NULL"),
    "score": ("CASE WHEN scores THEN v END", "CASE WHEN scores AND v IS NOT NULL THEN 'direct_postgame' ELSE 'absent' END", "scores AND v IS NOT NULL"),
}


def _observed_sql() -> str:
    fields = ", ".join(f"('{f.name}', '{f.subject}', '{f.path}', '{f.rule}')" for f in op.CATALOGUE)
    case = lambda at: "CASE rule " + " ".join(f"WHEN '{r}' THEN {x[at]}" for r, x in _RULES.items()) + " END"
    return f"""
WITH rec AS (SELECT c_custkey AS k, ({_record_sql()})::JSON AS j FROM customer
), gates AS (
  SELECT k, j, j->>'$.key_events.postgame_available' = 'true' AS postgame, coalesce(j->>'$.team_resolution.result_trusted' = 'true', false) AS trusted,
         coalesce(j->>'$.actions.available' = 'true', false) AS acts, (j->>'$.key_events.postgame_available' = 'true') OR (j->>'$.key_events.player_score_count')::INT <> 0 AS scores FROM rec
), subjects AS (
  SELECT *, 'game' AS subject, NULL::VARCHAR AS player_key, NULL::INT AS player_number, j AS body FROM gates
  UNION ALL SELECT *, 'player', 'steam:' || k, 1, json_extract(j, '$.players[0]') FROM gates
  UNION ALL SELECT *, 'player', 'name:bob', 2, json_extract(j, '$.players[1]') FROM gates
), f(field, subject, path, rule) AS (VALUES {fields}
), x AS (SELECT s.*, f.field, f.rule, nullif(json_extract(s.body, f.path)::VARCHAR, 'null') AS v FROM subjects s JOIN f USING (subject))
SELECT k AS c_custkey, subject, player_key, player_number, field, {case(0)} AS value, {case(1)} AS provenance, {case(2)} AS exact FROM x
UNION ALL SELECT k, 'game', NULL, NULL, 'settings.mod', '"x"', 'direct_header', true FROM gates"""


@query(_observed_sql())
def observation_catalogue(read):
    """E-16: every field kind of the catalogue, of the game and of its players, with provenance, exactness and subject."""
    # A record becomes a hundred rows: the few splits of a small table are dealt over all tasks first, by a number that holds.
    customers = read("customer").select("c_custkey")
    tasks = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    games = customers.repartition(tasks, "c_custkey").select("c_custkey", F.parse_json(_record()).alias("record"))
    return op.observe(games, "c_custkey", "record").drop("conflict_state")


@query(
    """
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, k % 3 + 1 >= 2 AND k % 2 = 0 AND greatest(k % 4, k % 3) >= k % 3 + 1 AS complete,
       k % 4 > 0 OR k % 3 > 0 OR (k % 5 = 0 AND k % 13 = 0) OR (k % 2 = 0 AND k % 6 = 0) OR (k % 7 = 0 AND k % 11 > 0) AS available
FROM c"""
)
def statistics_lanes(read):
    """G-25: whether figures are there, and whether they are those of every player."""
    k = F.col("c_custkey")
    key_events = F.struct(
        (k % 2 == 0).alias("has_achievements"), (k % 4).alias("achievement_player_count"), (k % 3).cast("string").alias("player_score_count"), (k % 5 == 0).alias("has_scores"),
        F.struct((k % 7 == 0).alias("action_stream_available"), (k % 11 - 1).alias("raw_action_count")).alias("parser_engine"),
    )
    player = F.struct(F.when(k % 13 == 0, 0).alias("score"), F.struct(F.struct(F.when(k % 6 == 0, 1).alias("x"), F.lit(" ").alias("y")).alias("military")).alias("achievements"))
    record = F.to_variant_object(F.struct(key_events.alias("key_events"), F.array(player).alias("players")))
    return read("customer").select("c_custkey", games.statistics_available(record, k % 3 + 1).alias("s")).select("c_custkey", "s.*")


_SIZES = {"activity": 4000, "moves": 3000, "evidence": 2000, "summary": 500}


def _part_sql(name: str) -> str:
    return f"'\"' || repeat('{name[0]}', (o_orderkey * {len(name)} % {_SIZES[name]})::INT) || '\"'"


@query(
    f"""
WITH p AS (
  SELECT o_orderkey, '"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"' AS base, {", ".join(f"{_part_sql(n)} AS {n}" for n in _SIZES)} FROM orders
), n AS (
  SELECT *, octet_length(encode(base)) + 2 AS b, {", ".join(f"length({n}) + {len(n) + 4} AS n_{n}" for n in _SIZES)} FROM p
), c AS (
  SELECT *, 4096 - b - {sum(len(n) + 8 for n in _SIZES) + len("truncated_stages") + 7 + sum(len(s) + 3 for s in op.STAGES)} AS room FROM n
), d AS (
  SELECT *, CASE WHEN n_summary > room THEN 3 WHEN n_summary + n_evidence > room THEN 2 WHEN n_summary + n_evidence + n_moves + n_activity > room OR n_summary + n_evidence + n_activity > room THEN 1 ELSE 0 END AS gone FROM c
), t AS (
  SELECT *, '{{' || base || ',"summary":' || CASE WHEN gone < 3 THEN summary ELSE 'null' END || ',"evidence":' || CASE WHEN gone < 2 THEN evidence ELSE 'null' END || ',"activity":' || CASE WHEN gone < 1 THEN activity ELSE 'null' END
    || ',"moves":' || CASE WHEN gone < 1 THEN moves ELSE 'null' END || ',"truncated_stages":[' || CASE gone WHEN 0 THEN '' WHEN 1 THEN '"activity"' WHEN 2 THEN '"activity","evidence"' ELSE '"activity","evidence","summary"' END || ']}}' AS receipt FROM d
)
SELECT o_orderkey, sha256(receipt) AS receipt_hash, length(receipt) AS receipt_bytes, CASE gone WHEN 0 THEN '' WHEN 1 THEN 'activity' WHEN 2 THEN 'activity,evidence' ELSE 'activity,evidence,summary' END AS truncated_stages, length(receipt) <= 4096 AS within FROM t"""
)
def bounded_receipts(read):
    """E-19: receipts of at most 4 KB, cut stage by stage by the encoded lengths of their parts."""
    text = lambda n: F.concat(F.lit('"'), F.repeat(F.lit(n[0]), (F.col("o_orderkey") * len(n) % _SIZES[n]).cast("int")), F.lit('"'))
    rows = read("orders").select("o_orderkey", "o_orderstatus", *[text(n).alias(n) for n in _SIZES])
    stages = [("activity", "activity"), ("moves", "activity"), ("evidence", "evidence"), ("summary", "summary")]
    out = op.receipts(rows, ["o_orderkey", "o_orderstatus"], stages, 4096)
    return out.select("o_orderkey", F.sha2("receipt", 256).alias("receipt_hash"), F.col("receipt_bytes").cast("long").alias("receipt_bytes"), F.array_join("truncated_stages", ",").alias("truncated_stages"), (F.col("receipt_bytes") <= 4096).alias("within"))
