"""Queries on projection records, guarded writes, candidate roll-ups and job cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import corpus as op
from tallyfield.operators import rollups
from tallyfield.sources import versions
from tallyfield.sources.shared import fresh_folder

from .corpus import _GATES, _gate_rows
from .registry import query

POLICY = "projection-1"


def _json_number(expression: str) -> str:
    """SQL for a number of at most six decimals as canonical JSON."""
    return f"CASE WHEN {expression} = floor({expression}) THEN CAST({expression} AS BIGINT)::VARCHAR ELSE rtrim(CAST(CAST({expression} AS DECIMAL(18, 6)) AS VARCHAR), '0') END"


@query(
    _GATES
    + f""", d AS (
  SELECT r.*, CASE WHEN NOT ran THEN 'candidate_parse_failed' WHEN accepted > 0 THEN 'manual_adjudication_preserved' WHEN cur IS NOT NULL AND cur = cand THEN 'matches_effective_truth'
    WHEN cur IS NOT NULL AND (cand IS NULL OR NOT trusted) THEN 'candidate_lower_confidence' WHEN cur IS NOT NULL THEN 'candidate_conflicts_with_effective_truth' WHEN links > 0 THEN 'financially_linked_missing_result'
    WHEN reasons <> '' THEN 'private_review' ELSE 'safe_projection' END AS projection_class, {_json_number("o.o_totalprice")} AS price
  FROM r JOIN orders o USING (o_orderkey)
), j AS (
  SELECT *, '{{"players":' || cp || ',"price":' || price || ',"winner":' || coalesce('"' || cur || '"', 'null') || '}}' AS b,
         '{{"players":' || p || ',"price":' || price || ',"winner":' || coalesce('"' || cand || '"', 'null') || '}}' AS n FROM d
)
SELECT o_orderkey, projection_class, cp AS before_players, cur AS before_winner, CASE WHEN projection_class = 'safe_projection' THEN p ELSE cp END AS after_players,
       CASE WHEN projection_class = 'safe_projection' THEN cand ELSE cur END AS after_winner,
       sha256('{{"after_projection":' || CASE WHEN projection_class = 'safe_projection' THEN n ELSE b END || ',"before_projection":' || b || ',"classification":"' || projection_class || '","financial_impact_classification":"'
         || CASE WHEN links > 0 THEN 'linked_financial_history' ELSE 'no_linked_financial_history' END || '","o_orderkey":' || o_orderkey || ',"policy_version":"{POLICY}"}}') AS decision_hash
FROM j"""
)
def projection_decisions(read):
    """C-42: what a candidate would change, before and after, with the hash of the decision."""
    gated = op.projection_gates(_gate_rows(read))
    before = F.struct(F.col("current_players").alias("players"), "price", F.col("current_winner").alias("winner"))
    after = F.struct(F.col("players"), "price", F.col("candidate_winner").alias("winner"))
    found = op.projection_records(gated, ["o_orderkey"], before, after, POLICY)
    return found.select(
        "o_orderkey", "projection_class", F.col("before.players").alias("before_players"), F.col("before.winner").alias("before_winner"),
        F.col("after.players").alias("after_players"), F.col("after.winner").alias("after_winner"), "decision_hash",
    )


@query(
    """
WITH g AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS fin, o_custkey % 5 AS players, o_orderkey % 4 AS part FROM orders), one AS (SELECT * FROM g WHERE fin AND part = 0), two AS (SELECT * FROM g WHERE part = 1)
SELECT 'first' AS attempt, id, 'applied' AS outcome, '' AS differs, NULL::BIGINT AS players FROM one
UNION ALL SELECT 'late', id, 'stale_version', '', NULL FROM one
UNION ALL SELECT 'mixed', id, CASE WHEN fin THEN 'not_applied' ELSE 'guard_failed' END, '', NULL FROM two
UNION ALL SELECT 'table', id, NULL, NULL, CASE WHEN fin AND part = 0 THEN players + 10 ELSE players END FROM g"""
)
def guarded_projection(read):
    """C-43: a plan that its guard lets pass, one made for a version that is gone, one with rows that the guard stops, and the table then."""
    rows = read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_final"), (F.col("o_custkey") % 5).alias("players"), F.lit("unparsed").alias("reason"))
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession, "guarded") + "/table"
    versions.create(rows, path)
    plan = lambda cond: rows.filter(cond).select("id", F.struct((F.col("players") + 10).alias("players"), F.lit("projected").alias("reason")).alias("after"))
    guard = F.col("now.is_final") & (F.col("now.reason") == "unparsed")
    done = [("first", plan(F.col("is_final") & (F.col("id") % 4 == 0)), 0), ("late", plan(F.col("is_final") & (F.col("id") % 4 == 0)), 0), ("mixed", plan(F.col("id") % 4 == 1), 1)]
    out = None
    for name, plans, version in done:
        found = versions.guarded_apply(plans, path, ["id"], ["players", "reason"], guard, version)
        found = found.select(F.lit(name).alias("attempt"), "id", "outcome", F.array_join("differs", ",").alias("differs"), F.lit(None).cast("long").alias("players"))
        out = found if out is None else out.union(found)
    table = versions.read_version(spark, path, ["id"])
    nothing = F.lit(None).cast("string")
    return out.union(table.select(F.lit("table"), "id", nothing, nothing, F.col("players").cast("long")))


def _map_sql(kind: str, source: str = "facts") -> str:
    return f"(SELECT '{{' || coalesce(string_agg('\"' || value || '\":' || n, ',' ORDER BY value), '') || '}}' FROM {source} WHERE kind = '{kind}')"


@query(
    f"""
WITH c AS (
  SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 'human_verdict_preserved' WHEN 1 THEN 'private_review' ELSE 'matches_current_truth' END AS lane,
         CASE l_partkey % 5 WHEN 0 THEN 'private_review_no_roster' WHEN 1 THEN 'unsupported_or_parse_failed' ELSE 'resolved_trusted_direct_evidence' END AS bucket FROM lineitem
), l AS (
  SELECT 'result_buckets' AS kind, bucket AS value, 1 AS n FROM c UNION ALL SELECT 'promotion_lanes', lane, 1 FROM c UNION ALL SELECT 'parse_modes', 'mode' || l_linenumber % 3, 1 FROM c
  UNION ALL SELECT 'failure_buckets', 'f' || l_linenumber, 1 FROM c WHERE l_suppkey % 3 = 0 UNION ALL SELECT 'parser_contracts', '1|2|' || lower(l_returnflag) || '|' || l_linenumber % 2, 1 FROM c
  UNION ALL SELECT 'provenance', 'direct', l_linenumber FROM c UNION ALL SELECT 'provenance', 'inferred', 2 FROM c WHERE l_linenumber > 3 UNION ALL SELECT 'field_roots', l_returnflag, l_linenumber FROM c
  UNION ALL SELECT 'equation', CASE WHEN lane = 'human_verdict_preserved' THEN 'manual' WHEN bucket LIKE 'private%' THEN 'private' WHEN bucket LIKE 'unsupp%' THEN 'unsupported' ELSE 'resolved' END, 1 FROM c
), facts AS (SELECT kind, value, sum(n)::BIGINT AS n FROM l GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) AS candidate_rows, {", ".join(f"{_map_sql(k)} AS {k}" for k in ("result_buckets", "promotion_lanes", "parse_modes", "failure_buckets", "parser_contracts", "provenance", "field_roots"))},
  {", ".join(f"(SELECT n FROM facts WHERE kind = 'equation' AND value = '{k}') AS {k}" for k in ("manual", "private", "unsupported", "resolved"))}, true AS balanced,
  (SELECT sum(l_linenumber)::BIGINT FROM c) AS raw_actions, (SELECT sum(l_quantity::BIGINT)::BIGINT FROM c) AS emitted, (SELECT count(*) FROM c WHERE l_linenumber = 1) AS chat_games, (SELECT count(*) FROM c WHERE l_returnflag = 'A') AS eligible"""
)
def candidate_rollup(read):
    """C-27: line items as candidates; one record of maps with its balance."""
    c, k = F.col, F.col("l_linenumber")
    lane = F.when(c("l_orderkey") % 4 == 0, "human_verdict_preserved").when(c("l_orderkey") % 4 == 1, "private_review").otherwise("matches_current_truth")
    bucket = F.when(c("l_partkey") % 5 == 0, "private_review_no_roster").when(c("l_partkey") % 5 == 1, "unsupported_or_parse_failed").otherwise("resolved_trusted_direct_evidence")
    inferred = F.when(k > 3, F.create_map(F.lit("direct"), k.cast("long"), F.lit("inferred"), F.lit(2).cast("long"))).otherwise(F.create_map(F.lit("direct"), k.cast("long")))
    rows = read("lineitem").select(
        bucket.alias("result_bucket"), lane.alias("promotion_lane"), F.concat(F.lit("mode"), (k % 3).cast("string")).alias("parse_mode"), F.when(c("l_suppkey") % 3 == 0, F.concat(F.lit(" f"), k.cast("string"))).alias("failure_signature"),
        F.lit("1").alias("parser_version"), F.lit(2).alias("schema_version"), F.lower("l_returnflag").alias("pass_name"), (k % 2).alias("pass_version"),
        c("l_quantity").cast("long").alias("total"), F.lit(None).cast("long").alias("material"), F.lit(1).alias("exact"), F.lit(0).alias("conflicts"), k.alias("raw_action_count"),
        F.when(k < 3, k == 1).alias("chat_available"), F.lit(False).alias("map_snapshot_available"), (c("l_returnflag") == "A").alias("settlement_evidence_eligible"),
        inferred.alias("provenance"), F.create_map("l_returnflag", k.cast("long")).alias("field_roots"),
    )
    one = rollups.candidate_rollup(rows)
    text = lambda m: F.to_json(m)
    e, a = "equation.", "advanced_stat_coverage."
    return one.select(
        "candidate_rows", *[text(x).alias(x) for x in ("result_buckets", "promotion_lanes", "parse_modes", "failure_buckets", "parser_contracts")], text(a + "provenance").alias("provenance"), text(a + "field_roots").alias("field_roots"),
        c(e + "manually_verified").alias("manual"), c(e + "private_review_candidates").alias("private"), c(e + "unsupported_or_corrupt").alias("unsupported"), c(e + "resolved_by_parser").alias("resolved"), c(e + "balanced").alias("balanced"),
        c(a + "raw_actions").alias("raw_actions"), c(a + "observations_emitted").alias("emitted"), c(a + "chat_available_games").alias("chat_games"), c("settlement_evidence_eligible").alias("eligible"),
    )


@query(
    """
WITH e AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderstatus <> 'P' AS done, o_orderkey % 40 AS ord FROM orders
), s AS (SELECT DISTINCT o_custkey, ord FROM e WHERE done AND ord > 0
), r AS (SELECT *, ord - row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS island FROM s
), t AS (SELECT o_custkey, count(*) AS cursors, count(DISTINCT island) AS ordinal_ranges, max(ord) - min(ord) + 1 - count(*) AS missing_ordinals FROM r GROUP BY 1
), n AS (SELECT o_custkey, count(*) FILTER (done AND ord > 0) AS completed, max(seq) AS processed FROM e GROUP BY 1)
SELECT o_custkey, coalesce(cursors, 0) AS cursors, completed - coalesce(cursors, 0) AS repeated, processed, coalesce(ordinal_ranges, 0) AS ordinal_ranges, coalesce(missing_ordinals, 0) AS missing_ordinals,
       coalesce(cursors, 0) = processed AS agrees
FROM n LEFT JOIN t USING (o_custkey)"""
)
def job_cursors(read):
    """C-34: orders of a customer as events of a job, the cursor set as ranges against the counter."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ordinal = F.col("o_orderkey") % 40
    cursor = F.when(ordinal > 0, F.format_string("%06d:%s", ordinal, F.lit("0123456789abcdef")))
    events = read("orders").select("o_custkey", seq.alias("seq"), F.when(F.col("o_orderstatus") != "P", "artifact_completed").otherwise("started").alias("kind"), cursor.alias("cursor"))
    return op.cursor_accounting(events.withColumn("processed", F.col("seq")), "o_custkey", "seq", "kind", "cursor", "processed")
