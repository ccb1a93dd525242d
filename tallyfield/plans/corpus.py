"""Reconciliation queries: parts as artifacts, lines as attempts and runs, documents as manifest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.documents import with_canonical, with_compact
from tallyfield.functions.text import REDACTIONS, TRUNCATED
from tallyfield.operators import corpus as op

from .registry import query

@query(
    """WITH g AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey DESC, l_linenumber) AS rn FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber) AS rn FROM lineitem)
  SELECT p_partkey, g.o_orderkey AS game_order, a.l_orderkey AS attempt_order FROM part LEFT JOIN g ON g.l_partkey = p_partkey AND g.rn = 1 LEFT JOIN a ON a.l_partkey = p_partkey AND a.rn = 1"""
)
def artifact_manifest_best_links(read):
    """C-09."""
    c = F.col
    lines = read("lineitem").withColumnRenamed("l_partkey", "p_partkey")
    games = lines.join(read("orders"), c("o_orderkey") == c("l_orderkey")).select("p_partkey", c("o_orderkey").alias("order"), (c("o_orderstatus") == "F").alias("f"), "o_totalprice", "l_linenumber")
    attempts = lines.select("p_partkey", c("l_orderkey").alias("order"), "l_shipdate", "l_linenumber")
    out = op.artifact_manifest(read("part").select("p_partkey"), games, attempts, "p_partkey", [F.desc("f"), F.desc("o_totalprice"), F.desc("order"), c("l_linenumber")], [F.desc("l_shipdate"), F.desc("order"), c("l_linenumber")])
    return out.select("p_partkey", "game_order", "attempt_order")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS archive_present, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS submissions FROM customer")
def cohort_manifest(read):
    """C-10: suppliers as the archive, orders as submissions."""
    return op.cohort_manifest(read("customer").select("c_custkey"), read("supplier").select(F.col("s_suppkey").alias("c_custkey")), read("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _facts(read):
    """Each order as a game: its customer the match id, its lines' suppliers the roster."""
    o, li = read("orders"), read("lineitem")
    ids = o.select(F.col("o_orderkey").alias("id"), F.lit("platform_match_id").alias("f"), F.col("o_custkey").cast("string").alias("v"))
    names = li.select(F.col("l_orderkey").alias("id"), F.lit("player.name").alias("f"), F.concat(F.lit("P"), (F.col("l_suppkey") % 3).cast("string")).alias("v"))
    steam = li.select(F.col("l_orderkey").alias("id"), F.lit("player.steam_id").alias("f"), (F.col("l_suppkey") % 2).cast("string").alias("v"))
    return op.facts(ids.union(names).union(steam), "id", "f", "v")


def _links(read):
    f, o = _facts(read), read("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    with_status = f.join(o, "id")
    return op.continuation_links(with_status.filter(F.col("o_orderstatus") == "O"), with_status.filter(F.col("o_orderstatus") == "F"))


_FACTS = """WITH f AS (
  SELECT o_orderkey AS id, o_orderstatus, CAST(o_custkey AS VARCHAR) AS m,
    coalesce(list_sort(list_distinct(list('p' || (l_suppkey % 3)) FILTER (l_suppkey IS NOT NULL))), []) AS names,
    coalesce(list_sort(list_distinct(list('1') FILTER (l_suppkey % 2 = 1))), []) AS steam
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
), l AS (
  SELECT s.m AS platform_match_id, s.id AS saved_id, r.id AS recorded_id, len(s.names) > 0 AND s.names = r.names AS names_exact, len(s.steam) > 0 AND s.steam = r.steam AS steam_ids_exact
  FROM f s JOIN f r ON s.m = r.m WHERE s.o_orderstatus = 'O' AND r.o_orderstatus = 'F')
"""


@query("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS platform_match_id, (SELECT string_agg(DISTINCT 'p' || (l_suppkey % 3), '|' ORDER BY 'p' || (l_suppkey % 3)) FROM lineitem WHERE l_orderkey = o_orderkey) AS names FROM orders")
def observation_facts(read):
    """C-24."""
    return _facts(read).select("id", "platform_match_id", F.nullif(F.array_join("names", "|"), F.lit("")).alias("names"))


@query(_FACTS + "SELECT *, names_exact AND steam_ids_exact AS linked FROM l")
def continuation_links(read):
    """C-11 and C-12."""
    return _links(read).drop("roster_hash")


@query(
    _FACTS
    + """SELECT count(*) AS shared_ids, CAST(sum(s) AS BIGINT) AS linked_saved, count(*) FILTER (s = 1 AND r = 1) AS one_to_one, count(*) FILTER (s > 1) AS multi_checkpoint, max(s) AS max_fan_in,
  CAST(1000000 - coalesce(sum(s), 0) AS BIGINT) AS unlinked_saved FROM (SELECT platform_match_id, count(DISTINCT saved_id) AS s, count(DISTINCT recorded_id) AS r FROM l GROUP BY 1)"""
)
def link_summary(read):
    """C-25."""
    return op.link_summary(_links(read), 1_000_000)


def _runs(read):
    c = F.col
    return read("lineitem").select(c("l_orderkey").alias("run_game"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("run_id"), F.when(c("l_linenumber") % 3 != 0, c("l_shipdate")).alias("completed_at"))


_LATEST = "(SELECT l_orderkey AS run_game, l_orderkey * 10 + l_linenumber AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END DESC NULLS FIRST, l_orderkey * 10 + l_linenumber DESC) AS rn FROM lineitem)"


@query(f"SELECT o_orderkey, run_id FROM orders JOIN {_LATEST} ON run_game = o_orderkey AND rn = 1")
def latest_run_inner(read):
    """C-13 and C-33."""
    return op.games_with_latest(read("orders").select("o_orderkey"), _runs(read), "o_orderkey", "run_game", "completed_at", "run_id", False).select("o_orderkey", "run_id")


@query(f"SELECT o_orderkey, run_id, run_id IS NULL AS missing_current_candidate FROM orders LEFT JOIN {_LATEST} ON run_game = o_orderkey AND rn = 1")
def latest_run_left(read):
    """C-14 and C-15."""
    return op.games_with_latest(read("orders").select("o_orderkey"), _runs(read), "o_orderkey", "run_game", "completed_at", "run_id", True).select("o_orderkey", "run_id", "missing_current_candidate")


@query("SELECT target, count(*) AS n FROM (SELECT l_partkey AS target FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY 1")
def or_link_counts(read):
    """C-16: a line linked to a number by its part or its supplier, counted once."""
    return op.either_link_counts(read("lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")


@query(
    """SELECT count(*) FILTER (b IS NULL) AS known_only, count(*) FILTER (a IS NULL) AS held_only, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both
  FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b"""
)
def set_differences(read):
    """C-36 and C-37."""
    return op.set_differences(read("documents"), read("labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_work(read):
    """C-39."""
    return op.remaining_work(read("documents").select("doc_id"), read("labels"), "doc_id")


def _manifest(read):
    """Documents as manifest rows, some of them spoilt by their id."""
    i = F.col("doc_id")
    sha = F.sha2(F.col("text"), 256)
    path = F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)
    return read("documents").select(
        i.alias("row_no"),
        F.when(i % 11 == 0, "nothex").when(i % 13 == 0, None).otherwise(sha).alias("replay_hash"),
        F.when(i % 7 == 0, F.concat(F.lit("/"), path)).when(i % 17 == 0, F.concat(F.lit("../"), path)).otherwise(path).alias("archive_relative_path"),
        F.when(i % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("byte_size"),
        F.when(i % 3 == 0, ".ZIP").otherwise(".MGZ").alias("extension"),
        F.when(i % 19 != 0, F.col("source")).alias("submitter_uid"),
        F.when(i % 23 == 0, "-4").when(i % 23 == 1, "x").when(i % 23 == 2, "").otherwise(i.cast("string")).alias("game_stats_id"),
        F.repeat(F.lit("n"), F.when(i % 29 == 0, 256).otherwise(255)).alias("original_filename"),
    )


_MANIFEST = """WITH m AS (
  SELECT doc_id AS row_no, sha256(text) AS sha, CASE WHEN doc_id % 11 = 0 THEN 'nothex' WHEN doc_id % 13 = 0 THEN NULL ELSE sha256(text) END AS h, n_chars, doc_id % 7 = 0 AS absolute, doc_id % 7 <> 0 AND doc_id % 17 = 0 AS up,
         doc_id % 5 = 0 AS wrong_size, doc_id % 3 = 0 AS zip, CASE WHEN doc_id % 19 <> 0 THEN source END AS uid, doc_id % 23 < 2 AS bad_id, doc_id % 29 = 0 AS long_name FROM documents
), held AS (SELECT sha256(text) AS sha, any_value(n_chars) AS n, substring(sha256(text), 1, 1) = '7' AS other FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1
), x AS (SELECT m.*, held.n, held.other, count(*) OVER (PARTITION BY h) AS times FROM m LEFT JOIN held ON m.h = held.sha)
"""


@query(
    _MANIFEST
    + """SELECT row_no, level, code FROM (
  SELECT row_no, 'error' AS level, 'hash_missing' AS code FROM x WHERE h IS NULL UNION ALL SELECT row_no, 'error', 'hash_invalid' FROM x WHERE h = 'nothex' UNION ALL
  SELECT row_no, 'error', 'path_absolute' FROM x WHERE absolute UNION ALL SELECT row_no, 'error', 'path_traversal' FROM x WHERE up UNION ALL
  SELECT row_no, 'error', 'layout_invalid' FROM x WHERE h = sha AND (absolute OR up) UNION ALL SELECT row_no, 'error', 'artifact_absent' FROM x WHERE h = sha AND n IS NULL UNION ALL
  SELECT row_no, 'error', 'path_differs' FROM x WHERE n IS NOT NULL AND (absolute OR up) UNION ALL SELECT row_no, 'error', 'size_mismatch' FROM x WHERE n IS NOT NULL AND wrong_size UNION ALL
  SELECT row_no, 'error', 'extension_unsupported' FROM x WHERE zip UNION ALL SELECT row_no, 'warning', 'duplicate_artifact' FROM x WHERE times > 1 AND h = sha UNION ALL SELECT row_no, 'warning', 'uid_missing' FROM x WHERE uid IS NULL
  UNION ALL SELECT row_no, 'error', 'invalid_game_stats_id' FROM x WHERE bad_id UNION ALL SELECT row_no, 'error', 'filename_too_long' FROM x WHERE long_name UNION ALL SELECT row_no, 'error', 'archive_hash_mismatch' FROM x WHERE other)"""
)
def manifest_validation(read):
    """C-06: every issue of every row."""
    archive = read("documents").filter(F.col("doc_id") % 4 != 0).select(F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("byte_size"))
    archive = archive.withColumn("content_sha256", F.when(F.col("sha256").startswith("7"), F.reverse("sha256")).otherwise(F.col("sha256")))
    archive = archive.withColumn("relative_path", F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), "sha256"))
    return op.manifest_issues(_manifest(read), archive, [".mgz", ".aoe2record"]).select("row_no", "level", "code")


@query(
    """WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'x' || doc_id % 30 ELSE sha256(text) END AS h, n_chars, CASE WHEN doc_id % 3 > 0 THEN '.' || lang ELSE '<none>' END AS e, CASE WHEN doc_id % 4 > 0 THEN source || lang END AS k FROM documents)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_artifacts, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(n) - count(*) FILTER (length(h) = 64) AS BIGINT) AS excess_rows,
  (SELECT '{' || string_agg('"' || e || '":' || c, ',' ORDER BY e) || '}' FROM (SELECT e, count(*) AS c FROM d GROUP BY 1)) AS extensions, (SELECT count(k) - count(DISTINCT k) FROM d) AS duplicate_logical_rows
FROM (SELECT h, count(*) AS n, max(n_chars) AS b FROM d GROUP BY 1)"""
)
def manifest_profile(read):
    """C-30 and C-21: rows whose hash is no hash count as in excess; extensions; logical keys that come again."""
    i = F.col("doc_id")
    rows = read("documents").select(F.when(i % 10 == 0, F.concat(F.lit("x"), (i % 30).cast("string"))).otherwise(F.sha2("text", 256)).alias("h"), "n_chars", F.when(i % 3 > 0, F.upper(F.concat(F.lit("."), "lang"))).alias("e"), F.when(i % 4 > 0, F.concat("source", "lang")).alias("k"))
    return op.manifest_profile(rows, "h", "n_chars", "e", "k").withColumn("extensions", F.to_json("extensions"))


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(n) FILTER (v) AS BIGINT) AS valid_objects, count(*) FILTER (v) AS unique_hashes, CAST(sum(b) FILTER (v) AS BIGINT) AS bytes, count(*) FILTER (v AND n > 1) AS duplicate_hashes,
  CAST(sum(n - 1) FILTER (v) AS BIGINT) AS duplicate_objects, CAST(coalesce(sum(n) FILTER (NOT v), 0) AS BIGINT) AS invalid_filenames, CAST(sum(off) AS BIGINT) AS layout_mismatches,
  (SELECT '{' || string_agg('"' || e || '":' || c, ',' ORDER BY e) || '}' FROM (SELECT CASE WHEN doc_id % 5 > 0 THEN '.' || lang ELSE '<none>' END AS e, count(*) AS c FROM documents GROUP BY 1)) AS extensions
  FROM (SELECT doc_id % 11 <> 0 AS v, CASE WHEN doc_id % 11 <> 0 THEN text END AS h, count(*) AS n, sum(n_chars) AS b, count(*) FILTER (doc_id % 6 = 0 AND doc_id % 11 <> 0) AS off FROM documents GROUP BY 1, 2)"""
)
def archive_profiles(read):
    """C-20: documents as archive objects."""
    i = F.col("doc_id")
    objects = read("documents").select((i % 11 != 0).alias("valid"), F.when(i % 11 != 0, F.sha2("text", 256)).alias("sha256"), F.col("n_chars").alias("byte_size"), (i % 6 != 0).alias("layout_valid"), F.when(i % 5 > 0, F.concat(F.lit("."), "lang")).otherwise(" ").alias("extension"))
    return op.archive_profile(objects).withColumn("extensions", F.to_json("extensions"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'run' ELSE 'skipped' END AS status FROM documents")
def manifest_ordinals(read):
    """C-35: numbered without gathering all rows in one task."""
    rows = read("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return op.ordinals(rows, "doc_id", "h").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "status")


@query("SELECT o_orderpriority, n, CAST(sum(n) OVER () AS BIGINT) AS total, true AS balanced FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def bucket_rollup_balanced(read):
    """C-22 and C-27."""
    return op.balanced_rollup(read("orders"), "o_orderpriority")


@query(
    """SELECT o_custkey, count(*) AS processed, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderkey % 7 = 0) AS skipped,
  count(*) = count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderkey % 7 = 0) AS balanced FROM orders GROUP BY 1"""
)
def job_accounting(read):
    """C-31."""
    one = lambda c: F.when(c, 1).otherwise(0)
    s = F.col("o_orderstatus")
    events = read("orders").select("o_custkey", F.lit(1).alias("processed"), one(s == "F").alias("succeeded"), one(s == "O").alias("failed"), one(F.col("o_orderkey") % 7 == 0).alias("skipped"))
    return op.job_accounting(events, "o_custkey")


@query("SELECT conv_id, max(turn) AS last_sequence, count(*) AS rows, count(*) FILTER (step <> 1) AS gaps, count(*) FILTER (step <> 1) = 0 AS gapless FROM (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) GROUP BY 1")
def sequence_gap_check(read):
    """C-34."""
    return op.sequence_gaps(read("conversations"), "conv_id", "turn")


def _redacted(expression: str) -> str:
    for pattern, placeholder in REDACTIONS:
        expression = "regexp_replace({}, '{}', '{}', 'g')".format(expression, pattern.replace("'", "''"), placeholder)
    return expression


def _has(*terms: str) -> str:
    return "(" + " OR ".join("contains(lower(text), '{}')".format(t.replace("'", "''")) for t in terms) + ")"


@query(
    f"""WITH f AS (SELECT text, lang AS stage, CASE WHEN doc_id % 5 = 0 THEN 'FileNotFoundError' ELSE 'ValueError' END AS e FROM documents), r AS (
  SELECT stage, CASE e WHEN 'ValueError' THEN 'value_error' ELSE 'file_not_found_error' END AS exception_class,
    CASE WHEN {_has(*TRUNCATED)} THEN 'truncated_or_incomplete' WHEN {_has("sha256")} AND {_has("mismatch", "does not match")} THEN 'artifact_integrity' WHEN {_has("no decoding mapping", "unsupported")} THEN 'unsupported_encoding_or_enum'
      WHEN {_has("invalid mgz", "could not parse")} THEN 'invalid_container' WHEN e = 'FileNotFoundError' THEN 'artifact_io' ELSE 'parser_exception' END AS category,
    coalesce(lower({_redacted("nullif(trim(regexp_replace(text, '[[:space:]]+', ' ', 'g')), '')")})[:240], lower(e)) AS message FROM f)
  SELECT stage, exception_class, category, message, count(*) AS n, category IN ('truncated_or_incomplete', 'artifact_io') AS retryable, stage || ':' || category || ':' || exception_class || ':' ||
    sha256('{{"category":"' || category || '","exception_class":"' || exception_class || '","normalized_message":' || to_json(message) || ',"stage":"' || stage || '"}}')[:16] AS signature FROM r GROUP BY 1, 2, 3, 4"""
)
def failure_triage(read):
    """C-32 and S-14: documents as failure messages."""
    exception = F.when(F.col("doc_id") % 5 == 0, "FileNotFoundError").otherwise("ValueError")
    return op.failure_triage(read("documents").select("text", "lang", exception.alias("exception")), "text", "exception", stage="lang")


@query(
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END DESC NULLS FIRST, l_linenumber DESC) AS rn FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 10)
  SELECT user_id AS job_id, event_id AS sequence, event_id + 1 AS run_id, o_orderkey AS game_id, o_totalprice AS price, l_linenumber AS adjudication_id
  FROM events JOIN customer ON c_custkey = user_id LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN a ON l_orderkey = o_orderkey AND rn = 1 WHERE event_type = 'click'"""
)
def job_report(read):
    """C-17: clicks as completed artifacts, customers as runs' owners, orders as games, lines as adjudications."""
    c = F.col
    events = read("events").select(c("user_id").alias("job_id"), c("event_id").alias("sequence"), F.when(c("event_type") == "click", "artifact_completed").otherwise("other").alias("event_type"), (c("event_id") + 1).alias("run_id"))
    owners = read("customer").select(c("c_custkey").alias("user_id"))
    runs = read("events").join(owners, "user_id").select((c("event_id") + 1).alias("run_id"), c("event_id").alias("game_id"))
    games = read("orders").select(c("o_orderkey").alias("game_id"), c("o_totalprice").alias("price"))
    decisions = read("lineitem").select(
        c("l_linenumber").alias("adjudication_id"), c("l_orderkey").alias("game_id"), F.when(c("l_returnflag") == "N", "accepted").otherwise("rejected").alias("decision_status"), (c("l_quantity") > 10).alias("affects_stats"),
        F.when(c("l_linenumber") % 3 != 0, c("l_shipdate")).alias("created_at"),
    )
    out = op.job_report(events, runs, games, decisions)
    return out.select("job_id", "sequence", "run_id", F.when(c("price").isNotNull(), c("game_id")).alias("game_id"), "price", "adjudication_id")


@query(
    """SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 3 = 0 THEN '"deep":[{"n":' || o_custkey || '}],' ELSE '' END || '"flag":false,' || CASE WHEN o_orderkey % 2 = 0 THEN '"status":"' || o_orderstatus || '",' ELSE '' END || '"zero":0}' AS compact FROM orders"""
)
def compact_records(read):
    """S-16: what is blank or empty at any depth goes, 0 and false stay."""
    c = F.col
    status = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).otherwise(F.lit('"  "'))
    inner = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit('{"n": '), c("o_custkey").cast("string"), F.lit('.0, "m": ""}'))).otherwise(F.lit('{"m": [null, " "]}'))
    text = F.concat(F.lit('{"status": '), status, F.lit(', "none": null, "deep": [{}, '), inner, F.lit('], "flag": false, "zero": 0}'))
    return with_compact(read("orders").select("o_orderkey", text.alias("text")), "text", "compact").drop("text")


@query(
    """
SELECT event_id, sha256('{"at":[' || event_id || ',{"k":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) || '}],"none":null,"type":"' || event_type || '","value":'
       || CASE WHEN value = floor(value) THEN CAST(value AS BIGINT)::VARCHAR ELSE rtrim(CAST(CAST(value AS DECIMAL(18, 6)) AS VARCHAR), '0') END || '}') AS hash
FROM events"""
)
def canonical_records(read):
    """S-12, S-13: one hash for documents alike in value, whatever the order of their keys and the form of their numbers."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    value = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.format_string("%.8f", "value"))
    text = F.concat(F.lit('{ "value": '), value, F.lit(', "type": "'), "event_type", F.lit('", "none": null, "at": ['), F.col("event_id").cast("string"), F.lit('.0, {"k": '), k, F.lit(".00}] }"))
    rows = with_canonical(read("events").select("event_id", text.alias("text")), "text", "canonical")
    return rows.select("event_id", F.sha2("canonical", 256).alias("hash"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN v THEN 'manually_verified' WHEN n < 2 THEN 'private_review_candidate' WHEN coh THEN 'resolved_coherent_team' WHEN n = 2 AND w <> 'Unknown' AND inr THEN 'resolved_coherent_1v1'
  WHEN n > 2 THEN 'team_result_revalidation_required' ELSE 'private_review_candidate' END AS label FROM (
  SELECT l_orderkey, l_linenumber, l_quantity > 45 AS v, l_partkey % 4 AS n, l_suppkey % 3 = 0 AS coh, CASE WHEN l_linenumber % 2 = 0 THEN 'Unknown' ELSE 'p' END AS w, l_partkey % 5 <> 0 AS inr FROM lineitem)"""
)
def result_classes(read):
    """C-40."""
    c = F.col
    team = F.when(c("l_suppkey") % 3 == 0, "resolved").otherwise("conflicting")
    label = op.current_result_class(c("l_quantity") > 45, F.lit("ok"), c("l_partkey") % 4, team, F.lit(2), F.lit("1"), F.when(c("l_linenumber") % 2 == 0, "Unknown").otherwise("p"), c("l_partkey") % 5 != 0)
    return read("lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query(
    """SELECT o_orderkey, CASE WHEN fail THEN 'unsupported_or_parse_failed' WHEN n < 2 THEN 'private_review_no_roster' WHEN res AND w > 0 AND t THEN 'resolved_trusted_direct_evidence' WHEN res AND w > 0 THEN 'resolved_coherent_parser_evidence'
  WHEN team THEN 'private_review_result_not_proven' ELSE 'private_review_team_or_result_incomplete' END AS bucket,
  CASE WHEN acc THEN 'human_verdict_preserved' WHEN w = 0 OR NOT res THEN 'private_review' WHEN same THEN 'matches_current_truth' WHEN nocur THEN 'candidate_improves_missing_result' ELSE 'candidate_conflicts_with_current_truth' END AS lane FROM (
  SELECT o_orderkey, o_orderkey % 13 = 0 AS fail, o_custkey % 5 AS n, o_orderstatus = 'F' AS res, o_orderkey % 3 AS w, o_orderkey % 2 = 0 AS t, o_custkey % 2 = 0 AS team, quality = 1 AS acc, o_custkey % 3 = 0 AS same, o_custkey % 3 = 1 AS nocur
  FROM orders LEFT JOIN labels ON doc_id = o_orderkey)"""
)
def result_buckets(read):
    """C-38 and C-41: labels as adjudications."""
    c = F.col
    rows = read("orders").join(read("labels"), c("doc_id") == c("o_orderkey"), "left")
    status = F.when(c("o_orderstatus") == "F", "resolved").otherwise("review_required")
    keys = F.slice(F.array(F.lit("b"), F.lit("a")), 1, (c("o_orderkey") % 3).cast("int"))
    mine = F.when(c("o_custkey") % 3 == 0, F.reverse(keys)).when(c("o_custkey") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("z")))
    bucket = op.result_bucket(F.when(c("o_orderkey") % 13 == 0, "failed").otherwise("succeeded"), c("o_custkey") % 5, status, c("o_orderkey") % 2 == 0, F.size(keys), F.when(c("o_custkey") % 2 == 0, "resolved"))
    return rows.select("o_orderkey", bucket.alias("bucket"), op.promotion_lane(c("quality") == 1, keys, mine, status).alias("lane"))


_GATES = """WITH g AS (
  SELECT o_orderkey, o_orderkey % 11 <> 0 AS ran, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS accepted, CASE WHEN o_custkey % 4 = 0 THEN 'a' WHEN o_custkey % 4 = 1 THEN 'b' END AS cur, CASE WHEN o_orderkey % 3 <> 0 THEN 'a' END AS cand,
    o_orderkey % 2 = 0 AS trusted, CASE WHEN o_custkey % 10 = 7 THEN 2 ELSE 0 END AS links, o_orderstatus = 'F' AS fin, o_custkey % 3 AS cp, o_orderkey % 9 + 1 AS p FROM orders LEFT JOIN labels ON doc_id = o_orderkey
), r AS (
  SELECT *, concat_ws(',', CASE WHEN NOT fin THEN 'game_stats_not_final' END, CASE WHEN cp >= 2 THEN 'effective_roster_not_placeholder' END, CASE WHEN p < 2 OR p > 8 THEN 'candidate_roster_out_of_bounds' END,
    CASE WHEN p % 2 = 1 THEN 'candidate_teams_not_resolved' END, CASE WHEN NOT trusted THEN 'candidate_result_not_trusted' END, CASE WHEN cand IS NULL THEN 'candidate_winner_keys_missing' END) AS reasons FROM g)
"""


def _gate_rows(read):
    c = F.col
    k, u = c("o_orderkey"), c("o_custkey")
    return read("orders").join(read("labels"), c("doc_id") == k, "left").select(
        k,
        F.when(k % 11 == 0, "failed").otherwise("succeeded").alias("run_status"),
        F.when(c("quality") == 1, 1).otherwise(0).alias("accepted"),
        F.when(u % 4 == 0, "a").when(u % 4 == 1, "b").alias("current_winner"),
        F.when(k % 3 != 0, "a").alias("candidate_winner"),
        (k % 2 == 0).alias("trusted"),
        F.when(u % 10 == 7, 2).otherwise(0).alias("links"),
        (c("o_orderstatus") == "F").alias("is_final"),
        (u % 3).alias("current_players"),
        (k % 9 + 1).alias("players"),
        (k % 9 + 1).alias("distinct_players"),
        F.when((k % 9 + 1) % 2 == 0, "resolved").otherwise("conflicting").alias("team_status"),
        F.lit("resolved").alias("result_status"),
        F.lit("postgame_winner_flags").alias("provenance"),
        F.lit(True).alias("winner_in_roster"),
        F.lit(True).alias("completed"),
        F.col("o_totalprice").cast("double").alias("price"),
    )


@query(
    _GATES
    + """SELECT o_orderkey, CASE WHEN NOT ran THEN 'candidate_parse_failed' WHEN accepted > 0 THEN 'manual_adjudication_preserved' WHEN cur IS NOT NULL AND cur = cand THEN 'matches_effective_truth'
  WHEN cur IS NOT NULL AND (cand IS NULL OR NOT trusted) THEN 'candidate_lower_confidence' WHEN cur IS NOT NULL THEN 'candidate_conflicts_with_effective_truth' WHEN links > 0 THEN 'financially_linked_missing_result'
  WHEN reasons <> '' THEN 'private_review' ELSE 'safe_projection' END AS projection_class,
  CASE WHEN NOT ran THEN 'candidate_run_not_successful' WHEN accepted > 0 THEN 'accepted_adjudication_present' WHEN cur IS NOT NULL AND cur = cand THEN 'winner_keys_already_match'
  WHEN cur IS NOT NULL AND (cand IS NULL OR NOT trusted) THEN 'effective_result_already_known' WHEN cur IS NOT NULL THEN 'winner_keys_conflict' WHEN links > 0 THEN 'linked=2' WHEN reasons <> '' THEN reasons ELSE 'all_strict_projection_gates_passed' END AS reason_codes FROM r"""
)
def projection_gates(read):
    """C-42."""
    return op.projection_gates(_gate_rows(read)).select("o_orderkey", "projection_class", "reason_codes")


@query("SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS current, count(*) FILTER (o_orderkey % 3 = 0) AS stale, count(*) FILTER (o_orderkey % 3 = 0) = 0 AS may_project FROM orders")
def artifact_binding(read):
    """C-28."""
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return op.binding_summary(read("orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.upper(sha)).alias("a"), sha.alias("b")), "a", "b")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'canonical' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'alternate_perspective' END AS label FROM orders")
def artifact_linkage(read):
    """C-19."""
    k = F.col("o_orderkey")
    return read("orders").select("o_orderkey", op.linkage(k % 3 == 0, k, k, F.when(k % 2 == 0, "duplicate_final").otherwise("failed"), F.col("o_orderstatus") == "F").alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || o_custkey ELSE 'v' END AS uid, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'submitter_uid_conflict' END AS error FROM orders")
def submitter_assertions(read):
    """C-44."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    claims = F.when(k % 3 == 0, F.array(F.lit(" "), own, F.when(k % 2 == 0, "other").otherwise(own))).otherwise(F.array(F.lit(None).cast("string"), F.lit("v")))
    return read("orders").select("o_orderkey", op.submitter_assertion(claims).alias("x")).select("o_orderkey", "x.*")
