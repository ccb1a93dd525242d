"""Queries on sources, sinks and small helpers: what they need is written to a fresh folder from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import text as t
from tallyfield.functions.times import utc_iso
from tallyfield.operators import corpus, games, rosters
from tallyfield.sources import tables
from tallyfield.sources.shared import fresh_folder

from .registry import query


def _folder(df, name: str) -> str:
    return fresh_folder(df.sparkSession, name)


@query("SELECT 'e' || event_id || ' ' || event_type || ' ' || user_id AS value, event_id % 4 AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS place FROM events")
def log_lines(read):
    """T-01: lines of the first readable path of a list, numbered as they stand in their file."""
    from pyspark.sql import Window

    events = read("events")
    lines = events.select((F.col("event_id") % 4).alias("part"), "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("value"))
    path = _folder(events, "log")
    # The writer sorts by part unless the rows are so already, and then keeps no order within a part.
    lines.repartition(4, "part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    found = tables.read_log(events.sparkSession, [f"{path}-missing", path])
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return found.select("value", part.alias("part"), F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long").alias("place"))


@query("SELECT sha256(text) AS replay_hash, source || '/' || doc_id AS archive_relative_path, CASE WHEN lang <> 'en' THEN lang || ', \"x\"' END AS note FROM documents")
def manifest_csv(read):
    """C-03: a manifest written as CSV, with quotes and commas, and read as text columns."""
    docs = read("documents")
    path = _folder(docs, "manifest")
    rows = docs.select(F.sha2("text", 256).alias("replay_hash"), F.concat_ws("/", "source", "doc_id").alias("archive_relative_path"), F.when(F.col("lang") != "en", F.concat("lang", F.lit(', "x"'))).alias("note"))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    return tables.read_manifest(docs.sparkSession, path)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'a | ' || o_orderstatus WHEN o_custkey % 2 = 1 THEN 'b' END AS codes FROM orders")
def csv_report(read):
    """C-04: fixed columns in order, lists joined."""
    orders = read("orders")
    path = _folder(orders, "report")
    rows = orders.withColumn("codes", F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("a"), "o_orderstatus")).otherwise(F.array(F.lit("b"))))
    tables.write_csv_report(rows, path, ["codes", "o_orderkey"])
    return orders.sparkSession.read.option("header", "true").csv(path)


@query("""SELECT '{"n":' || CASE WHEN o_custkey % 3 > 0 THEN o_custkey::VARCHAR ELSE 'null' END || ',"status":"' || o_orderstatus || '"}' AS value FROM orders""")
def json_report(read):
    """C-05: keys in order, nulls kept."""
    orders = read("orders")
    path = _folder(orders, "report")
    tables.write_json_report(orders.select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("n")), path)
    return orders.sparkSession.read.text(path)


@query("SELECT o_orderkey AS id, o_orderstatus AS winner, o_orderstatus = 'F' AS is_final FROM orders")
def games_table(read):
    """G-01: only the columns of a match row are read."""
    orders = read("orders")
    path = _folder(orders, "games")
    orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("winner"), (F.col("o_orderstatus") == "F").alias("is_final"), "o_totalprice").write.parquet(path)
    return tables.read_games(orders.sparkSession, path)


@query(
    """
WITH c AS (SELECT s_suppkey, sha256('k' || s_suppkey) AS run_key, s_name, '{"semantic_hash":"' || s_nationkey || '","artifact":{"sha256":"' || s_suppkey || '"}}' AS content FROM supplier)
SELECT run_key, code FROM c, (SELECT unnest(['size_mismatch', 'hash_mismatch', 'semantic_hash_mismatch', 'input_hash_mismatch', 'missing']) AS code)
WHERE code = 'missing' AND s_suppkey % 7 = 0 OR s_suppkey % 7 > 0 AND (code = 'size_mismatch' AND s_suppkey % 7 = 1 OR code = 'hash_mismatch' AND s_suppkey % 7 IN (1, 2) OR code = 'semantic_hash_mismatch' AND s_suppkey % 7 = 3 OR code = 'input_hash_mismatch' AND s_suppkey % 7 = 4)"""
)
def candidate_store(read):
    """E-01, E-02: candidates stored once, a second store of the same keys adds none; what differs from the runs' record."""
    supplier = read("supplier")
    path, k = _folder(supplier, "candidates"), F.col("s_suppkey")
    content = F.concat(F.lit('{"semantic_hash":"'), F.col("s_nationkey").cast("string"), F.lit('","artifact":{"sha256":"'), k.cast("string"), F.lit('"}}'))
    rows = supplier.select(F.lit("j").alias("job"), F.sha2(F.concat(F.lit("k"), k.cast("string")), 256).alias("run_key"), content.alias("content"))
    tables.store_candidates(rows.filter(k % 7 != 0), path)
    store = supplier.sparkSession.read.schema("run_key string, content string")
    tables.store_candidates(rows.filter(k % 7 != 0), path, store.json(path))
    stored = store.json(path)
    part = lambda n, wrong, right: F.when((k % 7).isin(n) if isinstance(n, int) else (k % 7).isin(*n), wrong).otherwise(right)
    runs = supplier.select(
        F.sha2(F.concat(F.lit("k"), k.cast("string")), 256).alias("run_key"), part(1, F.length(content) + 1, F.length(content)).alias("byte_size"), part((1, 2), F.lit("x"), F.sha2(content, 256)).alias("content_hash"),
        part(3, F.lit("-1"), F.col("s_nationkey").cast("string")).alias("semantic_hash"), part(4, F.lit("-1"), k.cast("string")).alias("input_hash"),
    )
    return tables.candidate_problems(stored, runs)


@query(
    """SELECT 'add' AS what, o_custkey AS k FROM orders GROUP BY 2 HAVING o_custkey % 3 > 0
UNION ALL SELECT 'conflict', o_custkey FROM orders GROUP BY 2 HAVING o_custkey % 3 = 0 AND o_custkey % 2 = 0"""
)
def append_only(read):
    """E-03, E-04: keys to add, and those that are there with another value."""
    rows = read("orders").select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 5).alias("v"))
    there = read("customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5 + F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0)).alias("v"))
    _, conflict = tables.upsert_if_absent(rows, there, "k", ["v"])
    return tables.append_new(rows, there, "k").select(F.lit("add").alias("what"), "k").union(conflict.select(F.lit("conflict"), "k"))


@query("SELECT lang, source, count(*) AS lines, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, CASE WHEN source LIKE '%9' THEN 'ValueError: a source that ends in 9' END AS failure FROM documents GROUP BY 1, 2")
def parsed_files(read):
    """X-08: a user's parser on files; what it raises is a result."""
    docs = read("documents")
    path = _folder(docs, "artifacts")
    docs.select(F.col("doc_id").cast("string").alias("value"), "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").text(path)

    def parse(name, content):
        if name.rsplit("/", 2)[1].endswith("9"):
            raise ValueError("a source that ends in 9")
        return {"lines": content.count(b"\n"), "bytes": len(content)}

    found = tables.parse_artifacts(docs.sparkSession, path, parse, "lines bigint, bytes bigint")
    held = docs.groupBy("lang", "source").agg(F.count("*").alias("_n"), F.sum(F.length(F.col("doc_id").cast("string")) + 1).alias("_b"))
    told = found.select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "lines", "bytes", "failure").join(held, ["lang", "source"])
    failed = F.col("failure").isNotNull()
    return told.select("lang", "source", F.when(failed, F.col("_n")).otherwise(F.col("lines")).alias("lines"), F.when(failed, F.col("_b")).otherwise(F.col("bytes")).alias("bytes"), "failure")


@query(
    """SELECT c_custkey, 'Customer ' || c_custkey AS clean, CASE WHEN c_acctbal IS NOT NULL THEN trunc(c_acctbal)::BIGINT END AS truncated, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT END AS whole,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flagged, CASE WHEN c_nationkey NOT IN (3, 4) THEN c_nationkey::VARCHAR END AS team,
  CASE WHEN c_custkey % 2 = 0 THEN (76561190000000000 + c_custkey)::VARCHAR END AS steam, CASE WHEN c_custkey % 2 = 0 THEN 'steam:' || (76561190000000000 + c_custkey) ELSE 'name:customer ' || c_custkey END AS key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(c_custkey), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM customer"""
)
def scalar_helpers(read):
    """S-03 to S-06, S-08 to S-10: text, numbers, flags, teams, accounts, keys and times of customers."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("  Customer\t "), k.cast("string"), F.lit(" \n"))
    steam = F.when(k % 2 == 0, (F.lit(76_561_190_000_000_000) + k).cast("string")).otherwise(F.lit("123"))
    team = F.when(F.col("c_nationkey") == 3, "-1").when(F.col("c_nationkey") == 4, " None ").otherwise(F.col("c_nationkey").cast("string"))
    said = F.when(k % 4 == 0, "True").when(k % 4 == 1, "no").when(k % 4 == 2, "1")
    balance = F.col("c_acctbal").cast("string")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + k)
    return read("customer").select(
        "c_custkey", t.clean_text(name).alias("clean"), t.truncating_int(balance).alias("truncated"), t.whole_int(balance).alias("whole"), t.flag(said).alias("flagged"), t.team_id(team).alias("team"),
        t.steam_id(steam).alias("steam"), t.player_key(steam, name).alias("key"), utc_iso(at).alias("iso"),
    )


@query(
    """SELECT o_orderkey AS game_id, 0 AS position, 'Ann ' || o_custkey AS name, 1 AS number, o_custkey::VARCHAR AS steam_id, 'Franks' AS civilization, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 3)::VARCHAR END AS team_id, o_custkey % 2 = 0 AS winner FROM orders
UNION ALL SELECT o_orderkey, 2, 'Bob', 7, NULL, NULL, '0', NULL FROM orders"""
)
def canonical_players(read):
    """S-07, S-11: rosters from JSON by their alias keys; the player without a name is left out."""
    c = F.col("o_custkey")
    team = F.when(c % 3 > 0, (c % 3).cast("string")).otherwise(F.lit("none"))
    text = F.concat(
        F.lit('[{"player_name":" Ann  '), c.cast("string"), F.lit('","number":"1","user_id":"'), c.cast("string"), F.lit('","civilization":"Franks","team":"'), team, F.lit('","winner":'), F.when(c % 2 == 0, "true").otherwise("false"),
        F.lit('},{"name":" ","number":"3"},{"name":"Bob","player_number":"7.0","number":"7","team_id":"0","odd":[1]}]'),
    )
    out = rosters.canonical_players(read("orders").select(F.col("o_orderkey").alias("game_id"), text.alias("players_json")))
    return out.select("game_id", "position", "name", "number", "steam_id", "civilization", "team_id", "winner")


@query(
    """WITH g AS (SELECT o_orderkey AS id, o_custkey AS replay_hash, o_orderstatus = 'F' AS fin, o_orderkey % 3 AS m FROM orders)
SELECT 'final' AS lane, replay_hash, max(id) AS id FROM g WHERE fin AND m = 0 GROUP BY 2 UNION ALL SELECT 'live', replay_hash, max(id) FROM g WHERE NOT fin AND m < 2 GROUP BY 2"""
)
def placeholder_rows(read):
    """G-07: the newest unparsed final and the newest live row without a roster of each hash."""
    m = F.col("o_orderkey") % 3
    rows = read("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("replay_hash"), (F.col("o_orderstatus") == "F").alias("is_final"), F.when(m == 0, " Watcher_Final_UNPARSED").otherwise("ok").alias("parse_reason"), F.when(m > 0, m).alias("player_count")
    )
    return games.unparsed_finals(rows).select(F.lit("final").alias("lane"), "replay_hash", "id").union(games.placeholder_lives(rows).select(F.lit("live"), "replay_hash", "id"))


@query(
    """WITH r AS (SELECT DISTINCT l_suppkey, 'x' AS spelling FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT s_suppkey, CASE WHEN spelling IS NOT NULL AND s_suppkey % 4 > 0 THEN 'o NAME ' || s_suppkey ELSE 'O name ' || s_suppkey END AS in_game_name, spelling IS NOT NULL AS verified, CASE WHEN spelling IS NOT NULL THEN 2 ELSE 0 END AS verification_level
FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey"""
)
def verified_users(read):
    """G-11: suppliers as users whose name stands in a roster; a locked name keeps its spelling."""
    k = F.col("s_suppkey")
    users = read("supplier").select("s_suppkey", F.concat(F.lit("O name "), k.cast("string")).alias("in_game_name"), (k % 4 == 0).alias("lock_name"), F.lit(None).cast("boolean").alias("verified"), F.lit(0).alias("verification_level"))
    seen = read("lineitem").filter(F.col("l_suppkey") % 2 == 0).select(F.concat(F.lit("o NAME "), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_shipdate").alias("played_at"))
    return games.verify_users(users, seen).select("s_suppkey", "in_game_name", "verified", "verification_level")


@query("SELECT o_orderkey AS upload_id, o_custkey AS uid, CASE WHEN o_orderkey % 5 > 0 THEN 'status ' || o_orderstatus END AS status, repeat('d', least(o_orderkey % 700, 500)::INT) AS detail FROM orders")
def attempt_rows(read):
    """G-29: one row an upload outcome, appended and read back."""
    orders, k = read("orders"), F.col("o_orderkey")
    path = _folder(orders, "attempts")
    rows = orders.select(k.alias("upload_id"), F.col("o_custkey").alias("uid"), F.lit("h").alias("replay_hash"), F.when(k % 5 > 0, F.concat(F.lit(" status  "), "o_orderstatus")).otherwise(" ").alias("status"), F.repeat(F.lit("d"), (k % 700).cast("int")).alias("detail"), F.col("o_orderdate").alias("created_at"))
    for odd in (0, 1):
        games.attempt_log(rows.filter(F.col("upload_id") % 2 == odd)).write.mode("append").parquet(path)
    return orders.sparkSession.read.parquet(path).select("upload_id", "uid", "status", "detail")


@query(
    """WITH w AS (SELECT doc_id AS k FROM labels WHERE quality = 1 UNION SELECT -1), m AS (SELECT doc_id // 2 AS k FROM documents)
SELECT 'row' AS what, m.k, count(*) AS n FROM m SEMI JOIN w USING (k) GROUP BY 2 UNION ALL SELECT 'absent', k, 1 FROM w ANTI JOIN m USING (k) UNION ALL SELECT 'repeated', k, count(*) FROM m SEMI JOIN w USING (k) GROUP BY 2 HAVING count(*) > 1"""
)
def manifest_parts(read):
    """C-07: rows of the wanted keys, wanted keys that are absent, and those that come twice."""
    manifest = read("documents").select(F.floor(F.col("doc_id") / 2).cast("long").alias("k"))
    wanted = read("labels").filter("quality = 1").select(F.col("doc_id").alias("k"))
    wanted = wanted.union(wanted.sparkSession.range(1).select(F.lit(-1).cast("long")))
    rows, absent, repeated = corpus.manifest_subset(manifest, wanted, "k")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    return counted.select(F.lit("row").alias("what"), "k", "n").union(absent.select(F.lit("absent"), "k", F.lit(1).cast("long"))).union(repeated.select(F.lit("repeated"), "k", "n"))


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'missing_run_key' END, CASE WHEN o_orderkey % 6 = 0 THEN 'missing_hash' END, CASE WHEN o_orderstatus = 'P' THEN 'status_unknown' END, CASE WHEN o_custkey % 5 = 0 THEN 'not_candidate_only' END) AS codes FROM orders"""
)
def candidate_contract(read):
    """C-45: what breaks a candidate's contract."""
    k = F.col("o_orderkey")
    rows = read("orders").select(
        "o_orderkey", F.when(k % 4 > 0, k).alias("run_key"), F.when(k % 6 == 0, " ").otherwise("h").alias("hash"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("odd").alias("status"),
        F.when(F.col("o_custkey") % 5 > 0, True).alias("candidate_only"),
    )
    return rows.select("o_orderkey", F.array_join(corpus.candidate_violations(["run_key", "hash"]), ",").alias("codes"))
