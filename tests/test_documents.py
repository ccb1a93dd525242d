"""JSON documents, guarded table versions, roll-ups and job cursors, with their edge cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import documents, ids
from tallyfield.operators import corpus, rollups
from tallyfield.sources import versions


def texts_of(spark, form, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.out for r in form(df, "text", "out").orderBy("id").collect()]


def plain_canonical(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, dict):
        return {k: plain_canonical(v) for k, v in sorted(value.items())}
    return [plain_canonical(v) for v in value] if isinstance(value, list) else value


def some_document(r, depth):
    if depth and r.random() < 0.7:
        if r.random() < 0.5:
            return {r.choice(["a", "B", "é", "k 1", "￮", "😀", 'q"']): some_document(r, depth - 1) for _ in range(r.randint(0, 4))}
        return [some_document(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, "", " ", "x\n", "ü/", 0, -3, 12345678901234567, 2.0, 0.5, -0.125, 1234.5678, 3e-5, 1e15])


def test_canonical_documents_are_those_of_a_plain_writer(spark):
    r = random.Random(4)
    values = [some_document(r, 5) for _ in range(60)]
    want = [json.dumps(plain_canonical(v), ensure_ascii=False, separators=(",", ":")) for v in values]
    assert texts_of(spark, documents.with_canonical, [json.dumps(v) for v in values]) == want


@pytest.mark.parametrize("depth", [3, 12])
def test_compaction_at_any_depth(spark, depth):
    """Twelve levels are rebuilt as rows, three in one expression, both alike."""
    deep = lambda inner: '{"a":[' * (depth // 2) + inner + "]}" * (depth // 2)
    texts = ['{"a": " ", "b": {"c": [null, {"d": ""}]}, "e": [0, false, 2.0, [], "é"]}', "{broken", deep('{"x":null}'), deep("[1.0,null]"), None, '[" "," "]', '{"a":1e999,"b":NaN}', '{"a":1e999,"b":1}', '{"a":"\\ud800"}', "3.0"]
    want = ['{"e":[0,false,2,"é"]}', None, "{}", deep("[1]"), None, "[]", None, '{"b":1}', '{"a":"?"}', "3"]
    assert texts_of(spark, documents.with_compact, texts) == want


def test_canonical_edge_cases(spark):
    texts = ["", None, "null", '{"a":1,"a":2}', "[" * 12 + "2.50" + "]" * 12, '{"n":12345678901234567890.0,"m":1e999}', "}{"]
    want = [None, None, "null", None, "[" * 12 + "2.5" + "]" * 12, '{"m":null,"n":12345678901234567890}', None]
    assert texts_of(spark, documents.with_canonical, texts) == want


def test_numbers_alike_in_value_hash_alike(spark):
    row = spark.range(1).select(
        ids.stable_hash(a=F.lit(2.0), b=F.lit(None).cast("int")).alias("x"), ids.stable_hash(b=F.lit(None).cast("double"), a=F.lit(2)).alias("y"),
        ids.canonical_json(n=F.lit(float("nan")), i=F.lit(float("-inf")), s=F.lit(1 / 3), r=F.array(F.lit(1.0)), raw=F.lit(bytearray(b"xy"))).alias("z"),
    ).first()
    assert row.x == row.y == hashlib.sha256(b'{"a":2,"b":null}').hexdigest()
    assert row.z == '{"i":null,"n":null,"r":[1],"raw":{"byte_size":2,"sha256":"%s"},"s":0.333333}' % hashlib.sha256(b"xy").hexdigest()


def test_guarded_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(k, "open", k * 1.5, None) for k in range(6)], "id int, state string, v double, w string")
    versions.create(rows, path)
    plan = lambda ids: spark.createDataFrame([(k, (9.0, None)) for k in ids], "id int, after struct<v:double,w:string>")
    guard = F.col("now.state") == "open"
    put = lambda ids, at: {r.id: (r.outcome, r.differs) for r in versions.guarded_apply(plan(ids), path, ["id"], ["v", "w"], guard, at).collect()}
    assert put([1, 2], 0) == {1: ("applied", []), 2: ("applied", [])}
    assert spark.read.parquet(f"{path}/version=1").count() == 2  # changed rows alone
    assert put([3], 0) == {3: ("stale_version", [])}
    assert put([3, 77], 1) == {3: ("not_applied", []), 77: ("guard_failed", [])}
    assert versions.newest_version(spark, path) == 1
    # Another writer has claimed the next version and not written it yet.
    assert versions._claim(spark, path, 2) and put([3], 1) == {3: ("stale_version", [])}
    assert {r.id: (r.state, r.v) for r in versions.read_version(spark, path, ["id"]).collect()} == {k: ("open", 9.0 if k in (1, 2) else k * 1.5) for k in range(6)}
    assert {r.id: r.v for r in versions.read_version(spark, path, ["id"], 0).collect()} == {k: k * 1.5 for k in range(6)}
    with pytest.raises(Exception, match="there already"):
        versions.create(rows, path)


def test_rollup_of_nothing_and_of_missing_values(spark):
    schema = "result_bucket string, promotion_lane string, parse_mode string, failure_signature string, parser_version string, schema_version string, pass_name string, pass_version string, total bigint, material bigint, exact bigint, conflicts bigint, raw_action_count bigint, chat_available boolean, map_snapshot_available boolean, settlement_evidence_eligible boolean, provenance map<string,bigint>, field_roots map<string,bigint>"
    empty = rollups.candidate_rollup(spark.createDataFrame([], schema)).first()
    assert (empty.candidate_rows, empty.result_buckets, empty.equation.balanced) == (0, {}, True)
    one = rollups.candidate_rollup(spark.createDataFrame([(None,) * 18, (" b ", "human_verdict_preserved", *[None] * 6, 4, *[None] * 7, {"p": 2}, {})], schema)).first()
    assert (one.result_buckets, one.failure_buckets, one.parser_contracts, one.advanced_stat_coverage.provenance) == ({"": 1, "b": 1}, {}, {"|||": 2}, {"p": 2})
    assert (one.equation.manually_verified, one.equation.resolved_by_parser, one.equation.total, one.advanced_stat_coverage.observations_emitted) == (1, 1, 2, 4)


def test_cursor_sets_against_counters(spark):
    done = lambda job, seq, cursor, n: (job, seq, "artifact_completed", cursor, n)
    rows = [("a", 0, "queued", None, 0), *[done("a", k, f"{k:06d}:x", k) for k in (1, 2, 3)], done("a", 9, "000009:x", 4), done("a", 10, "000009:x", 4), ("b", 0, "queued", None, 0), done("c", 1, " ", 1), done("c", 2, "", 2), done(None, 1, "000001:y", 1)]
    got = {r.job: tuple(r)[1:] for r in corpus.cursor_accounting(spark.createDataFrame(rows, "job string, seq bigint, kind string, cursor string, n bigint"), "job", "seq", "kind", "cursor", "n").collect()}
    assert got["a"] == (4, 1, 4, 2, 5, True)
    assert got["b"] == (0, 0, 0, 0, 0, True)
    assert got["c"][4:] == (0, False)
    ranges = corpus.sequence_ranges(spark.createDataFrame([("j", k) for k in [*range(0, 70_000, 35_000), 1, 1, 65_535, 65_536, 65_537]], "job string, seq bigint"), "job", "seq")
    assert sorted((r["first"], r["last"]) for r in ranges.collect()) == [(0, 1), (35_000, 35_000), (65_535, 65_537)]
