"""Observations and receipts: records that are no records, gates, and ceilings."""

import json

from pyspark.sql import functions as F

from tallyfield.operators import observations


def observed(spark, *texts):
    games = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.try_parse_json("text").alias("record"))
    return {(r.id, r.player_key, r.field): (r.value, r.provenance, r.exact) for r in observations.observe(games, "id", "record").collect()}


def test_the_catalogue_has_each_kind_of_field():
    names = [f.name for f in observations.CATALOGUE]
    assert len(names) == len(set(names))
    assert [sum(n.startswith(p) for n in names) for p in ("settings.", "player.postgame.", "map.")] == [17, 30, 11]


def test_records_that_say_little_or_nothing(spark):
    player = {"name": "  A  b ", "steam_id": 0, "winner": True, "score": 5, "achievements": {"economy": {"score": 1}}}
    got = observed(spark, None, "{broken", "{}", "[1]", json.dumps({"players": [player, 3, None, {"steam_id": " 77 "}], "key_events": {"settings": {"speed": None, "odd": [1.0]}}, "completed": 1}))
    assert {k[0] for k in got} == {0, 1, 2, 3, 4}
    for k in range(4):
        assert got[k, None, "game.completed"] == ("false", "derived_coherent", True)
        assert got[k, None, "settings.speed"] == (None, "absent", True)
        assert not any(key[0] == k and key[1] for key in got)
    assert {key[1] for key in got if key[0] == 4} == {None, "name:a b", "steam:77"}
    assert got[4, None, "settings.odd"] == ("[1]", "direct_header", True)
    assert got[4, "name:a b", "player.winner"] == ("true", "inferred_review_only", False)
    assert got[4, "name:a b", "player.postgame.score"] == got[4, "name:a b", "player.postgame.economy.score"] == (None, "absent", False)


def test_what_a_record_says_of_itself_opens_its_figures(spark):
    player = {"name": "A", "winner": False, "score": 5, "achievements": {"economy": {"score": 0}}}
    flags = [{"postgame_available": True}, {"has_achievements": 1}, {"achievement_player_count": 2}, {"has_scores": "yes"}, {"player_score_count": 0}]
    got = observed(spark, *[json.dumps({"players": [player], "key_events": f, "result_resolution": {"result_trusted": k == 4}}) for k, f in enumerate(flags)])
    figures = [(got[k, "name:a", "player.postgame.economy.score"][0], got[k, "name:a", "player.postgame.score"][0], got[k, "name:a", "player.winner"][1]) for k in range(5)]
    inferred = "inferred_review_only"
    assert figures == [("0", "5", "direct_postgame"), ("0", None, inferred), ("0", None, inferred), (None, "5", inferred), (None, None, "derived_coherent")]


def test_receipts_are_never_over_the_ceiling(spark):
    parts = [("a", "activity"), ("b", "activity"), ("e", "evidence"), ("s", "summary")]
    sizes = [(0, 0, 0, 0), (100, 10, 10, 10), (150, 100, 10, 10), (1, 1, 300, 10), (1, 1, 1, 400), (9, 9, 9, None)]
    rows = [(k, "é" * (400 if k == 4 else 3), *[None if n is None else json.dumps("ü" * (n // 2)) for n in s]) for k, s in enumerate(sizes)]
    rows = spark.createDataFrame([(r[0], r[1], *[x.encode().decode("unicode_escape") if x else x for x in r[2:]]) for r in rows], "id int, name string, a string, b string, e string, s string")
    got = {r.id: r for r in observations.receipts(rows, ["id", "name"], parts, 320).collect()}
    assert all(r.receipt_bytes <= 320 and r.receipt_bytes == len(r.receipt.encode()) and json.loads(r.receipt) for r in got.values())
    assert [got[k].truncated_stages for k in range(6)] == [[], [], ["activity"], ["activity", "evidence"], ["activity", "evidence", "summary"], []]
    assert json.loads(got[2].receipt)["a"] is None and json.loads(got[2].receipt)["truncated_stages"] == ["activity"]
    assert got[1].kept_parts == ["a", "b", "e", "s"] and got[3].kept_parts == ["s"]
    assert set(json.loads(got[4].receipt)) == {"identity_sha256", "truncated_stages"}
