"""A match record as observations, one a field, by a catalogue; and receipts of bounded size (E-16, E-19)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.documents import canonical_variant, is_set
from tallyfield.functions.text import clean_text

# Fixed values.
HEADER, ACTION, POSTGAME, DERIVED, INFERRED, ABSENT = "direct_header", "direct_action", "direct_postgame", "derived_coherent", "inferred_review_only", "absent"
SETTINGS = (
    "all_technologies", "cheats", "difficulty", "ending_age", "hidden_civs", "lock_speed", "lock_teams", "map_reveal_choice", "multiqueue",
    "population_limit", "speed", "starting_age", "starting_resources", "team_together", "treaty_length", "type", "victory_condition",
)
HEADER_FIELDS = ("platform_id", "platform_match_id", "rated", "lobby_name", "restored")
MAP_FIELDS = ("id", "name", "size", "dimension", "seed", "custom", "zr", "tile_count", "tile_sha256", "terrain_histogram", "elevation_histogram")
PLAYER_FIELDS = ("name", "number", "steam_id", "civilization", "civilization_name", "color_id", "team_id", "position", "human", "steam_rm_rating", "steam_dm_rating", "rate_snapshot")
POSTGAME_FIELDS = {
    "military": ("score", "units_killed", "hit_points_killed", "units_lost", "buildings_razed", "hit_points_razed", "buildings_lost", "units_converted"),
    "economy": ("score", "food_collected", "wood_collected", "stone_collected", "gold_collected", "tribute_sent", "tribute_received", "trade_gold", "relic_gold"),
    "technology": ("score", "feudal_time", "castle_time", "imperial_time", "explored_percent", "research_count", "research_percent"),
    "society": ("score", "total_wonders", "total_castles", "total_relics", "villager_high"),
}


class Field(NamedTuple):
    """A field of the catalogue: the path within its subject and how its provenance is told (see ``_told``)."""

    name: str
    subject: str
    path: str
    rule: str = "header"


#: What a record may hold, in the order of the subjects: the game with its map and settings, players, teams, actions.
CATALOGUE = (
    Field("game.version", "game", "$.game_version", "always_header"),
    Field("game.type", "game", "$.game_type", "always_header"),
    Field("game.duration_seconds", "game", "$.duration", "always_derived"),
    Field("game.completed", "game", "$.completed", "completed"),
    *(Field(f"game.{x}", "game", f"$.key_events.{x}") for x in HEADER_FIELDS),
    *(Field(f"map.{x}", "game", f"$.map_snapshot.{x}") for x in MAP_FIELDS),
    *(Field(f"settings.{x}", "game", f"$.key_events.settings.{x}") for x in SETTINGS),
    Field("teams.resolution", "game", "$.team_resolution", "always_derived"),
    Field("result.trusted", "game", "$.team_resolution.result_trusted", "flag"),
    Field("result.winning_team_id", "game", "$.team_resolution.winning_team_id", "result"),
    Field("result.winning_player_keys", "game", "$.team_resolution.winning_player_keys", "result"),
    Field("actions.raw_count", "game", "$.actions.count", "action"),
    Field("actions.unique_packet_identity_count", "game", "$.actions.unique_action_identity_count", "action_derived"),
    Field("actions.exact_duplicate_packet_excess", "game", "$.actions.exact_duplicate_packet_excess", "action_derived"),
    Field("actions.type_counts", "game", "$.actions.type_counts", "action"),
    Field("actions.raw_activity_by_player", "game", "$.actions.raw_activity_by_player", "action_rough"),
    Field("actions.identity_normalized_activity_by_player", "game", "$.actions.identity_normalized_activity_by_player", "action_inferred"),
    *(Field(f"player.{x}", "player", f"$.{x}") for x in PLAYER_FIELDS),
    Field("player.recorded_eapm", "player", "$.eapm", "rough"),
    Field("player.winner", "player", "$.winner", "winner"),
    *(Field(f"player.postgame.{group}.{x}", "player", f"$.achievements.{group}.{x}", "achievement") for group, fields in POSTGAME_FIELDS.items() for x in fields),
    Field("player.postgame.score", "player", "$.score", "score"),
)


def _flag(record: Column, path: str) -> Column:
    return is_set(F.try_variant_get(record, path, "variant"))


def _told(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Value, provenance and exactness of rows of ``field, rule, v`` (a VARIANT), given what the record says of itself."""
    text = rows.withColumn("_text", canonical_variant(F.col("v"), 2)).withColumn("_value", F.when(F.col("_text") != "null", F.col("_text")))
    value, rule = F.col("_value"), F.col("rule")
    there, yes, no = value.isNotNull(), F.lit(True), F.lit(False)
    gate = {k: F.col(f"_is_{k}") for k in ("postgame", "achievements", "scores", "trusted", "player_trusted", "actions")}
    or_absent = lambda p: F.when(there, p).otherwise(ABSENT)
    of_gate = lambda g, p: F.when(g, p).otherwise(ABSENT)
    review = F.when(gate["trusted"], DERIVED).when(there & ~value.isin("[]", '""', "{}"), INFERRED).otherwise(ABSENT)
    won = F.when(~there, ABSENT).when(gate["postgame"], POSTGAME).when(gate["player_trusted"], DERIVED).otherwise(INFERRED)
    after = {k: gate[k] & there for k in ("achievements", "scores")}
    #: Rule: value, provenance, exact.
    rules = {
        "header": (value, or_absent(HEADER), yes),
        "always_header": (value, F.lit(HEADER), yes),
        "always_derived": (value, F.lit(DERIVED), yes),
        "completed": (F.coalesce((value == "true").cast("string"), F.lit("false")), F.when(gate["postgame"], POSTGAME).otherwise(DERIVED), yes),
        "flag": (gate["trusted"].cast("string"), F.lit(DERIVED), yes),
        "result": (value, review, gate["trusted"]),
        "action": (F.when(gate["actions"], value), of_gate(gate["actions"], ACTION), gate["actions"]),
        "action_derived": (F.when(gate["actions"], value), of_gate(gate["actions"], DERIVED), gate["actions"]),
        "action_rough": (F.when(gate["actions"], value), of_gate(gate["actions"], DERIVED), no),
        "action_inferred": (F.when(gate["actions"], value), of_gate(gate["actions"], INFERRED), no),
        "rough": (value, or_absent(DERIVED), no),
        "winner": (value, won, there & (gate["postgame"] | gate["player_trusted"])),
        "achievement": (F.when(gate["achievements"], value), of_gate(after["achievements"], POSTGAME), after["achievements"]),
        "score": (F.when(gate["scores"], value), of_gate(after["scores"], POSTGAME), after["scores"]),
    }

    def by_rule(at: int) -> Column:
        out = F.lit(None)
        for name, told in rules.items():
            out = F.when(rule == name, told[at]).otherwise(out)
        return out

    return text.select(*kept, "field", by_rule(0).alias("value"), by_rule(1).alias("provenance"), F.coalesce(by_rule(2), no).alias("exact"), F.lit("none").alias("conflict_state"))


def _entries(subject: str, record: Column, catalogue: Sequence[Field]) -> Column:
    """The fields of a subject with their rules and what the record has at their paths."""
    own = [f for f in catalogue if f.subject == subject]
    return F.inline(F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.rule).alias("rule"), F.try_variant_get(record, f.path, "variant").alias("v")) for f in own]))


def observe(games: DataFrame, ident: str, record: str, catalogue: Sequence[Field] = CATALOGUE) -> DataFrame:
    """All observations of each record: ``ident, subject, player_key, player_number, field, value, provenance, exact, conflict_state``.

    ``record`` is a VARIANT. A field that is missing is an observation too, of provenance ``absent``; values are canonical
    JSON. Figures after the game count only if the record says that it has them, and a winner that no evidence bears out
    is for review only. What stands among the settings beyond the catalogue is observed as well. Players are told by
    their account, else by their folded name. A record that is no JSON gives the game's fields, all of them absent or false.
    """
    r = F.col("_r")
    get = lambda path: F.try_variant_get(r, path, "variant")
    count = lambda path: F.coalesce(F.try_variant_get(r, path, "double"), F.lit(0.0)) != 0
    postgame = _flag(r, "$.key_events.postgame_available")
    gates = {
        "postgame": postgame,
        "achievements": postgame | _flag(r, "$.key_events.has_achievements") | count("$.key_events.achievement_player_count"),
        "scores": postgame | _flag(r, "$.key_events.has_scores") | count("$.key_events.player_score_count"),
        "trusted": _flag(r, "$.team_resolution.result_trusted"),
        "player_trusted": _flag(r, "$.result_resolution.result_trusted"),
        "actions": _flag(r, "$.actions") & (F.coalesce(F.to_json(get("$.actions.available")), F.lit("true")) != "false"),
    }
    rows = games.select(ident, F.col(record).alias("_r"))
    told = rows.select(ident, "_r", *[g.alias(f"_is_{k}") for k, g in gates.items()])
    gated = [f"_is_{k}" for k in gates]
    nobody = [F.lit("game").alias("subject"), F.lit(None).cast("string").alias("player_key"), F.lit(None).cast("int").alias("player_number")]
    game = told.select(ident, *nobody, *gated, _entries("game", r, catalogue))
    held = get("$.key_events.settings").try_cast("map<string,variant>")
    others = F.filter(F.map_entries(held), lambda e: ~e["key"].isin(*SETTINGS))
    further = told.select(ident, *nobody, *gated, F.explode(others).alias("_e")).select(ident, "subject", "player_key", "player_number", *gated, F.concat(F.lit("settings."), "_e.key").alias("field"), F.lit("header").alias("rule"), F.col("_e.value").alias("v"))
    players = told.select("*", F.explode(get("$.players").try_cast("array<variant>")).alias("_p")).filter(F.col("_p").try_cast("map<string,variant>").isNotNull())
    p = F.col("_p")
    account = clean_text(F.when(_flag(p, "$.steam_id"), F.try_variant_get(p, "$.steam_id", "string")))
    key = F.coalesce(F.concat(F.lit("steam:"), account), F.concat(F.lit("name:"), F.lower(F.coalesce(clean_text(F.try_variant_get(p, "$.name", "string")), F.lit("")))))
    of_player = players.select(ident, F.lit("player").alias("subject"), key.alias("player_key"), F.try_variant_get(p, "$.number", "int").alias("player_number"), *gated, _entries("player", p, catalogue))
    return _told(game.union(further).union(of_player), [ident, "subject", "player_key", "player_number"])


#: What a receipt gives up when it is too large, in this order.
STAGES = ("activity", "evidence", "summary")
MOST_RECEIPT_BYTES = 32 * 1024


def receipts(rows: DataFrame, identity: Sequence[str], parts: Sequence[tuple[str, str]], most_bytes: int = MOST_RECEIPT_BYTES, order: Sequence[str] = STAGES) -> DataFrame:
    """``receipt``, ``receipt_bytes``, ``truncated_stages`` and ``kept_parts`` for each row: never over the ceiling (E-19).

    ``identity`` columns always stay; ``parts`` are pairs of column (canonical JSON text) and the stage of ``order`` at which
    it goes. The parts are laid out from the one that goes last to the one that goes first; their encoded lengths are
    summed up in that order, and the receipt keeps the longest run of whole stages whose sum fits. What has gone is null,
    and the stages are named in the receipt. If the identity alone is too large it is left to its hash.
    """
    from tallyfield.functions.ids import canonical_json

    base = canonical_json(**{c: F.col(c) for c in identity})
    stage_of = dict(parts)
    kept_last = [c for s in reversed(order) for c, stage in parts if stage == s]
    listed = F.array(*[F.struct(F.lit(order.index(stage_of[c])).alias("stage"), F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit("null")).alias("text")) for c in kept_last])
    rows = rows.withColumn("_base", base).withColumn("_parts", listed)
    entry = lambda x: F.octet_length(x["name"]) + F.octet_length(x["text"]) + F.lit(4)  # noqa: E731  two quotes, a colon and a comma
    # A part that has gone is still there as null, and the stages that have gone are named.
    gone = sum(len(c) + 8 for c in kept_last) + len("truncated_stages") + 7 + sum(len(s) + 3 for s in order)
    room = F.lit(most_bytes) - F.octet_length("_base") - F.lit(gone)
    sums = F.aggregate("_parts", F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<stage:int,total:int>>").alias("at")), lambda acc, x: F.struct((acc["total"] + entry(x)).alias("total"), F.array_append(acc["at"], F.struct(x["stage"].alias("stage"), (acc["total"] + entry(x)).cast("int").alias("total"))).alias("at")), lambda acc: acc["at"])
    rows = rows.withColumn("_sums", sums).withColumn("_room", room)
    # Stage k goes, and all before it, if what would stay with it does not fit.
    over = F.filter("_sums", lambda x: x["total"] > F.col("_room"))
    rows = rows.withColumn("_cut", F.coalesce(F.array_max(F.transform(over, lambda x: x["stage"])), F.lit(-1)))
    stages = F.array(*map(F.lit, order))
    rows = rows.withColumn("truncated_stages", F.slice(stages, F.lit(1), F.col("_cut") + 1))
    kept = F.filter("_parts", lambda x: x["stage"] > F.col("_cut"))
    rows = rows.withColumn("kept_parts", F.array_sort(F.transform(kept, lambda x: x["name"])))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('":'))
    written = F.transform("_parts", lambda x: F.concat(quoted(x["name"]), F.when(x["stage"] > F.col("_cut"), x["text"]).otherwise("null")))
    named = F.concat(F.lit('"truncated_stages":['), F.array_join(F.transform("truncated_stages", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ","), F.lit("]"))
    inner = F.expr("substring(_base, 2, length(_base) - 2)")
    receipt = F.concat(F.lit("{"), F.array_join(F.array_compact(F.concat(F.array(F.nullif(inner, F.lit(""))), written, F.array(named))), ","), F.lit("}"))
    bare = F.concat(F.lit('{"identity_sha256":"'), F.sha2("_base", 256), F.lit('",'), named, F.lit("}"))
    rows = rows.withColumn("receipt", F.when(F.octet_length(receipt) <= most_bytes, receipt).otherwise(bare)).withColumn("receipt_bytes", F.octet_length("receipt"))
    return rows.drop("_base", "_parts", "_sums", "_room", "_cut")
