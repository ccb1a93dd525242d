"""Rosters in long form (one row a player), teams, and results (R-01 to R-10).

A roster table has ``game_id`` and, as far as an operator needs them, ``position, name, number, steam_id, team_id, winner,
score``. Missing evidence is NULL and is never taken for 0 or false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import clean_text, name_key, player_key, team_id
from tallyfield.sources.shared import saved

PLAYER = (
    "struct<name:string,player_name:string,number:string,player_number:string,steam_id:string,user_id:string,civilization:string,civilization_name:string,"
    "team_id:string,team:string,winner:boolean,score:int,rate_snapshot:int,eapm:double>"
)


def canonical_players(games: DataFrame, players: str = "players_json") -> DataFrame:
    """One row a player from a JSON array, alias keys read in order, nameless players dropped (S-07, S-11).

    ``raw_json`` keeps each player as it came, so fields unknown here survive.
    """
    raw = F.from_json(players, "array<string>")
    rows = games.select("game_id", F.posexplode(F.from_json(players, f"array<{PLAYER}>")).alias("position", "p"), raw.alias("raw"))
    out = rows.select(
        "game_id",
        "position",
        clean_text(F.coalesce("p.name", "p.player_name")).alias("name"),
        F.coalesce("p.number", "p.player_number").try_cast("int").alias("number"),
        clean_text(F.coalesce("p.steam_id", "p.user_id")).alias("steam_id"),
        clean_text(F.coalesce("p.civilization_name", "p.civilization")).alias("civilization"),
        team_id(F.coalesce("p.team_id", "p.team")).alias("team_id"),
        F.col("p.winner").alias("winner"),
        F.col("p.score").alias("score"),
        F.try_element_at("raw", F.col("position") + 1).alias("raw_json"),
    )
    return out.filter(F.col("name").isNotNull())


OUTCOMES = ("n_won", "won_side", "n_lost", "n_any", "single_side", "n_full", "other_side")


def _counters() -> list[Column]:
    """Of a side: its players, and those that won, lost and resigned."""
    return [F.count("*").alias("size"), F.count_if("winner").alias("won"), F.count_if(~F.col("winner")).alias("lost"), F.count_if("resigned").alias("gone")]


def _outcomes(prefix: str) -> list[Column]:
    """Of a game's sides: how many won, lost and resigned as a whole, and the names a result may take."""
    c = F.col
    named = F.when(c("side").isNotNull(), c("side"))
    all_won, any_won, full = c("won") == c("size"), c("won") > 0, c("gone") == c("size")
    found = (
        F.count_if(all_won),
        F.max(F.when(all_won, named)),
        F.count_if(c("lost") == c("size")),
        F.count_if(any_won),
        F.max(F.when(any_won & (c("lost") == 0), named)),
        F.count_if(full),
        F.max(F.when(~full, named)),
    )
    return [column.alias(prefix + name) for name, column in zip(OUTCOMES, found, strict=True)]


def resolve_teams(players: DataFrame, games: DataFrame, allow_uneven: bool = False, final: bool = False) -> DataFrame:
    """Teams and result of each game (R-03 to R-05, R-07 with ``allow_uneven``).

    ``players``: ``game_id, name, steam_id, team_id, winner, resigned``; ``games``: ``game_id, postgame, scoreboard``.
    Players are dealt by game once; all that follows stays where they are. They are put together by key and by team, and
    both by game; no task holds more than counters of a game. In a duel the keys are the sides, else the teams.
    """
    c = F.col
    keyed = players.select("game_id", player_key(c("steam_id"), c("name")).alias("key"), team_id(c("team_id")).alias("team"), "winner", "resigned").repartition("game_id")
    by_key = keyed.groupBy("game_id", c("key").alias("side")).agg(*_counters(), F.count_if(c("team").isNull()).alias("missing"))
    roster = by_key.groupBy("game_id").agg(F.sum("size").alias("player_count"), F.count("*").alias("keys"), F.sum("missing").alias("missing"), *_outcomes("key_"))
    named = F.when(c("side").isNotNull(), c("side"))
    order = F.struct(F.coalesce(c("side").try_cast("long"), F.lit(2**62)), "side")
    sides = (
        keyed.groupBy("game_id", c("team").alias("side"))
        .agg(*_counters())
        .groupBy("game_id")
        .agg(
            F.count(named).alias("n_teams"),
            F.min("size").alias("least"),
            F.max("size").alias("most"),
            F.min_by("size", order).alias("first_size"),
            F.max_by("size", order).alias("last_size"),
            *_outcomes("team_"),
        )
    )
    duplicate = c("player_count") != F.coalesce("keys", F.lit(0))
    g = games.select("game_id", "postgame", "scoreboard").join(roster, "game_id", "left").join(sides, "game_id", "left").withColumn("player_count", F.coalesce("player_count", F.lit(0)))
    duel = (c("player_count") == 2) & ~duplicate
    g = g.withColumns({name: F.when(duel, c(f"key_{name}")).otherwise(c(f"team_{name}")) for name in OUTCOMES})
    standard = c("player_count").isin(4, 6, 8)
    small, unsupported, no_team = c("player_count") < 2, ~standard & F.lit(not allow_uneven), c("missing") > 0
    two = (c("player_count") == 2) & ~duplicate
    grouped = ~two & ~small & ~unsupported & ~no_team
    wrong_count = grouped & (c("n_teams") != 2)
    uneven = grouped & F.lit(not allow_uneven) & ((c("least") != c("player_count") / 2) | (c("most") != c("player_count") / 2))
    count_code = F.when(F.lit(allow_uneven) & ~standard, "unsupported_team_format").otherwise("expected_exactly_two_teams")
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(duplicate, "duplicate_player_identity"),
                F.when(small, "roster_incomplete"),
                F.when(~two & ~small & unsupported, "unsupported_team_format"),
                F.when(~two & ~small & ~unsupported & no_team, "team_id_missing"),
                F.when(wrong_count, count_code),
                F.when(uneven, "unequal_team_sizes"),
            )
        )
    )
    g = g.withColumn("reasons", reasons)
    resolved = two | (grouped & (F.size("reasons") == 0))
    status = (
        F.when(resolved, "resolved")
        .when(small, "incomplete")
        .when(F.array_contains("reasons", "unsupported_team_format"), "unsupported")
        .when(no_team, "incomplete")
        .otherwise("conflicting")
    )
    g = g.withColumn("resolved", resolved).withColumn("status", status)
    flags = F.when((c("n_won") == 1) & (c("n_lost") == 1), c("won_side"))
    single = F.when(flags.isNull() & (c("n_any") == 1), c("single_side"))
    g = g.withColumn("flag_team", F.when(c("resolved"), flags)).withColumn("single_team", F.when(c("resolved"), single))
    evidence = F.coalesce("flag_team", "single_team")
    derived = F.when(c("resolved") & (c("n_full") == 1), c("other_side"))
    conflict = F.coalesce(derived.isNotNull() & evidence.isNotNull() & (derived != evidence), F.lit(False)) | (c("resolved") & (c("n_full") > 1))
    post, board = F.coalesce("postgame", F.lit(False)), F.coalesce("scoreboard", F.lit(False))
    winner = F.when(conflict, None).when(derived.isNotNull(), derived).when(post | board, evidence)
    kind = F.when(c("flag_team").isNotNull(), "winner_flags").otherwise("single_team_winner_flags")
    provenance = (
        F.when(conflict, "conflicting_result_evidence")
        .when(derived.isNotNull(), "complete_losing_team_resignation")
        .when(post & evidence.isNotNull(), F.concat(F.lit("postgame_"), kind))
        .when(board & evidence.isNotNull(), F.concat(F.lit("scoreboard_"), kind))
        .when(c("flag_team").isNotNull(), "coherent_player_winner_flags_review")
        .when(c("single_team").isNotNull(), "single_team_player_winner_flags_review")
        .otherwise("insufficient_result_evidence")
    )
    size = lambda n: c(n).cast("string")
    return g.select(
        "game_id",
        "player_count",
        "status",
        F.when(two, "1v1").when(c("resolved"), F.concat(size("first_size"), F.lit("v"), size("last_size"))).otherwise("unknown").alias("format"),
        F.when(two, "one_vs_one_roster").when(c("resolved"), F.lit("explicit_final_team_ids" if final else "explicit_replay_team_ids")).otherwise("unresolved").alias("provenance"),
        F.array_join("reasons", ",").alias("reason_codes"),
        "flag_team",
        "single_team",
        F.when(c("resolved") & (c("n_full") == 1), "exactly_one_complete_team").when(c("resolved") & (c("n_full") > 1), "multiple_complete_teams").otherwise("no_complete_team").alias("resignation_state"),
        winner.alias("winning_team"),
        F.when(winner.isNotNull(), "resolved").otherwise("review_required").alias("result_status"),
        provenance.alias("result_provenance"),
        winner.isNotNull().alias("result_trusted"),
    )


def apply_result(players: DataFrame, results: DataFrame) -> DataFrame:
    """Roster rows with ``is_winner`` from a trusted result: NULL where the result is not trusted (R-06)."""
    own = F.coalesce(team_id(F.col("team_id")), player_key(F.col("steam_id"), F.col("name")))
    won = results.filter("result_trusted").select("game_id", "winning_team")
    duel = player_key(F.col("steam_id"), F.col("name"))
    return players.join(won, "game_id", "left").withColumn("is_winner", F.when(F.col("winning_team").isNotNull(), (own == F.col("winning_team")) | (duel == F.col("winning_team")))).drop("winning_team")


def apply_contract(games: DataFrame, players: DataFrame, results: DataFrame) -> DataFrame:
    """Games with completion as the result allows it, and the winners of a trusted result (R-06).

    ``games``: ``game_id, completed, completion_source, parse_reason``; ``players`` as for ``apply_result``; ``results`` from
    ``resolve_teams``. A resignation completes a game only if exactly one whole team resigned; else the game is not completed
    and goes to review, with the raw flag kept. Winners are gathered for trusted results alone, whose rosters are of a known
    format; without one both arrays are empty.
    """
    # Kept, as the winners' branch would resolve all teams again.
    results = saved(results.select("game_id", "resignation_state", "winning_team", "result_status", "result_provenance", "result_trusted"))
    won = apply_result(players, results).filter("is_winner")
    key = player_key(F.col("steam_id"), F.col("name"))
    winners = won.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), clean_text(F.col("name")).alias("name")))).alias("_w"))
    c = F.col
    rows = games.join(results.select("game_id", "resignation_state", "winning_team", "result_status", "result_provenance"), "game_id", "left").join(winners, "game_id", "left")
    resigned = F.coalesce(c("completion_source") == "resignation", F.lit(False))
    proven = F.coalesce(c("resignation_state") == "exactly_one_complete_team", F.lit(False))
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "raw_completed": F.when(resigned, F.coalesce("completed", F.lit(False))),
            "resignation_proves_completion": F.when(resigned, proven),
            "completed": F.when(resigned & ~proven, F.lit(False)).otherwise(c("completed")),
            "completion_source": F.when(resigned & proven, "complete_team_resignation").when(resigned, "team_resignation_review_required").otherwise(c("completion_source")),
            "parse_reason": F.when(resigned & ~proven, "team_resignation_not_complete").otherwise(c("parse_reason")),
            "winner_keys": F.coalesce(F.transform("_w", lambda w: w["key"]), none),
            "winner_names": F.coalesce(F.transform("_w", lambda w: w["name"]), none),
        }
    ).drop("_w", "resignation_state")


def recover_team_ids(target: DataFrame, source: DataFrame) -> DataFrame:
    """Team ids of a second roster where the whole game agrees, else the target's own (R-01).

    Guards, per game: equal sizes of 4, 6 or 8, unique names, all names covered, all source teams known, no disagreement.
    """
    t = target.withColumn("_name", name_key(F.col("name"))).withColumn("_own", team_id(F.col("team_id")))
    s = source.select("game_id", name_key(F.col("name")).alias("_name"), team_id(F.col("team_id")).alias("_other")).groupBy("game_id", "_name").agg(F.max("_other").alias("_other"), F.count("*").alias("_times"))
    sizes = source.groupBy("game_id").agg(F.count("*").alias("_source_size"))
    joined = t.join(s, ["game_id", "_name"], "left")
    agrees = F.coalesce(F.col("_own").isNull() | (F.col("_own") == F.col("_other")), F.lit(False))
    guard = (
        joined.groupBy("game_id")
        .agg(F.count("*").alias("_n"), F.min(F.coalesce(F.col("_other").isNotNull() & (F.col("_times") == 1) & agrees, F.lit(False))).alias("_all"))
        .join(sizes, "game_id")
        .join(t.groupBy("game_id", "_name").agg(F.count("*").alias("_k")).groupBy("game_id").agg(F.max("_k").alias("_k")), "game_id")
        .select("game_id", (F.col("_all") & (F.col("_n") == F.col("_source_size")) & F.col("_n").isin(4, 6, 8) & (F.col("_k") == 1)).alias("recovered"))
    )
    out = joined.join(guard, "game_id", "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    return out.withColumn("team_id", F.when(F.col("recovered"), F.col("_other")).otherwise(F.col("_own"))).drop("_name", "_own", "_other", "_times")


def alliance_groups(relations: DataFrame, players: DataFrame) -> DataFrame:
    """Groups of mutual allies that partition each roster, with a label (R-08).

    ``relations``: ``game_id, player, peer, relation``. A player's group is itself and all mutual allies; the roster is
    partitioned if all members of every group have the same group. A group is at most a roster, eight players.
    """
    ally = relations.filter(F.col("relation") == "ally").select("game_id", "player", "peer")
    mutual = ally.join(ally.select("game_id", F.col("peer").alias("player"), F.col("player").alias("peer")), ["game_id", "player", "peer"], "left_semi")
    own = players.select("game_id", "player", F.col("player").alias("peer")).union(mutual)
    groups = own.groupBy("game_id", "player").agg(F.array_sort(F.collect_set("peer")).alias("group"))
    by_group = groups.groupBy("game_id", "group").agg(F.count("*").alias("n"))
    closed = F.col("n") == F.size("group")
    per_game = by_group.groupBy("game_id").agg(F.min(closed).alias("partitioned"), F.count("*").alias("groups"), F.sum("n").alias("players"), F.max("n").alias("largest"))
    label = (
        F.when(~F.col("partitioned"), "Other")
        .when((F.col("groups") == 2) & (F.col("players") == 2), "1v1")
        .when((F.col("groups") == 2) & (F.col("largest") > 1), "TG")
        .when((F.col("groups") > 2) & (F.col("largest") == 1), "FFA")
        .otherwise("Other")
    )
    return per_game.select("game_id", "partitioned", "groups", "players", label.alias("label"))


def roster_counters(players: DataFrame) -> DataFrame:
    """Players with scores, with meaningful achievements and with non-empty achievement shells (R-02)."""
    return players.groupBy("game_id").agg(
        F.count_if(F.col("score") > 0).alias("player_score_count"), F.count_if(F.col("achievement_total") > 0).alias("achievement_player_count"), F.count_if(F.col("achievement_total").isNotNull()).alias("achievement_shell_count")
    )


def completion_source(postgame: Column, has_scores: Column, has_achievements: Column, completed: Column, has_resignations: Column) -> Column:
    """Postgame, scoreboard, resignation, completion signal, else NULL (R-09)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(postgame), "postgame")
        .when(yes(has_scores) | yes(has_achievements), "scoreboard")
        .when(yes(completed) & yes(has_resignations), "resignation")
        .when(yes(completed), "completion_signal")
    )


def early_exit(duration: Column, last_chat: Column, rated: Column, resigned: Column, disconnected: Column, winner: Column) -> Column:
    """Struct ``duration, winner, early_exit, duration_source`` of a game shorter than a minute (R-10).

    Chat a minute or more into the game overrides the duration; else a rated game with a resignation or a disconnect has no
    winner. Other games stay as they are.
    """
    short = F.coalesce((duration > 0) & (duration < 60), F.lit(False))
    chat = short & F.coalesce(last_chat >= 60, F.lit(False))
    gone = short & ~chat & F.coalesce(rated, F.lit(False)) & (F.coalesce(resigned, F.lit(False)) | F.coalesce(disconnected, F.lit(False)))
    return F.struct(
        F.when(chat, F.greatest(duration, last_chat)).otherwise(duration).alias("duration"),
        F.when(gone, F.lit("Unknown")).otherwise(winner).alias("winner"),
        gone.alias("early_exit"),
        F.when(chat, F.lit("chat_preview_seconds_override")).alias("duration_source"),
    )
