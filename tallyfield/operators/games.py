"""Match rows: keep-one rules, cohorts, feeds, supersession, merges, repairs (G-01 to G-30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.documents import is_set, meaningful
from tallyfield.functions.text import clean_text, is_sha256, ms_to_seconds, name_key, whole_int
from tallyfield.operators.ordering import with_max_before

# Scalar winners that name nobody.
NON_RESULTS = ("", "draw", "none", "null", "pending", "unknown", "unresolved")
#: Extension, role and final flag of an upload (S-19).
FINAL_SUFFIXES, SNAPSHOT_SUFFIXES = (".aoe2record", ".aoe2mpgame", ".mgz", ".mgx", ".mgl"), (".msx", ".msx2", ".aoe2spgame")


def _first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") == 1).drop("_rn")


def fold_name(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))


def logical_key(replay_file: Column, original: Column, row_id: Column) -> Column:
    """``replay:<name>`` of the first name that is not blank, else ``row:<id>`` (S-17)."""
    name = F.coalesce(F.nullif(fold_name(replay_file), F.lit("")), F.nullif(fold_name(original), F.lit("")))
    return F.coalesce(F.concat(F.lit("replay:"), name), F.concat(F.lit("row:"), row_id.cast("string")))


def reliable_winner(winner: Column) -> Column:
    return ~fold_name(winner).isin(*NON_RESULTS)


def finals(games: DataFrame) -> DataFrame:
    """G-03."""
    return games.filter("is_final")


def game_counts(games: DataFrame) -> DataFrame:
    """G-12."""
    return games.agg(F.count("*").alias("total"), F.count_if("is_final").alias("final"))


def identity(platform_id: Column, replay_hash: Column, row_id: Column) -> Column:
    """Platform match id, else content hash, else the row itself."""
    part = lambda tag, c: F.concat(F.lit(tag), F.nullif(F.trim(c.cast("string")), F.lit("")))
    return F.coalesce(part("match:", platform_id), part("hash:", replay_hash), part("row:", row_id))


def feed_keep_first(games: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """One row of each identity: latest time, a missing time before all others, then the greatest id (G-13)."""
    return _first_by(games, [key], F.col(ts).desc_nulls_first(), F.col(row_id).desc())


def feed_order(games: DataFrame, played: str, parsed: str, row_id: str, limit: int) -> DataFrame:
    """Public order: newest first, missing times last; at most ``limit`` of 5000 rows (G-19)."""
    return games.orderBy(F.col(played).desc_nulls_last(), F.col(parsed).desc_nulls_last(), F.col(row_id).desc()).limit(max(1, min(limit, 5000)))


def preferred_score(reason: Column, is_final: Column, source: Column, winner: Column) -> Column:
    """Points of the preference rule (G-14)."""
    r = fold_name(reason)
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        points(r == "superseded_by_later_upload", -100_000)
        + points(F.coalesce(is_final, F.lit(False)), 10_000)
        + points(fold_name(source) == "watcher_final", 2_000)
        + points(reliable_winner(winner), 1_000)
        + points(r.contains("final"), 250)
        + points(r.contains("resignation"), 150)
    )


def preferred_first(games: DataFrame, key: str, score: str, recency: str, row_id: str) -> DataFrame:
    """All rows with ``place`` by score, recency and id within their key (G-14, G-16)."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.col(recency).desc_nulls_last(), F.desc(row_id))
    return games.withColumn("place", F.row_number().over(order)).withColumn("rows_of_key", F.count("*").over(Window.partitionBy(key)))


def freeze_cohort(games: DataFrame, user: Column, anchor_id: Column | int, key: str, score: str, recency: str, row_id: str) -> DataFrame:
    """A user's final rows up to an anchor id, the preferred one of each logical key (G-15).

    For many users at once the key holds the user, and the anchor is a column.
    """
    rows = games.filter(user & F.col("is_final") & (F.col(row_id) <= anchor_id))
    return preferred_first(rows, key, score, recency, row_id).filter(F.col("place") == 1)


def platform_dedupe(games: DataFrame, key: str, created: str, row_id: str, keep: str = "oldest") -> DataFrame:
    """Finals of one platform id: the oldest or newest stays final, the others are demoted with a reason (G-17, G-18)."""
    order = [F.col(created).asc_nulls_last(), F.col(row_id).asc()] if keep == "oldest" else [F.col(created).desc_nulls_last(), F.col(row_id).desc()]
    eligible = F.col("is_final") & F.col(key).isNotNull()
    # Rows that take no part are each a group of their own, so that they don't gather under a missing id.
    place = F.row_number().over(Window.partitionBy(F.when(eligible, F.col(key)), F.when(~F.coalesce(eligible, F.lit(False)), F.col(row_id))).orderBy(*order))
    demoted = eligible & (place > 1)
    return games.withColumn("demoted", demoted).withColumn("is_final", F.col("is_final") & ~F.col("demoted")).withColumn("change_reason", F.when(F.col("demoted"), F.lit("duplicate_platform_match")))


def supersede(games: DataFrame, keys: Sequence[str], replay_hash: str, created: str, row_id: str) -> DataFrame:
    """Earlier finals of the same user and file (G-23).

    ``action``: NULL for the latest and for live rows; ``mark`` where a live row of that hash exists, so that (hash, final)
    stays unique; else ``demote``.
    """
    place = F.row_number().over(Window.partitionBy(*keys, F.when(~F.col("is_final"), F.col(row_id))).orderBy(F.col(created).desc_nulls_last(), F.desc(row_id)))
    live = games.filter(~F.col("is_final")).select(F.col(replay_hash).alias("_live")).filter(F.col("_live").isNotNull()).distinct()
    ranked = games.withColumn("_old", F.col("is_final") & (place > 1)).join(live, F.col(replay_hash) == F.col("_live"), "left")
    return ranked.withColumn("action", F.when(F.col("_old"), F.when(F.col("_live").isNotNull(), "mark").otherwise("demote"))).drop("_old", "_live")


def ingest_matches(incoming: DataFrame, existing: DataFrame, final: bool = True) -> DataFrame:
    """New match rows with defaults; in final mode without those whose hash or platform id is already final (G-02)."""
    rows = incoming.withColumn("parse_source", F.coalesce("parse_source", F.lit("json_parse"))).withColumn("duration", F.coalesce("duration", "game_duration"))
    if not final:
        return rows
    done = existing.filter("is_final")
    other = done.filter(F.col("platform_match_id").isNotNull()).select("platform_match_id").distinct()
    return rows.join(done.select("replay_hash").distinct(), "replay_hash", "left_anti").join(other, "platform_match_id", "left_anti")


def online_users(users: DataFrame, now: Column, minutes: int = 2) -> DataFrame:
    """G-04: seen within the last minutes."""
    return users.filter(F.col("last_seen") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def newest_users(users: DataFrame, created: str, uid: str, k: int) -> DataFrame:
    """G-04: a top-k report."""
    return users.orderBy(F.col(created).desc_nulls_last(), uid).limit(k)


def find_users(users: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Users whose name is in a batch of names, in any case (G-06)."""
    wanted = names.select(name_key(F.col("name")).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    return users.withColumn("_key", name_key(F.col(name))).join(wanted, "_key", "left_semi").drop("_key")


def repair_json(col: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, also of JSON text within a JSON string; the default where it can't be read (G-05, X-09)."""
    inner = F.coalesce(F.when(F.trim(col).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")), col)
    looks = F.coalesce(F.trim(inner).rlike(r"^\{[\s\S]*\}$"), F.lit(False))
    return F.coalesce(F.when(looks, F.from_json(inner, schema)), default)


def last_seen_upsert(users: DataFrame, pings: DataFrame) -> DataFrame:
    """Users with the later of their own and the pings' last time (G-30)."""
    latest = pings.groupBy("uid").agg(F.max("ts").alias("_ts"))
    return users.join(latest, "uid", "left").withColumn("last_seen", F.greatest("last_seen", "_ts")).drop("_ts")


def merge_players(existing: DataFrame, parsed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Full outer merge by game and folded name: meaningful parsed values win, unmatched parsed players are added (G-09)."""
    key = name_key(F.col("name"))
    a = existing.select("game_id", key.alias("name_key"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    b = parsed.select("game_id", key.alias("name_key"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    meaningful = lambda f: F.when(~F.coalesce(F.trim(F.col(f).cast("string")).isin("", "unknown"), F.lit(False)), F.col(f))
    return a.join(b, ["game_id", "name_key"], "full_outer").select("game_id", "name_key", *[F.coalesce(meaningful(f"_new_{f}"), F.col(f"_old_{f}")).alias(f) for f in fields])


def backfill_rating(players: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings by name; only known ones are taken over; ``changed`` flags rows that differ (G-10)."""
    r = ratings.select(name_key(F.col("name")).alias("_k"), F.col("rating").alias("_r"))
    out = players.withColumn("_k", name_key(F.col("name"))).join(r, "_k", "left").withColumn("_new", F.coalesce("_r", "rating"))
    return out.withColumn("changed", ~F.col("_new").eqNullSafe(F.col("rating"))).withColumn("rating", F.col("_new")).drop("_k", "_r", "_new")


def match_uploader(players: DataFrame, uploads: DataFrame) -> DataFrame:
    """The player of each upload: by Steam id, else by any of three names, the first in the roster's order (G-08, G-11)."""
    u = uploads.select("game_id", F.col("steam_id").alias("_steam"), F.array(*[name_key(F.col(c)) for c in ("in_game_name", "persona_name", "given_name")]).alias("_names"))
    hit = players.join(u, "game_id").withColumn("_how", F.when(F.col("steam_id") == F.col("_steam"), 0).when(F.array_contains("_names", name_key(F.col("name"))), 1)).filter(F.col("_how").isNotNull())
    return hit.groupBy("game_id").agg(F.min_by(F.struct("name", "steam_id", "position"), F.struct("_how", "position", "steam_id")).alias("player")).select("game_id", "player.*")


def verify_users(users: DataFrame, rosters: DataFrame) -> DataFrame:
    """Users whose claimed name stands in a roster: verified, level 2, spelled as in the newest one unless locked (G-11)."""
    seen = rosters.select(name_key(F.col("name")).alias("_k"), "name", "played_at").groupBy("_k").agg(F.max_by("name", F.struct("played_at", "name")).alias("_spelling"))
    out = users.withColumn("_k", name_key(F.col("in_game_name"))).join(seen, "_k", "left")
    found = F.col("_spelling").isNotNull()
    return (
        out.withColumn("verified", F.coalesce("verified", F.lit(False)) | found)
        .withColumn("verification_level", F.when(found, F.greatest(F.coalesce("verification_level", F.lit(0)), F.lit(2))).otherwise(F.col("verification_level")))
        .withColumn("in_game_name", F.when(found & ~F.coalesce("lock_name", F.lit(False)), F.col("_spelling")).otherwise(F.col("in_game_name")))
        .drop("_k", "_spelling")
    )


def unparsed_finals(games: DataFrame) -> DataFrame:
    """G-07: the newest unparsed final of each hash."""
    return _first_by(games.filter(F.col("is_final") & fold_name(F.col("parse_reason")).contains("unparsed")), ["replay_hash"], F.desc("id"))


def placeholder_lives(games: DataFrame) -> DataFrame:
    """G-07: the newest live row without a roster of each hash."""
    return _first_by(games.filter(~F.col("is_final") & (F.coalesce("player_count", F.lit(0)) < 2)), ["replay_hash"], F.desc("id"))


def repair_duration(duration: Column, raw_ms: Column, already: Column) -> Column:
    """Seconds from a duration stored in ms, unless it is already normalised (G-20)."""
    looks_ms = F.coalesce(duration >= 60_000, F.lit(False)) | duration.eqNullSafe(raw_ms)
    return F.when(F.coalesce(already, F.lit(False)) | ~looks_ms, duration).otherwise(ms_to_seconds(duration))


def upload_violations(claimed_size: Column, size: Column, claimed_sha: Column, sha: Column) -> Column:
    """Codes of an upload's failed integrity checks (G-27)."""
    claimed = F.lower(F.trim(claimed_sha))
    return F.array_compact(
        F.array(
            F.when(claimed_size.isNotNull() & (claimed_size != size), "size_mismatch"),
            F.when(claimed_sha.isNotNull() & ~is_sha256(claimed_sha), "claimed_sha_invalid"),
            F.when(is_sha256(claimed_sha) & (claimed != F.lower(sha)), "sha256_mismatch"),
        )
    )


def file_role(suffix: Column, requested: Column, final: Column) -> Column:
    """Struct ``role, effective_final, rejected, error`` of an upload (S-19)."""
    s, want = F.lower(suffix), F.lower(F.trim(requested))
    snapshot, record = s.isin(*SNAPSHOT_SUFFIXES), s.isin(*FINAL_SUFFIXES)
    is_final = F.coalesce(final, F.lit(False))
    return F.struct(
        F.when(snapshot, "saved_game_snapshot").when(record, F.when(is_final, "final_replay").otherwise("live_replay")).alias("role"),
        (record & is_final & ~F.coalesce(want == "saved_game_snapshot", F.lit(False))).alias("effective_final"),
        (snapshot & is_final).alias("rejected"),
        F.when(~snapshot & ~record, "unsupported_extension").when(snapshot & F.coalesce(want.isin("final_replay", "live_replay"), F.lit(False)), "role_conflicts_with_extension").alias("error"),
    )


def upload_defaults(source: Column, reason: Column, is_final: Column) -> Column:
    """Struct ``source, reason``: given values, else by the final flag (S-20)."""
    given = clean_text(source)
    return F.struct(
        F.coalesce(given, F.when(F.coalesce(is_final, F.lit(False)), "watcher_final").otherwise("watcher_live")).alias("source"),
        F.coalesce(clean_text(reason), F.when(F.coalesce(is_final, F.lit(False)), "final_upload").otherwise("live_upload")).alias("reason"),
    )


def header_flag(col: Column, default: bool) -> Column:
    """``1, true, yes, on`` and ``0, false, no, off``; other text is the default (S-18)."""
    v = F.lower(F.trim(col))
    return F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def positive_int(col: Column) -> Column:
    n = whole_int(col)
    return F.when(n > 0, n)


def attempt_log(outcomes: DataFrame) -> DataFrame:
    """Rows of the append-only attempt log: one for each upload outcome (G-29)."""
    return outcomes.select("upload_id", "uid", "replay_hash", clean_text(F.col("status")).alias("status"), F.substring(F.coalesce(clean_text(F.col("detail")), F.lit("")), 1, 500).alias("detail"), "created_at")


def finality(row: Column) -> Column:
    """Record of what a stored row may be used for (G-24): resolved, trusted, eligibility, completeness."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    resolved, trusted, final = yes(row["resolved"]), yes(row["trusted"]), yes(row["is_final"])
    return F.struct(
        (final & resolved).alias("result_resolved"),
        (final & resolved & trusted).alias("betting_eligible"),
        (final & resolved & ~yes(row["early_exit"])).alias("stats_eligible"),
        F.when(~final, "live").when(resolved & trusted, "complete").when(resolved, "provisional").otherwise("incomplete").alias("completeness"),
        (final & ~resolved).alias("retry_useful"),
    )


def statistics_available(record: Column, players: Column) -> Column:
    """Struct ``available, complete`` of a match record (VARIANT) with ``players`` players (G-25).

    Complete: two players or more, figures after the game are said to be there, and achievements or scores of as many
    players. Available: the record says so, or counts any, or a player has a score or an achievement where the record
    vouches for such, or the stream of actions is there and counted.
    """
    number = lambda path: F.greatest(F.coalesce(F.floor(F.try_variant_get(record, path, "double")), F.lit(0)), F.lit(0))
    flag = lambda path: is_set(F.try_variant_get(record, path, "variant"))
    achievements, scores = number("$.key_events.achievement_player_count"), number("$.key_events.player_score_count")
    postgame = flag("$.key_events.postgame_available")
    by_score, by_achievement = postgame | flag("$.key_events.has_scores") | (scores > 0), postgame | flag("$.key_events.has_achievements") | (achievements > 0)
    each = F.try_variant_get(record, "$.players", "variant").try_cast("array<variant>")
    has = lambda p, path: meaningful(F.try_variant_get(p, path, "variant"))
    own = F.coalesce(F.exists(each, lambda p: (by_score & has(p, "$.score")) | (by_achievement & has(p, "$.achievements"))), F.lit(False))
    engine = "$.key_events.parser_engine"
    counted = F.try_variant_get(record, f"{engine}.raw_action_count", "variant")
    a_number = F.coalesce(F.schema_of_variant(counted).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
    stream = (F.coalesce(F.to_json(F.try_variant_get(record, f"{engine}.action_stream_available", "variant")), F.lit("")) == "true") & a_number & F.coalesce(counted.try_cast("double") >= 0, F.lit(False))
    said = flag("$.statistics_complete") | flag("$.statistics_available")
    complete = (F.coalesce(players, F.lit(0)) >= 2) & (postgame | flag("$.key_events.has_achievements")) & (F.greatest(achievements, scores) >= players)
    return F.struct((said | (achievements > 0) | (scores > 0) | own | stream).alias("available"), F.coalesce(complete, F.lit(False)).alias("complete"))


def best_standing(uploads: DataFrame) -> DataFrame:
    """The one row of each match that stands: final before live, trusted before not, the larger, the later (X-05)."""
    return _first_by(uploads, ["match_id"], F.col("is_final").desc_nulls_last(), F.col("trusted").desc_nulls_last(), F.col("size").desc_nulls_last(), F.col("upload_id").desc())


def reupload_fold(uploads: DataFrame, key: str, order: str, bucket: Column | None = None) -> DataFrame:
    """The row that stands after each upload, in order, has been held against the one before (G-22).

    A trusted row is never replaced by an untrusted one; a trusted one replaces an untrusted; of two untrusted the strictly
    larger artifact wins, of two trusted the later. So the last trusted row stands, else the first of the greatest size, and
    rows were taken as often as there are trusted ones and, before the first of them, strict running maxima of the size.
    ``uploads`` has ``order, upload_id, trusted, size``; a missing order comes last, a missing size is less than any.
    ``bucket`` must not fall as ``order`` grows; it splits the history of a key that holds many rows.
    """
    size = F.col("size").cast("double")
    rows = uploads.select(
        key,
        "upload_id",
        F.coalesce("trusted", F.lit(False)).alias("trusted"),
        size.alias("size"),
        F.when(size.isNull() | F.isnan(size), float("-inf")).otherwise(size).alias("_size"),
        F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), "upload_id").alias("_place"),
        F.struct(F.col(order).isNull().alias("last"), (F.lit(0) if bucket is None else bucket).alias("of")).alias("_bucket"),
    )
    row = F.struct("upload_id", "size")
    trusted = F.when(F.col("trusted"), F.col("_place"))
    largest = F.min_by(row, F.struct(-F.col("_size"), F.col("_place")))
    standing = rows.groupBy(key).agg(F.min(trusted).alias("_first"), F.count_if("trusted").alias("_trusted"), F.max_by(row, trusted).alias("_last"), largest.alias("_largest"))
    first = standing.select(F.col(key).alias("_key"), "_first")
    opening = rows.join(first, rows[key].eqNullSafe(first["_key"])).filter(F.col("_first").isNull() | (F.col("_place") < F.col("_first")))
    raised = with_max_before(opening, [key], [F.col("_place")], "_size", "_before").filter(F.col("_before").isNull() | (F.col("_size") > F.col("_before")))
    taken = raised.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_taken"))
    kept = F.when(F.col("_trusted") > 0, F.col("_last")).otherwise(F.col("_largest"))
    return standing.join(taken, standing[key].eqNullSafe(taken["_key"]), "left").select(
        key, kept["upload_id"].alias("upload_id"), (F.col("_trusted") > 0).alias("trusted"), kept["size"].alias("size"), (F.col("_trusted") + F.coalesce("_taken", F.lit(0)) - 1).alias("replaced")
    )


def repair_early_exit(duration: Column, reason: Column, last_chat: Column) -> Column:
    """Struct ``duration, reason, repaired``: a game marked as an early exit whose chat goes on for a minute or more (G-21)."""
    wrong = F.coalesce((reason == "hd_early_exit_under_60s") & (last_chat >= 60), F.lit(False))
    return F.struct(F.when(wrong, F.greatest(duration, last_chat)).otherwise(duration).alias("duration"), F.when(wrong, None).otherwise(reason).alias("reason"), wrong.alias("repaired"))


def infer_opponent_winner(winner: Column, players: Column, rated: Column, completed: Column, uploader: Column, opponent: Column, enabled: bool = False) -> Column:
    """The opponent of an uploader whose rated duel did not complete; off unless asked for (G-21)."""
    open_duel = fold_name(winner).isin("", "unknown") & (players == 2) & rated & ~completed & uploader.isNotNull()
    return F.when(F.lit(enabled) & F.coalesce(open_duel, F.lit(False)), opponent).otherwise(winner)


def live_disconnect(is_final: Column, disconnected: Column, completed: Column) -> Column:
    """A live row counts as disconnected only once it is completed (G-26)."""
    return F.when(is_final | F.coalesce(completed, F.lit(False)), disconnected).otherwise(False)


def unparsed_final_rows(uploads: DataFrame) -> DataFrame:
    """Proof rows of finals that could not be parsed: no result, the uploader as the only player if known (G-26)."""
    name = clean_text(F.col("claimed_name"))
    return uploads.select(
        "upload_id",
        F.lit("Unknown").alias("winner"),
        F.lit(0).alias("duration"),
        F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")).alias("player_names"),
        F.lit("watcher_final_unparsed").alias("parse_reason"),
        F.substring(F.coalesce(clean_text(F.col("failure")), F.lit("")), 1, 500).alias("failure"),
    )


def upload_metadata(limits: dict[str, int], numbers: Sequence[str] = ()) -> Column:
    """JSON of an upload's headers: cleaned and cut to their limits, positive numbers, blanks left out (G-28)."""
    texts = [F.substring(clean_text(F.col(c)), 1, n).alias(c) for c, n in sorted(limits.items())]
    return F.to_json(F.struct(*texts, *[positive_int(F.col(c)).alias(c) for c in numbers]))


def map_payload(given: Column, payload: Column) -> Column:
    """A map's name or size: the given one unless ``Unknown``, then the payload's (G-28)."""
    return F.when(given == "Unknown", F.coalesce(payload, F.lit("Unknown"))).otherwise(given)


def game_format(version: Column) -> Column:
    """``aoe2_hd``, ``aoe2_de``, ``legacy_aoc`` or NULL (S-22)."""
    v = F.lower(F.coalesce(version, F.lit("")))
    return F.when(v.contains("version.hd") | (v == "hd"), "aoe2_hd").when(v.contains("version.de") | (v == "de"), "aoe2_de").when(v != "", "legacy_aoc")


def whole_position(x: Column, y: Column) -> Column:
    """Both coordinates rounded half to even, NULL if one is missing (S-22)."""
    return F.when(x.isNotNull() & y.isNotNull(), F.array(F.bround(x).cast("int"), F.bround(y).cast("int")))
