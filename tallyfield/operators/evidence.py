"""Action, chat and map streams to per-player metrics and observations (E-01 to E-19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.ids import canonical_json, stable_hash
from tallyfield.operators.ordering import with_previous, with_running_sum
from tallyfield.operators.rollups import facts, folded

#: Confidence in basis points of a provenance class (S-24); others have none.
CONFIDENCE = {"direct": 10_000, "exact": 10_000, "derived": 9_000}


def as_map(counts: DataFrame, keys: Sequence[str], label: str, n: str, name: str) -> DataFrame:
    """Counts as a map of label to count, by label; labels are few (types, classes)."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, n)))).alias(name))


def action_counts(actions: DataFrame, game: str, kind: str, families: Mapping[str, str] | None = None) -> DataFrame:
    """Actions by type and command family; a type without a family is ``other`` (E-05)."""
    family = F.lit("other")
    for k, v in (families or {}).items():
        family = F.when(F.col(kind) == k, v).otherwise(family)
    return actions.groupBy(game, F.col(kind).alias("type"), family.alias("family")).agg(F.count("*").alias("n"))


def packet_identity(actions: DataFrame, *fields: str) -> DataFrame:
    """``packet_id``: the hash of what makes two packets the same (E-06)."""
    return actions.withColumn("packet_id", stable_hash(**{f: F.col(f) for f in fields}))


def packet_counts(actions: DataFrame, game: str, ordinal: str) -> DataFrame:
    """Each packet's multiplicity, first and last ordinal (E-06)."""
    return actions.groupBy(game, "packet_id").agg(F.count("*").alias("multiplicity"), F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"))


def multiplicity_histogram(packets: DataFrame, game: str) -> DataFrame:
    """Packets by multiplicity, with the rows in excess of one each (E-06)."""
    return packets.groupBy(game, "multiplicity").agg(F.count("*").alias("packets"), F.sum(F.col("multiplicity") - 1).alias("excess"))


def first_occurrences(actions: DataFrame, game: str, ordinal: str) -> DataFrame:
    """The deduplicated lane: each packet's first row (E-13)."""
    return actions.withColumn("_rn", F.row_number().over(Window.partitionBy(game, "packet_id").orderBy(ordinal))).filter(F.col("_rn") == 1).drop("_rn")


def player_activity(actions: DataFrame, player: str, ms: str, ordinal: str, duration_ms: int | None = None) -> DataFrame:
    """Packets, first and last time, active minutes, peak minute, largest gap and rate of each player (E-07, E-14).

    Rows without a player or a time are left out. The rate is rounded half to even and NULL without a duration.
    """
    rows = actions.filter(F.col(player).isNotNull() & F.col(ms).isNotNull())
    rows = with_previous(rows, [player], ms, [ordinal], F.floor(F.col(ms) / 86_400_000), "_before_ms")
    by_minute = (
        rows.withColumn("_gap", F.col(ms) - F.col("_before_ms")).groupBy(player, F.floor(F.col(ms) / 60000).alias("_minute")).agg(F.count("*").alias("_n"), F.min(ms).alias("_first"), F.max(ms).alias("_last"), F.max("_gap").alias("_gap"))
    )
    rate = F.bround(F.sum("_n") / (F.lit(duration_ms) / 60000), 2) if duration_ms else F.lit(None).cast("double")
    return by_minute.groupBy(player).agg(
        F.sum("_n").alias("packets"),
        F.min("_first").alias("first_ms"),
        F.max("_last").alias("last_ms"),
        F.count("*").alias("active_minutes"),
        F.max("_n").alias("peak_per_minute"),
        F.max("_gap").alias("largest_gap_ms"),
        rate.alias("per_minute"),
    )


def activity_lanes(actions: DataFrame, game: str, player: str, ms: str, ordinal: str, kind: str, family: str, duration_ms: int | None = None) -> DataFrame:
    """The activity of each player in two lanes, as sent and with each packet's first row alone, with maps of its kinds (E-07, E-13).

    ``lane, player``, what ``player_activity`` tells, ``action_type_counts, command_family_counts`` (by name) and ``eapm``,
    packets a minute rounded half to even. Orders of the machine's own players are left out, and so are rows without a
    player or a time. ``actions`` has ``packet_id``.
    """
    rows = actions.filter(F.col(player).isNotNull() & F.col(ms).isNotNull() & (F.coalesce(F.col(kind), F.lit("")) != "ai_order"))
    out = None
    for name, lane in (("raw", rows), ("identity_normalized", first_occurrences(rows, game, ordinal))):
        dimensions = {"action_type_counts": F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("unclassified")), "command_family_counts": F.coalesce(F.nullif(F.col(family), F.lit("")), F.lit("other_command"))}
        maps = folded(facts(lane, dimensions, keys=[player]), list(dimensions), [player]).drop("sums")
        rate = F.bround(F.col("packets") / (F.lit(duration_ms) / 60_000)).cast("long") if duration_ms else F.lit(None).cast("long")
        one = player_activity(lane, player, ms, ordinal, duration_ms).join(maps, player).withColumn("eapm", rate).withColumn("lane", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def earliest_per_player(actions: DataFrame, player: Column, ms: str, ordinal: str) -> DataFrame:
    """The semantic lane: each player's earliest row, rows without a time last; rows without a player stay raw (E-08).

    One aggregation: a player's rows are compared where they lie, and no task holds them all.
    """
    rows = actions.withColumn("player_key", player).filter(F.col("player_key").isNotNull())
    first = F.min_by(F.struct(*actions.columns), F.struct(F.col(ms).isNull(), F.col(ms), F.col(ordinal))).alias("_row")
    return rows.groupBy("player_key").agg(first, F.count("*").alias("raw_rows")).select("_row.*", "player_key", "raw_rows")


def timeline(actions: DataFrame, types: Sequence[str], payload: Mapping[str, str], game: str = "game_id") -> DataFrame:
    """Age-up, market or tribute rows with the named payload fields (E-09)."""
    fields = [F.get_json_object("payload", path).alias(name) for name, path in payload.items()]
    return actions.filter(F.col("type").isin(*types)).select(game, "player_number", "timestamp_ms", "type", *fields)


def tile_summary(tiles: DataFrame) -> DataFrame:
    """Tiles, elevations, and a fingerprint that depends on the order of the tiles (E-10).

    Rows of a map line are hashed first and the lines' hashes then, so an array holds one side of a map at most.
    """
    lines = tiles.groupBy("game_id", "y").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("x", "terrain_id", "elevation")))), 256).alias("h"), F.count("*").alias("n"), F.max("elevation").alias("top"))
    return lines.groupBy("game_id").agg(F.sum("n").alias("tiles"), F.max("top").alias("highest"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("y", "h")))), 256).alias("fingerprint"))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    """Counts with a place by descending count, then the keys, NULL keys last (E-10, E-11)."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    # Counts of few kinds; the window is over the histogram, not over the rows.
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *[F.col(c).asc_nulls_last() for c in by])))


def running_clock(ops: DataFrame, game: str, seq: str, increment: str, restore: Column | None = None, width: int = 65_536) -> DataFrame:
    """The clock after each operation: the restored time and all increments so far (E-12).

    A game's operations are split by ``width`` of the sequence, so one long game is many tasks.
    """
    rows = ops.withColumns({"_bucket": F.floor(F.col(seq) / width), "_step": F.coalesce(increment, F.lit(0))})
    out = with_running_sum(rows, [game], [seq], "_step", "_sum")
    return out.withColumn("clock", F.coalesce(restore if restore is not None else F.lit(0), F.lit(0)) + F.col("_sum")).drop("_bucket", "_step", "_sum")


def wide_to_long(df: DataFrame, subject: Column, catalogue: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """One observation for each field of the catalogue: ``subject, field, value, provenance, exact`` (E-16).

    A missing value is an observation too, of provenance ``absent``; a recorded 0 stays.
    """
    entries = [
        F.struct(F.lit(k).alias("field"), v.cast("string").alias("value"), F.when(v.isNull(), "absent").otherwise(p).alias("provenance"), (v.isNotNull() & F.lit(p == "direct")).alias("exact"))
        for k, (v, p) in sorted(catalogue.items())
    ]
    return df.select(subject.alias("subject"), F.inline(F.array(*entries)))


def material(observations: DataFrame, critical: str = "result.") -> DataFrame:
    """Without absent ones, but for conflicts in result fields; with confidence and key (E-15, E-17)."""
    conflict = F.coalesce("conflict_state", F.lit("none")) != "none"
    kept = observations.filter((F.col("provenance") != "absent") | (F.col("field").startswith(critical) & conflict))
    confidence = F.lit(None).cast("int")
    for k, v in CONFIDENCE.items():
        confidence = F.when(F.col("provenance") == k, v).otherwise(confidence)
    return kept.withColumn("confidence_bps", confidence).withColumn("observation_hash", F.sha2(canonical_json(subject=F.col("subject"), field=F.col("field"), value=F.col("value")), 256))


def zero_filled(roster: DataFrame, counts: DataFrame, keys: Sequence[str], available: Column) -> DataFrame:
    """Counts of every roster row, 0 only where the action lane is known to be there, else NULL (E-18)."""
    return roster.join(counts, list(keys), "left").withColumn("n", F.when(available, F.coalesce("n", F.lit(0))))


def envelope(runs: DataFrame, fields: Sequence[str], most_bytes: int = 32 * 1024) -> DataFrame:
    """Canonical JSON of the fields, its hash, and a receipt that drops the payload beyond the size ceiling (E-19)."""
    body = canonical_json(**{f: F.col(f) for f in fields})
    out = runs.withColumn("envelope", body).withColumn("semantic_hash", F.sha2("envelope", 256)).withColumn("bytes", F.octet_length("envelope"))
    small = F.col("bytes") <= most_bytes
    return out.withColumn("receipt", F.when(small, F.col("envelope")).otherwise(F.to_json(F.struct("semantic_hash", "bytes", F.lit(True).alias("truncated")))))


def observation_profile(observations: DataFrame, run: str) -> DataFrame:
    """Total, material, exact and conflicting observations of each run, with maps by provenance and root of the field (C-26).

    An observation is two rows, one a map; its numbers ride on the first, so a run takes no rows beyond those of its maps.
    """
    number = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    sums = {"total": F.lit(1).cast("long"), "material": number(F.col("provenance") != "absent"), "exact": number(F.col("exact")), "conflicts": number(F.coalesce("conflict_state", F.lit("none")) != "none")}
    maps = {"provenances": F.col("provenance"), "field_roots": F.substring_index("field", ".", 1)}
    entries = F.array(*[F.struct(F.lit(k == "provenances").alias("_first"), v.cast("string").alias("_value")) for k, v in maps.items()])
    rows = observations.select(run, *[v.alias(k) for k, v in sums.items()], F.inline(entries))
    counted = rows.groupBy(run, "_first", "_value").agg(F.count("*").alias("_n"), *[F.sum(F.when(F.col("_first"), F.col(c))).alias(c) for c in sums])
    of = lambda first: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("_first") == F.lit(first)) & F.col("_value").isNotNull(), F.struct("_value", "_n")))))
    return counted.groupBy(run).agg(*[F.sum(c).alias(c) for c in sums], of(True).alias("provenances"), of(False).alias("field_roots"))


def chat_preview(chat: DataFrame, game: str, ordinal: str, message: str, last: int = 5, bucket: Column | None = None) -> DataFrame:
    """Numbered transcript rows and whether each is in the preview of the last few; blank lines go (S-21).

    ``bucket`` must not fall as ``ordinal`` grows; it splits a long transcript over tasks.
    """
    rows = chat.withColumn("message", F.trim(F.regexp_replace(message, r"\s+", " "))).filter(F.col("message") != "")
    rows = rows.withColumns({"_bucket": F.lit(0) if bucket is None else bucket, "_one": F.lit(1)})
    lines = with_running_sum(rows, [game], [ordinal], "_one", "line").drop("_bucket", "_one")
    totals = rows.groupBy(F.col(game).alias("_game")).agg(F.count("*").alias("_lines"))
    found = lines.join(totals, lines[game].eqNullSafe(totals["_game"]), "left")
    return found.withColumn("in_preview", F.col("_lines") - F.col("line") < last).drop("_game", "_lines")


def event_labels(actions: DataFrame, game: str, label: str, ordinal: str) -> DataFrame:
    """Distinct labels in the order first seen (S-23); labels are few."""
    firsts = actions.groupBy(game, label).agg(F.min(ordinal).alias("_o"))
    return firsts.groupBy(game).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(label).alias("l")))), lambda x: x["l"]).alias("labels"))
