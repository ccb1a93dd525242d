"""Reconciliation of archive, games and runs: inventories, manifests, links, gates, audits (C-01 to C-45)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.functions.ids import stable_hash
from tallyfield.functions.text import failure_category, is_sha256, message_signature, snake_case
from tallyfield.operators.ordering import with_previous, with_running_sum
from tallyfield.operators import rollups
from tallyfield.sources.shared import saved

TRUSTED_PROVENANCE = ("complete_losing_team_resignation", "postgame_winner_flags", "scoreboard_winner_flags")


def archive_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file under the root: hash and suffix of its name, size, whether name and layout are right (C-01).

    The bytes are not read, only paths and lengths.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    sha, suffix = F.regexp_extract(name, r"^([0-9a-f]{64})(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(name, r"^[0-9a-f]{64}(\.[A-Za-z0-9]+)?$", 1)
    layout = F.col("path").endswith(F.concat(F.lit("/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), name))
    valid = sha != ""
    return files.select("path", F.col("length").alias("byte_size"), F.nullif(sha, F.lit("")).alias("sha256"), F.when(valid, F.lower(suffix)).alias("suffix"), valid.alias("valid"), (valid & layout).alias("layout_valid"))


def content_mismatches(spark: SparkSession, root: str) -> DataFrame:
    """Files whose bytes' SHA-256 is not their name's (C-02)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = F.regexp_extract("path", r"([0-9a-f]{64})(?:\.[A-Za-z0-9]+)?$", 1)
    return files.select("path", named.alias("expected"), F.sha2("content", 256).alias("actual")).filter((F.col("expected") != "") & (F.col("expected") != F.col("actual")))


def archive_profile(objects: DataFrame) -> DataFrame:
    """Files, valid ones, bytes, duplicates, invalid names, layout mismatches (C-20).

    With a column ``extension`` also ``extensions``, files by it (``<none>`` for a blank one).
    """
    named = "extension" in objects.columns
    by = [F.coalesce(F.nullif(F.lower(F.trim("extension")), F.lit("")), F.lit("<none>")).alias("_ext")] if named else []
    counts = objects.groupBy("valid", "sha256", *by).agg(F.count("*").alias("n"), F.sum("byte_size").alias("b"), F.count_if(~F.col("layout_valid") & F.col("valid")).alias("off"))
    per = counts.groupBy("valid", "sha256").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("off").alias("off")) if named else counts
    valid = F.col("valid")
    out = per.agg(
        F.sum("n").alias("files"),
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("valid_objects"),
        F.count_if(valid).alias("unique_hashes"),
        F.sum(F.when(valid, F.col("b")).otherwise(0)).alias("bytes"),
        F.count_if(valid & (F.col("n") > 1)).alias("duplicate_hashes"),
        F.sum(F.when(valid, F.col("n") - 1).otherwise(0)).alias("duplicate_objects"),
        F.sum(F.when(valid, F.lit(0)).otherwise(F.col("n"))).alias("invalid_filenames"),
        F.sum("off").alias("layout_mismatches"),
    )
    if not named:
        return out
    # Two tables of one row each.
    return out.withColumn("_one", F.lit(1)).join(_one_map(counts, "_ext", "n", "extensions"), "_one").drop("_one")


def _one_map(counts: DataFrame, label: str, n: str, name: str) -> DataFrame:
    """All counts by label as one map, under a key ``_one``; labels are few (extensions)."""
    sums = counts.groupBy(label).agg(F.sum(n).alias("_n"))
    return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_n")))).alias(name)).withColumn("_one", F.lit(1))


def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") == 1).drop("_rn")


def artifact_manifest(objects: DataFrame, games: DataFrame, attempts: DataFrame, key: str, game_order: Sequence[Column], attempt_order: Sequence[Column]) -> DataFrame:
    """Each artifact with its best game and best attempt, columns prefixed ``game_`` and ``attempt_`` (C-09)."""
    prefixed = lambda df, p: df.select(key, *[F.col(c).alias(p + c) for c in df.columns if c != key])
    g, a = (best_row(df.filter(F.col(key).isNotNull()), [key], *order) for df, order in ((games, game_order), (attempts, attempt_order)))
    return objects.join(prefixed(g, "game_"), key, "left").join(prefixed(a, "attempt_"), key, "left")


def cohort_manifest(games: DataFrame, archive: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """Logical games with archive presence and the number of submissions of their hash (C-10)."""
    n = submissions.groupBy(key).agg(F.count("*").alias("submissions"))
    held = archive.select(key).distinct().withColumn("archive_present", F.lit(True))
    return games.join(held, key, "left").join(n, key, "left").withColumns({"archive_present": F.coalesce("archive_present", F.lit(False)), "submissions": F.coalesce("submissions", F.lit(0))})


def manifest_issues(manifest: DataFrame, archive: DataFrame, extensions: Sequence[str], root: str = "") -> DataFrame:
    """One row for each error or warning of each manifest row: all rows are reported, not the first failure (C-06).

    ``manifest``: ``row_no, replay_hash, archive_relative_path, byte_size, extension, submitter_uid`` and, if it has them,
    ``game_stats_id, legacy_parse_attempt_id, original_filename``; ``archive``: ``sha256, relative_path, byte_size`` and, if it
    has it, ``content_sha256``, the hash of the bytes. A storage key is ``root`` and the path.
    """
    c = F.col
    blank = lambda x: c(x).isNull() | (F.trim(x) == "")
    path = c("archive_relative_path")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    rows = manifest.join(archive.select(F.col("sha256").alias("replay_hash"), F.col("relative_path").alias("_path"), F.col("byte_size").alias("_size"), (F.col("content_sha256") if "content_sha256" in archive.columns else F.lit(None).cast("string")).alias("_content")).dropDuplicates(["replay_hash"]), "replay_hash", "left")
    times = manifest.filter(is_sha256(F.col("replay_hash"))).groupBy("replay_hash").agg(F.count("*").alias("_times"))
    rows = rows.join(times, "replay_hash", "left")
    errors = (
        ("hash_missing", blank("replay_hash")),
        ("hash_invalid", ~blank("replay_hash") & ~is_sha256(c("replay_hash"))),
        ("path_missing", blank("archive_relative_path")),
        ("path_absolute", path.startswith("/")),
        ("path_traversal", path.rlike(r"(^|/)\.\.(/|$)")),
        ("layout_invalid", ~blank("archive_relative_path") & is_sha256(c("replay_hash")) & ~path.startswith(F.concat(F.substring("replay_hash", 1, 2), F.lit("/"), F.substring("replay_hash", 3, 2), F.lit("/")))),
        ("artifact_absent", is_sha256(c("replay_hash")) & c("_path").isNull()),
        ("path_differs", c("_path").isNotNull() & (c("_path") != path)),
        ("size_invalid", c("byte_size").isNull() | (c("byte_size") < 0)),
        ("size_mismatch", c("_size").isNotNull() & (c("_size") != c("byte_size"))),
        ("extension_unsupported", ~F.lower(F.coalesce("extension", F.lit(""))).isin(*extensions)),
        ("uid_too_long", F.length("submitter_uid") > 100),
        ("storage_key_too_long", F.length(path) + len(root) > 1000),
        ("archive_extension_mismatch", ~blank("extension") & (suffix != "") & (F.lower(F.trim("extension")) != suffix)),
        ("archive_hash_mismatch", F.lower("_content") != F.lower("replay_hash")),
    )
    for name in ("game_stats_id", "legacy_parse_attempt_id"):
        if name in manifest.columns:
            text = c(name).cast("string")
            errors += ((f"invalid_{name}", (F.trim(text) != "") & ~F.coalesce(F.trim(text).try_cast("long") > 0, F.lit(False))),)
    if "original_filename" in manifest.columns:
        errors += (("filename_too_long", F.length("original_filename") > 255),)
    warnings = (("duplicate_artifact", c("_times") > 1), ("uid_missing", blank("submitter_uid")))
    entry = lambda level, code, cond: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    issues = F.array_compact(F.array(*[entry("error", *e) for e in errors], *[entry("warning", *w) for w in warnings]))
    return rows.select("row_no", "replay_hash", F.inline(issues))


def manifest_profile(manifest: DataFrame, key: str, size: str, extension: str | None = None, logical: str | None = None) -> DataFrame:
    """Rows, unique artifacts, rows in excess of valid ones, bytes (C-21, C-30).

    ``excess_rows``: rows less the different valid hashes, so rows whose hash is no hash count too. With ``extension`` also
    rows by it as a map, with ``logical`` the rows that repeat a logical key; a row without one has its own.
    """
    per = manifest.groupBy(key).agg(F.count("*").alias("n"), F.max(size).alias("b"))
    valid = F.coalesce(is_sha256(F.col(key)), F.lit(False))
    out = per.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_artifacts"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.sum("b").alias("bytes"), (F.sum("n") - F.count_if(valid)).alias("excess_rows")).withColumn("_one", F.lit(1))
    if extension:
        named = F.coalesce(F.nullif(F.lower(F.trim(extension)), F.lit("")), F.lit("<none>")).alias("_ext")
        out = out.join(_one_map(manifest.groupBy(named).agg(F.count("*").alias("n")), "_ext", "n", "extensions"), "_one")
    if logical:
        keyed = manifest.filter(F.trim(logical) != "").groupBy(logical).agg(F.count("*").alias("n"))
        out = out.join(keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_logical_rows")).withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def manifest_subset(manifest: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the wanted keys; the wanted keys that are absent; those that stand there more than once (C-07)."""
    w = wanted.select(key).distinct()
    rows = manifest.join(w, key, "left_semi")
    return rows, w.join(manifest, key, "left_anti"), rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def ordinals(manifest: DataFrame, line: str, key: str) -> DataFrame:
    """``ordinal``, ``cursor`` (``000001:<hash16>``) and whether the row runs or is a later copy (C-35).

    Lines are numbered within ranges of the line number, and ranges then by their sizes, so no task numbers all rows. In
    which range a line lies is saved before the ranges are counted, so a task that runs again finds it the same.
    """
    ranged = saved(manifest.repartitionByRange(F.col(line)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(line))).join(before, "_p")
    out = numbered.withColumn("ordinal", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")
    out = out.withColumn("cursor", F.format_string("%06d:%s", F.col("ordinal"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16)))
    return out.withColumn("status", F.when(F.row_number().over(Window.partitionBy(key).orderBy("ordinal")) == 1, "run").otherwise("skipped"))


def latest_runs(runs: DataFrame, key: str, completed: str, row_id: str) -> DataFrame:
    """The newest run of each key, a missing time before all others as in the source's order (C-33)."""
    return best_row(runs, [key], F.col(completed).desc_nulls_first(), F.desc(row_id))


def games_with_latest(games: DataFrame, runs: DataFrame, game_key: str, run_key: str, completed: str, row_id: str, keep_missing: bool) -> DataFrame:
    """Games with their newest run: without it they go, or stay with ``missing_current_candidate`` (C-13 to C-15)."""
    latest = latest_runs(runs, run_key, completed, row_id)
    out = games.join(latest, F.col(game_key) == F.col(run_key), "left" if keep_missing else "inner")
    return out.withColumn("missing_current_candidate", F.col(row_id).isNull())


def either_link_counts(df: DataFrame, row_id: Sequence[str], a: str, b: str) -> DataFrame:
    """Rows linked to a target by one or the other column, each counted once (C-16); no join on an OR."""
    return df.select(*row_id, F.explode(F.array_distinct(F.array_compact(F.array(a, b)))).alias("target")).groupBy("target").agg(F.count("*").alias("n"))


def facts(observations: DataFrame, subject: str, field: str, value: str) -> DataFrame:
    """Match id, sorted distinct lower-case names and sorted distinct Steam ids of each subject (C-24).

    A subject is a game, so the sets hold its players.
    """
    f, v = F.col(field), F.col(value)
    return observations.groupBy(subject).agg(
        F.max(F.when(f == "platform_match_id", v)).alias("platform_match_id"),
        F.array_sort(F.collect_set(F.when(f == "player.name", F.lower(v)))).alias("names"),
        F.array_sort(F.collect_set(F.when((f == "player.steam_id") & (v != "0"), v))).alias("steam_ids"),
    )


def continuation_links(saved: DataFrame, recorded: DataFrame) -> DataFrame:
    """Saved and recorded games of one match id, with exact roster comparison (C-11, C-12)."""
    s, r = (df.filter(F.coalesce(F.col("platform_match_id"), F.lit("")) != "").select("platform_match_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "names", "steam_ids")]) for df, p in ((saved, "saved"), (recorded, "recorded")))
    same = lambda c: (F.size(f"saved_{c}") > 0) & (F.col(f"saved_{c}") == F.col(f"recorded_{c}"))
    digest = F.sha2(F.to_json(F.struct(F.col("saved_names").alias("names"), F.col("saved_steam_ids").alias("steam_ids"))), 256)
    return s.join(r, "platform_match_id").select("platform_match_id", "saved_id", "recorded_id", same("names").alias("names_exact"), same("steam_ids").alias("steam_ids_exact"), (same("names") & same("steam_ids")).alias("linked"), digest.alias("roster_hash"))


def link_summary(links: DataFrame, saved_total: Column | int) -> DataFrame:
    """Shared ids, linked saved games, one-to-one and multi-checkpoint ids, greatest fan-in, unlinked (C-25)."""
    per = links.groupBy("platform_match_id").agg(F.countDistinct("saved_id").alias("s"), F.countDistinct("recorded_id").alias("r"))
    return per.agg(
        F.count("*").alias("shared_ids"), F.sum("s").alias("linked_saved"), F.count_if((F.col("s") == 1) & (F.col("r") == 1)).alias("one_to_one"), F.count_if(F.col("s") > 1).alias("multi_checkpoint"), F.max("s").alias("max_fan_in")
    ).withColumn("unlinked_saved", F.lit(saved_total) - F.coalesce("linked_saved", F.lit(0)))


def set_differences(known: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """How many keys are on one side only, each way, and on both (C-36, C-37)."""
    sides = known.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(held.select(key, F.lit(0), F.lit(1)))
    per = sides.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("known_only"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("held_only"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def remaining_work(manifest: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Manifest rows not yet processed (C-39)."""
    return manifest.join(processed.select(key).distinct(), key, "left_anti")


def balanced_rollup(rows: DataFrame, bucket: str) -> DataFrame:
    """Rows by bucket beside the total, and whether the buckets add up to it (C-22, C-27)."""
    total = Window.partitionBy()
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(total)).withColumn("balanced", F.sum("n").over(total) == F.col("total"))


def job_accounting(events: DataFrame, job: str) -> DataFrame:
    """Processed against succeeded, failed and skipped of each job (C-31)."""
    sums = events.groupBy(job).agg(*[F.sum(c).alias(c) for c in ("processed", "succeeded", "failed", "skipped")])
    return sums.withColumn("balanced", F.col("processed") == F.col("succeeded") + F.col("failed") + F.col("skipped"))


def sequence_gaps(events: DataFrame, job: str, seq: str, width: int = 65_536) -> DataFrame:
    """Last sequence number, rows, gaps and whether there is none (C-34).

    A job's events are split by ``width`` of the sequence, so one job is many tasks.
    """
    rows = with_previous(events.select(job, seq), [job], seq, [], F.floor(F.col(seq) / width), "_prev")
    return rows.groupBy(job).agg(F.max(seq).alias("last_sequence"), F.count("*").alias("rows"), F.count_if(F.col(seq) - F.col("_prev") != 1).alias("gaps")).withColumn("gapless", F.col("gaps") == 0)


def sequence_ranges(events: DataFrame, job: str, seq: str, width: int = 65_536) -> DataFrame:
    """``first, last`` of each unbroken run of a job's sequence numbers; numbers that come twice are one (C-34)."""
    rows = with_previous(events.select(job, seq).distinct(), [job], seq, [], F.floor(F.col(seq) / width), "_prev")
    rows = rows.withColumn("_new", F.when(F.col(seq) - F.col("_prev") == 1, 0).otherwise(1))
    runs = with_running_sum(rows, [job], [seq], "_new", "_run")
    return runs.groupBy(job, "_run").agg(F.min(seq).alias("first"), F.max(seq).alias("last")).drop("_run")


def cursor_accounting(events: DataFrame, job: str, seq: str, kind: str, cursor: str, processed: str) -> DataFrame:
    """The set of cursors that a job's completed artifacts name, against the counter of its last event (C-34).

    ``cursors``: different ones, blank ones left out; ``repeated``: completed events beyond the first of a cursor;
    ``processed``: the last event's counter; ``ordinal_ranges`` and ``missing_ordinals``: how the ordinals that cursors
    begin with lie; ``agrees``: as many cursors as processed. Cursors are counted before jobs are, so no task holds a job's.
    """
    done = events.filter((F.col(kind) == "artifact_completed") & (F.coalesce(F.col(cursor), F.lit("")) != ""))
    sets = done.groupBy(job, cursor).agg(F.count("*").alias("_n"))
    counted = sets.groupBy(job).agg(F.count("*").alias("cursors"), F.sum(F.col("_n") - 1).alias("repeated"))
    ordinals_of = sets.select(job, F.regexp_extract(cursor, r"^(\d+):", 1).try_cast("long").alias("_o")).filter(F.col("_o").isNotNull())
    ranges = sequence_ranges(ordinals_of, job, "_o").groupBy(job).agg(F.count("*").alias("ordinal_ranges"), (F.max("last") - F.min("first") + 1 - F.sum(F.col("last") - F.col("first") + 1)).alias("missing_ordinals"))
    last = events.groupBy(job).agg(F.max_by(processed, seq).alias("processed"))
    zero = F.lit(0).cast("long")
    out = last.join(counted, job, "left").join(ranges, job, "left").select(job, *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("cursors", "repeated", "processed", "ordinal_ranges", "missing_ordinals")])
    return out.withColumn("agrees", F.col("cursors") == F.col("processed"))


def failure_triage(failures: DataFrame, message: str, exception: str, io_errors: Sequence[str] = ("OSError", "IOError", "FileNotFoundError", "PermissionError", "TimeoutError"), stage: str | None = None) -> DataFrame:
    """Failures by stage, class of exception, category and redacted message: count, retryable, signature (C-32).

    Equal messages are counted before they are redacted. A blank message is its exception's class. The signature is
    ``stage:category:class:<hash16>``, the hash that of the canonical JSON of these and the message.
    """
    at = F.coalesce(F.col(stage), F.lit("")) if stage else F.lit("parse")
    raw = failures.groupBy(at.alias("stage"), message, exception).agg(F.count("*").alias("_n"))
    said = F.coalesce(message_signature(F.col(message)), F.lower(exception))
    rows = raw.select("stage", snake_case(F.col(exception)).alias("exception_class"), failure_category(F.col(message), F.col(exception).isin(*io_errors)).alias("category"), said.alias("message"), "_n")
    rows = rows.groupBy("stage", "exception_class", "category", "message").agg(F.sum("_n").alias("n"))
    fingerprint = stable_hash(stage=F.col("stage"), category=F.col("category"), exception_class=F.col("exception_class"), normalized_message=F.col("message"))
    signature = F.concat_ws(":", "stage", "category", "exception_class", F.substring(fingerprint, 1, 16))
    return rows.withColumn("retryable", F.col("category").isin("truncated_or_incomplete", "artifact_io")).withColumn("signature", signature)


def job_report(events: DataFrame, runs: DataFrame, games: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Completed artifacts of each job with run, game if any, and the game's newest accepted adjudication that counts (C-17).

    ``events``: ``job_id, sequence, event_type, run_id``; ``runs``: ``run_id, game_id``; ``games``: ``game_id``;
    ``adjudications``: ``adjudication_id, game_id, decision_status, affects_stats, created_at``. A missing time is the newest.
    """
    counted = adjudications.filter((F.col("decision_status") == "accepted") & F.col("affects_stats"))
    newest = best_row(counted, ["game_id"], F.col("created_at").desc_nulls_first(), F.desc("adjudication_id"))
    linked = games.join(newest, "game_id", "left")
    return events.filter(F.col("event_type") == "artifact_completed").join(runs, "run_id").join(linked, "game_id", "left")


def binding_summary(rows: DataFrame, run_hash: str, game_hash: str) -> DataFrame:
    """Runs bound to their game's present bytes, and stale ones (C-28)."""
    bound = F.coalesce(is_sha256(F.col(run_hash)) & (F.lower(run_hash) == F.lower(game_hash)), F.lit(False))
    return rows.agg(F.count_if(bound).alias("current"), F.count_if(~bound).alias("stale"), (F.count_if(~bound) == 0).alias("may_project"))


def linkage(same_hash: Column, attempt_game: Column, game: Column, attempt_status: Column, final: Column) -> Column:
    """``canonical``, ``alternate_perspective`` or NULL for an error (C-19)."""
    reviewed = attempt_status.isin("duplicate_final", "alternate_perspective", "reviewed_match") & final & (attempt_game == game)
    return F.when(same_hash, "canonical").when(F.coalesce(reviewed, F.lit(False)), "alternate_perspective")


def current_result_class(verified: Column, reason: Column, players: Column, team_status: Column, teams: Column, winning_team: Column, winner: Column, winner_in_roster: Column) -> Column:
    """Five labels for what is known of a stored result (C-40)."""
    from tallyfield.operators.games import fold_name, reliable_winner

    coherent = F.coalesce((team_status == "resolved") & (teams == 2) & winning_team.isNotNull(), F.lit(False))
    return (
        F.when(F.coalesce(verified, F.lit(False)), "manually_verified")
        .when(fold_name(reason).contains("unparsed") | (players < 2), "private_review_candidate")
        .when(coherent, "resolved_coherent_team")
        .when((players == 2) & reliable_winner(winner) & F.coalesce(winner_in_roster, F.lit(False)), "resolved_coherent_1v1")
        .when(players > 2, "team_result_revalidation_required")
        .otherwise("private_review_candidate")
    )


def result_bucket(run_status: Column, players: Column, result_status: Column, trusted: Column, winners: Column, team_status: Column) -> Column:
    """Six buckets of a candidate's result (C-41)."""
    resolved = F.coalesce((result_status == "resolved") & (winners > 0), F.lit(False))
    return (
        F.when(run_status == "failed", "unsupported_or_parse_failed")
        .when(players < 2, "private_review_no_roster")
        .when(resolved & F.coalesce(trusted, F.lit(False)), "resolved_trusted_direct_evidence")
        .when(resolved, "resolved_coherent_parser_evidence")
        .when(team_status == "resolved", "private_review_result_not_proven")
        .otherwise("private_review_team_or_result_incomplete")
    )


def promotion_lane(accepted: Column, candidate_keys: Column, current_keys: Column, result_status: Column) -> Column:
    """Five lanes, by comparing sorted winner keys as sets (C-38, C-41)."""
    a, b = (F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in (candidate_keys, current_keys))
    return (
        F.when(F.coalesce(accepted, F.lit(False)), "human_verdict_preserved")
        .when((F.size(a) == 0) | ~F.coalesce(result_status == "resolved", F.lit(False)), "private_review")
        .when(a == b, "matches_current_truth")
        .when(F.size(b) == 0, "candidate_improves_missing_result")
        .otherwise("candidate_conflicts_with_current_truth")
    )


def projection_gates(df: DataFrame) -> DataFrame:
    """Class and reason codes of a candidate result (C-42).

    Columns: ``run_status, accepted, current_winner, candidate_winner, trusted, links, is_final, current_players, players,
    distinct_players, team_status, result_status, provenance, winner_in_roster, completed``.
    """
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(no(c("is_final")), "game_stats_not_final"),
            F.when(c("current_players") >= 2, "effective_roster_not_placeholder"),
            F.when((c("players") < 2) | (c("players") > 8), "candidate_roster_out_of_bounds"),
            F.when(c("distinct_players") != c("players"), "candidate_roster_identity_not_unique"),
            F.when(no(c("team_status") == "resolved"), "candidate_teams_not_resolved"),
            F.when(no((c("result_status") == "resolved") & c("trusted")), "candidate_result_not_trusted"),
            F.when(no(c("provenance").isin(*TRUSTED_PROVENANCE)), "candidate_result_provenance_not_allowlisted"),
            F.when(c("candidate_winner").isNull(), "candidate_winner_keys_missing"),
            F.when(c("candidate_winner").isNotNull() & no(c("winner_in_roster")), "candidate_winners_outside_roster"),
            F.when(no(c("completed")), "candidate_not_completed"),
        )
    )
    df = df.withColumn("_reasons", reasons)
    known = c("current_winner").isNotNull()
    decided = (
        F.when(no(c("run_status").isin("succeeded", "recovered")), F.struct(F.lit("candidate_parse_failed"), F.lit("candidate_run_not_successful")))
        .when(c("accepted") > 0, F.struct(F.lit("manual_adjudication_preserved"), F.lit("accepted_adjudication_present")))
        .when(known & c("current_winner").eqNullSafe(c("candidate_winner")), F.struct(F.lit("matches_effective_truth"), F.lit("winner_keys_already_match")))
        .when(known & (c("candidate_winner").isNull() | no(c("trusted"))), F.struct(F.lit("candidate_lower_confidence"), F.lit("effective_result_already_known")))
        .when(known, F.struct(F.lit("candidate_conflicts_with_effective_truth"), F.lit("winner_keys_conflict")))
        .when(c("links") > 0, F.struct(F.lit("financially_linked_missing_result"), F.concat(F.lit("linked="), c("links").cast("string"))))
        .when(F.size("_reasons") > 0, F.struct(F.lit("private_review"), F.array_join("_reasons", ",")))
        .otherwise(F.struct(F.lit("safe_projection"), F.lit("all_strict_projection_gates_passed")))
    )
    return df.withColumn("_d", decided).withColumn("projection_class", F.col("_d.col1")).withColumn("reason_codes", F.col("_d.col2")).drop("_d", "_reasons")


def projection_records(gated: DataFrame, ident: Sequence[str], before: Column, after: Column, policy: str) -> DataFrame:
    """``before``, ``after`` and ``decision_hash`` of each gated candidate (C-42).

    Only a safe projection changes anything: otherwise ``after`` is ``before``. The hash is that of the canonical JSON of the
    policy, the columns ``ident``, the class, both projections and whether anything financial is linked.
    """
    safe = F.col("projection_class") == "safe_projection"
    rows = gated.withColumn("before", before).withColumn("after", F.when(safe, after).otherwise(F.col("before")))
    impact = F.when(F.coalesce(F.col("links"), F.lit(0)) > 0, "linked_financial_history").otherwise("no_linked_financial_history")
    material = {c: F.col(c) for c in ident} | {"policy_version": F.lit(policy), "classification": F.col("projection_class"), "before_projection": F.col("before"), "after_projection": F.col("after"), "financial_impact_classification": impact}
    return rows.withColumn("decision_hash", stable_hash(**material))


def structure_gates(df: DataFrame) -> DataFrame:
    """Whether roster and teams may be projected without any winner (C-43); the projected row has no winner."""
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(no(c("run_status").isin("succeeded", "recovered")), "candidate_run_not_successful"),
            F.when((c("players") < 2) | (c("players") > 8), "candidate_roster_out_of_bounds"),
            F.when(c("distinct_players") != c("players"), "candidate_roster_identity_not_unique"),
            F.when(c("current_players") >= c("players"), "current_roster_not_smaller"),
            F.when(c("accepted") > 0, "accepted_adjudication_present"),
        )
    )
    return df.withColumn("reason_codes", F.array_join(reasons, ",")).withColumn("structure_ok", F.size(reasons) == 0).withColumn("winner", F.lit(None).cast("string"))


def submitter_assertion(claims: Column) -> Column:
    """Struct ``uid, error`` of several claims: the first that is not blank; any disagreement is an error (C-44)."""
    given = F.filter(claims, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.struct(F.try_element_at(given, F.lit(1)).alias("uid"), F.when(F.size(F.array_distinct(given)) > 1, "submitter_uid_conflict").alias("error"))


def candidate_violations(row: Sequence[str]) -> Column:
    """Codes of a candidate that breaks its contract: missing identity, status not known, not candidate-only (C-45)."""
    missing = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.concat(F.lit("missing_"), F.lit(c))) for c in row]
    return F.array_compact(F.array(*missing, F.when(~F.coalesce(F.col("status").isin("succeeded", "recovered", "failed"), F.lit(False)), "status_unknown"), F.when(~F.coalesce(F.col("candidate_only"), F.lit(False)), "not_candidate_only")))


def snapshot_slice(manifest: DataFrame, extension: str, start: int, limit: int, order: str) -> DataFrame:
    """A page of the manifest's rows of one extension, in the manifest's order (C-08)."""
    return manifest.filter(F.lower("extension") == extension.lower()).orderBy(order).offset(start).limit(limit)


def snapshot_audit(snapshots: DataFrame, histograms: Sequence[str] = ()) -> DataFrame:
    """Outcome of a snapshot audit: ok, failed, bytes, least and greatest restore time, and maps of counts (C-29).

    ``histograms`` (columns such as player count, version, game type) count the snapshots that were restored, each as a map
    named ``<column>_counts``; a missing value is not counted.
    """
    ok = F.col("failure").isNull()
    one = snapshots.agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("bytes"))).alias("bytes"), F.min(F.when(ok, F.col("restore_ms"))).alias("least_ms"), F.max(F.when(ok, F.col("restore_ms"))).alias("greatest_ms")
    )
    if not histograms:
        return one
    maps = rollups.folded(rollups.facts(snapshots.filter(ok), {f"{c}_counts": F.col(c) for c in histograms}), [f"{c}_counts" for c in histograms]).drop("sums")
    # Two tables of one row each.
    return one.withColumn("_one", F.lit(1)).join(maps.withColumn("_one", F.lit(1)), "_one").drop("_one")


def corpus_summary(latest: DataFrame, saved_prefix: str) -> DataFrame:
    """Latest candidates, saved and recorded ones, saved ones with a match id, distinct match ids among them (C-23)."""
    saved = F.col("parse_mode").startswith(saved_prefix)
    named = saved & (F.coalesce("platform_match_id", F.lit("")) != "")
    return latest.agg(
        F.count("*").alias("candidates"), F.count_if(saved).alias("saved"), F.count_if(~saved).alias("recorded"), F.count_if(named).alias("saved_with_id"), F.countDistinct(F.when(named, F.col("platform_match_id"))).alias("distinct_ids")
    )


def reference_issues(manifest: DataFrame, games: DataFrame, attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Codes of manifest rows whose game, attempt or user is missing, or whose hashes and links disagree (C-18).

    ``manifest``: ``row_no, replay_hash, game_id, attempt_id, uid``; ``games``: ``game_id, game_hash``; ``attempts``:
    ``attempt_id, attempt_hash, attempt_game``; ``users``: ``uid``.
    """
    c = F.col
    rows = manifest.join(games.withColumn("_g", F.lit(True)), "game_id", "left").join(attempts.withColumn("_a", F.lit(True)), "attempt_id", "left").join(users.select("uid").distinct().withColumn("_u", F.lit(True)), "uid", "left")
    codes = (
        ("game_missing", c("game_id").isNotNull() & c("_g").isNull()),
        ("attempt_missing", c("attempt_id").isNotNull() & c("_a").isNull()),
        ("user_missing", c("uid").isNotNull() & c("_u").isNull()),
        ("game_hash_differs", c("_g") & (c("game_hash") != c("replay_hash"))),
        ("attempt_hash_differs", c("_a") & (c("attempt_hash") != c("replay_hash"))),
        ("attempt_game_differs", c("_a") & c("game_id").isNotNull() & (c("attempt_game") != c("game_id"))),
    )
    return rows.select("row_no", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in codes]))).alias("code"))
