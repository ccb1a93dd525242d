"""Counters of many dimensions as one record of maps (C-27, and what C-20, C-26, C-29, C-30 and E-07 count)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import clean_text

CONTRACT = ("parser_version", "schema_version", "pass_name", "pass_version")
_FACTS = "array<struct<kind:string,value:string,n:bigint>>"


def _fact(kind: str, value: Column, n: Column | int = 1) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(n) if isinstance(n, int) else F.coalesce(n, F.lit(0))).cast("long").alias("n"))


def facts(rows: DataFrame, dimensions: Mapping[str, Column], sums: Mapping[str, Column] | None = None, maps: Mapping[str, Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, kind, value, n``: rows of each value of each dimension, ``sums`` by name, and the entries of ``maps`` added up.

    A missing value is not counted; give a dimension another to count it under. One pass and one shuffle of what a task
    has added up, however many dimensions there are.
    """
    single = [_fact(k, v) for k, v in dimensions.items()] + [_fact("sums", F.lit(k), v) for k, v in (sums or {}).items()] + [_fact("sums", F.lit("rows"))]
    every = F.concat(F.array(*single).cast(_FACTS), *[_entries(k, m) for k, m in (maps or {}).items()])
    found = rows.select(*keys, F.explode(every).alias("_f")).select(*keys, "_f.*").filter(F.col("value").isNotNull())
    return found.groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"))


def _entries(kind: str, m: Column) -> Column:
    pairs = F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:bigint>>"))
    return F.transform(pairs, lambda e: _fact(kind, e["key"], e["value"])).cast(_FACTS)


def folded(counted: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A record of maps from value to count for each kind, by value, and ``sums``; a kind without values is an empty map."""

    def of(kind: str) -> Column:
        own = F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n")))
        return F.map_from_entries(F.array_sort(own)).alias(kind)

    return counted.groupBy(*keys).agg(*[of(k) for k in (*kinds, "sums")])


def candidate_rollup(rows: DataFrame) -> DataFrame:
    """One record of all candidates: counts by bucket, lane, parse mode, failure and parser contract, the balance, coverage.

    ``rows``: ``result_bucket, promotion_lane, parse_mode, failure_signature``, the columns of CONTRACT, the numbers
    ``total, material, exact, conflicts, raw_action_count``, the flags ``chat_available, map_snapshot_available,
    settlement_evidence_eligible`` and the maps ``provenance, field_roots``. The balance counts a candidate once: verified
    by hand, else for private review, unsupported or resolved, and holds these against all rows.
    """
    c, text = F.col, lambda name: F.coalesce(clean_text(F.col(name).cast("string")), F.lit(""))
    share = (
        F.when(text("promotion_lane") == "human_verdict_preserved", "manually_verified")
        .when(text("result_bucket").startswith("private_review"), "private_review_candidates")
        .when(text("result_bucket") == "unsupported_or_parse_failed", "unsupported_or_corrupt")
        .otherwise("resolved_by_parser")
    )
    dimensions = {
        "result_buckets": text("result_bucket"),
        "promotion_lanes": text("promotion_lane"),
        "parse_modes": text("parse_mode"),
        "failure_buckets": F.nullif(text("failure_signature"), F.lit("")),
        "parser_contracts": F.concat_ws("|", *[text(x) for x in CONTRACT]),
        "equation": share,
    }
    flags = {f"{x}_games": F.coalesce(c(x), F.lit(False)).cast("long") for x in ("chat_available", "map_snapshot_available")}
    numbers = {"raw_actions": c("raw_action_count"), "observations_emitted": c("total"), "observations_material": c("material"), "observations_exact": c("exact"), "observation_conflicts": c("conflicts")}
    eligible = {"settlement_evidence_eligible": F.coalesce(c("settlement_evidence_eligible"), F.lit(False)).cast("long")}
    maps = {"provenance": c("provenance"), "field_roots": c("field_roots")}
    one = folded(facts(rows, dimensions, {**numbers, **flags, **eligible}, maps), [*dimensions, *maps])
    part = lambda name: F.coalesce(F.try_element_at("equation", F.lit(name)), F.lit(0))
    of_sum = lambda name: F.coalesce(F.try_element_at("sums", F.lit(name)), F.lit(0))
    parts = ("resolved_by_parser", "manually_verified", "private_review_candidates", "unsupported_or_corrupt")
    balanced = sum((part(x) for x in parts), F.lit(0)) == of_sum("rows")
    equation = F.struct(*[part(x).alias(x) for x in parts], F.lit(0).alias("resolved_by_promoted_historical_evidence"), of_sum("rows").alias("total"), balanced.alias("balanced"))
    coverage = F.struct(*[of_sum(x).alias(x) for x in (*numbers, *flags)], "provenance", "field_roots")
    return one.select(
        of_sum("rows").alias("candidate_rows"), "result_buckets", "promotion_lanes", "parse_modes", "failure_buckets", "parser_contracts",
        equation.alias("equation"), coverage.alias("advanced_stat_coverage"), of_sum("settlement_evidence_eligible").alias("settlement_evidence_eligible"),
    )
