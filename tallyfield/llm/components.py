"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges for each task of a round at least, so that few edges don't become many files.
TASK_ROWS = 20_000


def _stars(e: DataFrame, salts: int, tasks: int) -> DataFrame:
    """``a, b, m``: the edges with the least ``b`` of each ``a``.

    A node's edges are gathered in at most ``salts`` rows before they meet its least neighbour, so a hub of any degree
    is as many light rows, dealt over the tasks, and never one task's group.
    """
    parts = e.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("_salt")).agg(F.collect_list("b").alias("_bs"), F.min("b").alias("_m"))
    least = parts.groupBy("a").agg(F.min("_m").alias("m"))
    return parts.join(least, "a").coalesce(tasks).select("a", F.explode("_bs").alias("b"), "m")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``) but the roots; a root is its component's least node.

    Each round ties every node to the least of its neighbours, first its greater, then its lesser ones, until nothing
    changes. A round is aggregations and joins on the node, and a node's edges lie in as many parts as the square root of
    all edges, so no task holds a component; loops (a = b) play no part.
    """
    e = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    before, count = None, e.count()
    while True:
        salts, tasks = math.isqrt(count) + 1, -(-2 * count // TASK_ROWS) or 1
        both = e.union(e.select("b", "a")).coalesce(tasks)
        large = _stars(both, salts, tasks).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = _stars(large, salts, tasks)
        # Each lesser neighbour is tied to the least one, and so is the node itself.
        e = small.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        e = cut(e.distinct().coalesce(tasks))
        # The two sums tell apart any two rounds that differ.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, count = now, now[0]
