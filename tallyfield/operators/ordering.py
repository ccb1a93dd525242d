"""Previous rows and running sums of long histories, split by buckets of the order so that one key may hold most rows.

A window over (keys, bucket) sees one bucket of a key; what a bucket needs of those before it is one row a bucket, put
together by a second window over that small table and joined back on the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _back(df: DataFrame, small: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Join a per-bucket value, NULL keys too."""
    renamed = small.select(*[F.col(c).alias(f"_r_{c}") for c in on], value)
    cond = [df[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return df.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])


def with_previous(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], bucket: Column, name: str = "_previous") -> DataFrame:
    """``name``: the row before's ``order`` value within the keys. ``bucket`` must not fall as ``order`` grows; it stays as ``_bucket``."""
    rows = df.withColumn("_bucket", bucket)
    on = [*keys, "_bucket"]
    ends = rows.groupBy(*on).agg(F.max(order).alias("_top")).withColumn("_before", F.lag("_top").over(Window.partitionBy(*keys).orderBy("_bucket")))
    local = rows.withColumn("_local", F.lag(order).over(Window.partitionBy(*on).orderBy(order, *tie)))
    return _back(local, ends, on, "_before").withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before")


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to each row within the keys; ``df`` has ``_bucket``."""
    on = [*keys, "_bucket"]
    totals = df.groupBy(*on).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_offset", F.coalesce(before, F.lit(0)))
    local = df.withColumn("_local", F.sum(value).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _back(local, totals, on, "_offset").withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset")


def with_max_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``name``: the greatest ``value`` of the rows before each within the keys, NULL for the first; ``df`` has ``_bucket``."""
    on = [*keys, "_bucket"]
    before = F.max("_max").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    tops = df.groupBy(*on).agg(F.max(value).alias("_max")).withColumn("_offset", before)
    local = df.withColumn("_local", F.max(value).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    return _back(local, tops, on, "_offset").withColumn(name, F.greatest("_local", "_offset")).drop("_local", "_offset")
