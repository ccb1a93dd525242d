"""Two-sample statistics (X-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def welch(df: DataFrame, flagged: str, fields: Sequence[str]) -> DataFrame:
    """Welch's t and degrees of freedom of flagged against other rows, one row a field, in one pass.

    NULL where a side has fewer than two values or both variances are 0.
    """
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    long = df.select(F.col(flagged).alias("g"), F.inline(F.array(*entries)))
    one, two = (lambda x: F.when(F.col("g"), x), lambda x: F.when(~F.col("g"), x))
    sums = long.groupBy("field").agg(
        *[f(side(F.col("value"))).alias(f"{name}{k}") for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for k, side in ((1, one), (2, two))]
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (a + b > 0)
    t = F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(a + b))
    dof = F.when(ok, (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)))
    return sums.select("field", "n1", "n2", t.alias("t"), dof.alias("dof"))
