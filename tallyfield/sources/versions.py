"""Tables of versions that hold changed rows alone, and writes that a guard must allow (C-43)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The greatest version that was written to its end; None if there is none."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return None
    found = []
    for status in fs.listStatus(where):
        name = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        if name and fs.exists(_files(spark, f"{path}/version={name[1]}/_SUCCESS")[1]):
            found.append(int(name[1]))
    return max(found, default=None)


def read_version(spark: SparkSession, path: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The table as of a version (the newest by default): each key's row of the last version that changed it."""
    newest = newest_version(spark, path)
    if newest is None:
        raise FileNotFoundError(f"{path} has no version")
    upto = newest if version is None else version
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={k}" for k in range(upto + 1) if _files(spark, f"{path}/version={k}/_SUCCESS")[0].exists(_files(spark, f"{path}/version={k}/_SUCCESS")[1])])
    others = [c for c in rows.columns if c not in (*keys, "version")]
    newest_rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("_row"))
    return newest_rows.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def _claim(spark: SparkSession, path: str, version: int) -> bool:
    """Whether this writer, and no other, is the one of the version: the claim is a file that can be made only once."""
    fs, where = _files(spark, f"{path}/_claims/{version}")
    try:
        fs.create(where, False).close()
    except Exception as e:  # the JVM's error for a file that is there
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def create(rows: DataFrame, path: str) -> None:
    """Version 0: all rows."""
    if not _claim(rows.sparkSession, path, 0):
        raise PySparkException(f"{path} is there already")
    rows.write.parquet(f"{path}/version=0")


def guarded_apply(plans: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], guard: Column, expected: int) -> DataFrame:
    """Change the planned rows of a table's version ``expected``, all of them or none, and read back what was written.

    ``plans`` has the keys, each once, ``after`` (a struct of ``columns``) and what ``guard`` reads beside the present row's
    columns, which it finds under ``now``. The result has a row a plan: the keys, ``outcome`` and ``differs`` (columns that
    read back otherwise, null-safe, sorted). ``stale_version``: the table has moved on, and nothing was written;
    ``guard_failed``: the present row is missing or does not pass, so nothing was written; ``not_applied``: it passes, but
    another plan does not; ``applied``: it stands as planned; ``mismatch``: it was written and reads back otherwise. The
    writer that claims the next version first is the only one to write it, and only changed rows are written.
    """
    spark = plans.sparkSession
    none = F.array().cast("array<string>").alias("differs")
    if newest_version(spark, path) != expected:
        return plans.select(*keys, F.lit("stale_version").alias("outcome"), none)
    table = read_version(spark, path, keys, expected)
    others = [c for c in table.columns if c not in keys]
    present = table.select(*keys, F.struct(*others).alias("now"))
    checked = plans.join(present, list(keys), "left").withColumn("_passes", F.col("now").isNotNull() & F.coalesce(guard, F.lit(False)))
    if checked.filter(~F.col("_passes")).head(1):
        return checked.select(*keys, F.when(F.col("_passes"), "not_applied").otherwise("guard_failed").alias("outcome"), none)
    if not _claim(spark, path, expected + 1):
        return plans.select(*keys, F.lit("stale_version").alias("outcome"), none)
    changed = checked.select(*keys, *[(F.col(f"after.{c}") if c in columns else F.col(f"now.{c}")).cast(table.schema[c].dataType).alias(c) for c in others])
    changed.write.parquet(f"{path}/version={expected + 1}")
    back = read_version(spark, path, keys, expected + 1).select(*keys, F.struct(*others).alias("_back"))
    differs = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"_back.{c}").eqNullSafe(F.col(f"after.{c}").cast(table.schema[c].dataType)), F.lit(c)) for c in columns])))
    read = plans.join(back, list(keys), "left").withColumn("differs", differs)
    return read.select(*keys, F.when(F.size("differs") == 0, "applied").otherwise("mismatch").alias("outcome"), "differs")
