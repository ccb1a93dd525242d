"""Comparing all rows that share a key, block by block, so that a hot key is many tasks and its pairs are never rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, spread

#: Small groups are put together until a tile has so many rows on its left side.
TILE_ROWS = 128


def _any(rows: str, name: str) -> Column:
    return F.exists(rows, lambda x: x[name])


def tiles(rows: DataFrame, keys: Sequence[str], by: str, columns: Sequence[str], salts: int, most: int, weight: Column | None = None, needs: Sequence[str] = ()) -> DataFrame:
    """``keys, left, right``: pairs of blocks that hold each pair of one key's rows once; ``right`` is null where a block meets itself.

    The rows of a key are dealt by ``by`` into blocks of about ``most`` (of ``weight``, 1 a row by default). Rows without a
    partner under their key go, and keys none of whose rows has a true ``needs`` column, for each of these. ``salts`` is
    near the square root of all rows: a hot key's rows meet its block count as that many lists.
    """
    keys = list(keys)
    weight = F.lit(1) if weight is None else weight
    light = rows.select(*keys, *columns, weight.cast("long").alias("_weight"))
    parts = gathered(light, keys, by, [*columns, "_weight"], salts)
    total = F.sum(F.aggregate("_rows", F.lit(0).cast("long"), lambda acc, x: acc + x["_weight"])).alias("_total")
    has = [F.max(_any("_rows", c)).alias(f"_has_{c}") for c in needs]
    sizes = parts.groupBy(*keys).agg(F.sum(F.size("_rows")).alias("_n"), total, *has).filter(F.col("_n") > 1)
    for c in needs:
        sizes = sizes.filter(F.col(f"_has_{c}"))
    sizes = sizes.select(*keys, F.least(F.ceil(F.col("_total") / most), "_n").alias("_blocks"))
    dealt = spread(parts.join(sizes, keys)).withColumn("_block", F.pmod(F.xxhash64(by), F.col("_blocks")))
    blocks = cut(dealt.groupBy(*keys, "_blocks", "_block").agg(F.collect_list(F.struct(*columns)).alias("_rows")))
    alone = blocks.filter(F.col("_blocks") == 1).select(*keys, F.col("_rows").alias("left"), F.lit(None).cast(blocks.schema["_rows"].dataType).alias("right"))
    several = blocks.filter(F.col("_blocks") > 1)
    # Each block is sent by name to those from itself on.
    sent = several.select(*keys, F.col("_rows").alias("left"), F.col("_block").alias("_from"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_block"))
    met = sent.join(several.select(*keys, "_block", "_rows"), [*keys, "_block"])
    return alone.union(met.select(*keys, "left", F.when(F.col("_from") != F.col("_block"), F.col("_rows")).alias("right")))


def packed(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of consecutive rows of ``tiles``: left and right structs, the row of each, and the places that say which pairs count.

    Of one row, a left and a right struct are a pair if the left place is less than the right one.
    """

    def flat(rows: list[int]):
        left, right, group_of, groups_of, places, others = [], [], [], [], [], []
        for k in rows:
            a = lefts[k].values
            own = not rights[k].is_valid
            b = a if own else rights[k].values
            left.append(a)
            right.append(b)
            group_of.append(np.full(len(a), k))
            groups_of.append(np.full(len(b), k))
            places.append(np.arange(len(a)) if own else np.full(len(a), -1))
            others.append(np.arange(len(b)))
        return (pa.concat_arrays(left), pa.concat_arrays(right), *map(np.concatenate, (group_of, groups_of, places, others)))

    lefts, rights = batch.column("left"), batch.column("right")
    rows, held = [], 0
    for k in range(batch.num_rows):
        rows.append(k)
        held += len(lefts[k].values)
        if held >= TILE_ROWS:
            yield flat(rows)
            rows, held = [], 0
    if rows:
        yield flat(rows)
