"""What the corpus operators share: table reads, lineage cuts, and byte-level word hashing in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_GROW = 1 << 16
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    A session on one machine (tests) gets a temporary folder if it has none; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, keys: list[str], by: str, columns: list[str], salts: int) -> DataFrame:
    """``keys, _rows``: the rows of each key in at most ``salts`` lists, dealt by ``by``, so that a hot key joins as few light rows.

    With ``salts`` near the square root of all rows neither the lists nor their number grow as a key's rows do.
    """
    return df.groupBy(*keys, F.pmod(F.xxhash64(by), F.lit(salts)).alias("_salt")).agg(F.collect_list(F.struct(*columns)).alias("_rows")).drop("_salt")


def spread(parts: DataFrame) -> DataFrame:
    """What was ``gathered``, row by row, with the columns joined to it."""
    others = [c for c in parts.columns if c != "_rows"]
    return parts.select(*others, F.explode("_rows").alias("_row")).select(*others, "_row.*")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo ``modulus``; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made from one of them stays small in memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers), wrapping."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: Space and the ASCII controls 09 to 0D.
WHITE = byte_table(b" \t\n\x0b\x0c\r")
#: Every ASCII byte that is no letter and no digit; bytes of other scripts are word bytes.
NON_ALNUM = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = -(-n // _GROW) * _GROW
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INV)):
                row = np.full(size, base, U64)
                row[0] = 1
                _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in UTF-8 bytes, all by array operations."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return starts, ends, hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, U64)
        for k in range(n):
            out = out * _BASE + hashes[k : k + m]
    return mix(out)


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end) the number of code points before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lowered(text: str) -> str:
    """Lower case with every code point in its place: one that would become several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
