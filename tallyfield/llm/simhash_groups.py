"""SimHash near-duplicates by the general pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions, correlated bits together. If thresholds t of the partitions sum to
RADIUS - partitions + 1, two fingerprints within RADIUS bits are within t of each other in some partition, so each
fingerprint looks up, in each partition, the values within its threshold of its own (-1: none at all). Every fingerprint
takes the thresholds, found by dynamic programming, whose lookups and estimated candidates are fewest; what they bring
is verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced
from .components import components
from .tiles import packed, tiles

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Values of a partition whose counts are known one by one in the estimates, at most; the others count as even.
FREQUENT = 256
#: Fingerprints of a block that is compared with another block at once.
BLOCK = 2048
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_PIECE = 1 << 20
U64 = np.uint64


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about _PIECE bytes at a time."""
    at = 0
    while at < len(data):
        end = _WHITE.search(data, at + _PIECE)
        end = end.start() if end else len(data)
        yield data[at:end].split()
        at = end


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    even = len(bits) // 255 * 255  # sums of so many fit into a byte
    return bits[even:].sum(axis=0, dtype=np.int64) + bits[:even].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def text_fingerprint(data: bytes) -> int:
    """The fingerprint of a text (UTF-8) as an unsigned number; 0 without words.

    A bit is set if it is set in over half of the hashes (XXH64, seed SEED) of the runs of SHINGLE words, A-Z as a-z;
    fewer words are one run.
    """
    total, votes, tail = 0, np.zeros(BITS, np.int64), []

    def add(runs: list[bytes]) -> None:
        nonlocal total, votes
        votes = votes + _votes(np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8").astype("<u8"))
        total += len(runs)

    for piece in _pieces(data.lower()):
        seen = tail + piece
        if len(seen) >= SHINGLE:
            add(list(map(b" ".join, zip(*(seen[k:] for k in range(SHINGLE)), strict=False))))
        tail = seen[-(SHINGLE - 1) :]
    if not total and tail:
        add([b" ".join(tail)])
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint (long)`` of every row; a null text is the empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([text_fingerprint(x or b"") for x in batch.column("text").to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# The plan: partitions of bits, and what is known of their values


def _correlations(prints: DataFrame) -> np.ndarray:
    """|Pearson's r| of each two bits over all fingerprints; each task sums what it has into one table of 64 x 65 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ones, n = np.zeros((BITS, BITS)), np.zeros(BITS), 0
        for batch in sliced(batches, 1 << 14):
            x = np.unpackbits(batch.column("fingerprint").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, ones, n = both + x.T @ x, ones + x.sum(axis=0), n + len(x)
        if n:
            i, j = np.indices((BITS, BITS + 1))
            columns = [i.ravel(), j.ravel(), np.column_stack([both, ones]).astype(np.int64).ravel(), np.full(i.size, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "ones", "n"])

    cells = prints.select("fingerprint").mapInArrow(run, "i bigint, j bigint, ones bigint, n bigint").groupBy("i", "j").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    table, n = np.zeros((BITS, BITS + 1)), 1
    for row in cells.toLocalIterator():  # 4,160 rows at any size
        table[row["i"], row["j"]], n = row["ones"], row["n"]
    both, share = table[:, :BITS] / n, table[:, BITS] / n
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs((both - np.outer(share, share)) / np.outer(spread, spread))
    r = np.nan_to_num(r, nan=1.0, posinf=1.0)  # a bit that never changes tells nothing, as one that another repeats
    np.fill_diagonal(r, 0)
    return r


def group_bits(r: np.ndarray, count: int) -> list[list[int]]:
    """The bits in ``count`` partitions of near the same width, correlated ones together; ties by the lower bit.

    Each partition begins with the most correlated two bits that are left and takes the bit that fits those it has best.
    """
    left, out = list(range(BITS)), []
    for k in range(count):
        width = BITS * (k + 1) // count - BITS * k // count
        own: list[int] = []
        while len(own) < width:
            if own or len(left) == 1:
                best = max(left, key=lambda b: (r[b, own].sum(), -b))
                own, left = [*own, best], [b for b in left if b != best]
            else:
                x = r[np.ix_(left, left)] - 2 * np.eye(len(left))
                i, j = divmod(int(x.argmax()), len(left))
                own = [left[i], left[j]][:width]
                left = [b for b in left if b not in own]
        out.append(sorted(own))
    return out


def balls(width: int, radius: int) -> list[int]:
    """How many values of ``width`` bits lie within 0 .. ``radius`` bits of one."""
    return np.cumsum([math.comb(width, k) for k in range(radius + 1)]).tolist()


def partition_count(n: int, radius: int = RADIUS) -> int:
    """The number of partitions with the fewest lookups and candidates for ``n`` fingerprints of even, independent bits."""

    def cost(count: int) -> float:
        per, spare = BITS / count, radius - count + 1
        each = [spare // count + (k < spare % count) for k in range(count)]
        return sum(balls(int(per), t)[-1] * (1 + n / 2**per) for t in each if t >= 0)

    return min(range(1, radius + 2), key=cost)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """For each row of ``costs[row, partition, t + 1]`` the thresholds t >= -1 of sum ``total`` whose costs are least.

    Dynamic programming over partitions: least cost of the first ones for each sum.
    """
    rows, count, choices = costs.shape
    shift = count  # the least sum is -count
    width = shift + total + count + 1
    best = np.full((rows, width), np.inf)
    best[:, shift] = 0
    taken = np.zeros((count, rows, width), np.int8)
    for p in range(count):
        new = np.full((rows, width), np.inf)
        for c in range(choices):
            t = c - 1
            lo, hi = max(0, t), min(width, width + t)
            if lo < hi:
                with_t = best[:, lo - t : hi - t] + costs[:, p, c, None]
                better = with_t < new[:, lo:hi]
                new[:, lo:hi] = np.where(better, with_t, new[:, lo:hi])
                taken[p][:, lo:hi] = np.where(better, t, taken[p][:, lo:hi])
        best = new
    out, at, each = np.empty((rows, count), np.int8), np.full(rows, shift + total), np.arange(rows)
    for p in reversed(range(count)):
        out[:, p] = taken[p][each, at]
        at = at - out[:, p]
    return out


@cache
def _flips(bits: tuple[int, ...], t: int) -> np.ndarray:
    """All changes of 1 to ``t`` of the bits."""
    found = [sum(1 << b for b in chosen) for k in range(1, t + 1) for chosen in combinations(bits, k)]
    return np.array(found, U64)


def _estimates(prints: np.ndarray, partitions: list[list[int]], frequent: list[tuple[np.ndarray, np.ndarray]], n: int, radius: int) -> np.ndarray:
    """``[row, partition, t + 1]``: lookups and estimated candidates of each fingerprint, partition and threshold."""
    out = np.zeros((len(prints), len(partitions), radius + 2))
    for p, (bits, (values, counts)) in enumerate(zip(partitions, frequent, strict=True)):
        ball = balls(len(bits), radius)
        own = prints & U64(sum(1 << b for b in bits))
        far = np.bitwise_count(own[:, None] ^ values[None, :])
        others = max(0, n - counts.sum()) / 2.0 ** len(bits)
        for t in range(radius + 1):
            out[:, p, t + 1] = ball[t] * (1 + others) + (far <= t) @ counts
    return out


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join all different fingerprints within ``radius`` bits of each other.

    ``prints`` has ``n`` distinct ``fingerprint``. Each lies under its own value of every partition, and asks under all
    values that its thresholds allow. What meets under a value is compared block by block, and a tile gives the
    components that its verified pairs make, a link for each fingerprint at most, not the pairs. The driver gets 4,160
    sums and at most FREQUENT values a partition, whatever the size.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be from 0 to 63 bits")
    count = partition_count(n, radius)
    partitions = group_bits(_correlations(prints), count)
    masks = [sum(1 << b for b in bits) for bits in partitions]
    frequent = []
    for mask, bits in zip(masks, partitions, strict=True):
        value = F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        top = prints.groupBy(value.alias("v")).agg(F.count("*").alias("n")).filter(F.col("n") > 2 + 2 * n / 2 ** len(bits)).orderBy(F.desc("n"), "v").limit(FREQUENT).collect()
        frequent.append((np.array([x["v"] for x in top], np.int64).view(U64), np.array([x["n"] for x in top], np.int64)))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            own = batch.column("fingerprint").to_numpy().view(U64)
            t = allocate(_estimates(own, partitions, frequent, n, radius), radius - count + 1)
            for p, (bits, mask) in enumerate(zip(partitions, masks, strict=True)):
                value = own & U64(mask)
                yield rows_of(p, value, own, True, t[:, p] >= 0)
                for k in range(1, radius + 1):
                    asks = np.flatnonzero(t[:, p] == k)
                    flips = _flips(tuple(bits), k)
                    step = max(1, (1 << 18) // len(flips))
                    for at in range(0, len(asks), step):
                        some = asks[at : at + step]
                        yield rows_of(p, (value[some, None] ^ flips[None, :]).ravel(), np.repeat(own[some], len(flips)), False, np.ones(len(some) * len(flips), bool))

    def rows_of(p: int, value: np.ndarray, own: np.ndarray, lies: bool, asks: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(own), p, np.int32)), pa.array(value.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), lies)), pa.array(asks)]
        return pa.RecordBatch.from_arrays(columns, ["part", "value", "fingerprint", "lies", "asks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, row, other, place, others in packed(batch):
                x, y = (z.field("fingerprint").to_numpy().view(U64) for z in (left, right))
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                lies, asks = ([z.field(c).to_numpy(zero_copy_only=False) for z in (left, right)] for c in ("lies", "asks"))
                good = (row[i] == other[j]) & (place[i] < others[j]) & (x[i] != y[j]) & (lies[0][i] & asks[1][j] | lies[1][j] & asks[0][i])
                a, b = tied(x[i[good]], y[j[good]])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = prints.select("fingerprint").mapInArrow(probes, "part int, value bigint, fingerprint bigint, lies boolean, asks boolean")
    met = tiles(rows, ["part", "value"], "fingerprint", ["fingerprint", "lies", "asks"], math.isqrt(n * count) + 1, BLOCK, needs=["lies", "asks"])
    return met.select("left", "right").mapInArrow(compare, "a bigint, b bigint").distinct()


def tied(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to its component's least one, for links ``x, y``; no more than there are values."""
    values, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    root = np.arange(len(values))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: its SimHash and the least doc_id that it reaches by links.

    Fingerprints of ``radius`` or fewer differing bits are linked, equal ones too. A null, empty or blank text has
    fingerprint zero, which is linked as any other. A row with a null doc_id takes part and gets its component's least
    doc_id, null if that has none. Repeated rows give a row each. Very long texts are taken whole, a part at a time. An
    empty table gives no row. Extra columns, whatever their names, play no part.
    """
    rows = cut(fingerprints(docs))
    prints = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")))
    roots = components(links(prints, prints.count(), radius)).select(F.col("node").alias("fingerprint"), "root")
    rooted = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    found = rooted.join(least, "root").select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select("doc_id", as_text(F.col("fingerprint")).alias("fingerprint"), "component_id")
