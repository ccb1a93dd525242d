"""Spelling variants: words that differ by one edit, found by dense prefix-suffix tiling, and the form that each goes back to.

Two words one edit apart agree in the first or in the last half of the shorter one. Words are put under those halves, the
words under one half are compared block by block as matrices of code points, and the lengths of common prefix and common
suffix of each two tell single edits: together they reach the longer length minus one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced
from .tiles import packed, tiles

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form is this many times as frequent, at least.
RATIO = 10
#: One word of a text in so many loses a code point.
SPOILED = 31
#: Code points of a block that is compared with another block at once; a longer word is a block of its own.
BLOCK = 1 << 14
#: Words that a task counts before it gives the counts on.
HELD = 200_000
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


def text_words(text: str, doc_id: object, spoiled: int = SPOILED) -> Counter:
    """The words of a text with their counts: maximal runs, A-Z as a-z, some without one code point.

    With h the crc32 of ``<doc_id>:<word>``, a word whose h is divisible by ``spoiled`` loses its code point h % length.
    """
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUNS.findall(text)).items():
        word = run.lower() if run.isascii() else run.translate(_CAPITALS)
        h = zlib.crc32(word.encode(), start)
        if h % spoiled == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of ``least_length`` code points or more with ``least_count`` occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in sliced(batches, 64):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in text_words(text or "", doc_id).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and code points of words, padded at the end and padded at the beginning, a row a place."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0))
    ahead = np.array(words, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)
    kind = np.uint8 if ahead.max(initial=0) < 256 else np.uint32
    behind = np.zeros_like(ahead)
    for n in np.unique(lengths):
        behind[lengths == n, width - n :] = ahead[lengths == n, :n]
    return lengths, np.ascontiguousarray(ahead.T.astype(kind)), np.ascontiguousarray(behind.T.astype(kind))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many places each two words have in common from the first place on; ``x`` and ``y`` have a row a place."""
    width = min(len(x), len(y))
    out = np.zeros((x.shape[1], y.shape[1]), np.uint8 if width < 128 else np.int32)
    alive = np.ones(out.shape, bool)
    for a, b in zip(x, y, strict=False):
        alive &= a[:, None] == b[None, :]
        if not alive.any():
            break
        out += alive
    return out


def single_edits(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places i, j of all pairs of different words ``x[i], y[j]`` one edit apart, and the lengths of their common prefixes."""
    (n, ahead, behind), (m, ahead_y, behind_y) = _matrices(x), _matrices(y)
    prefix, suffix = _common(ahead, ahead_y), _common(behind[::-1], behind_y[::-1])
    longer = np.maximum(n[:, None], m[None, :])
    i, j = np.nonzero((prefix + suffix >= longer - 1) & (np.abs(n[:, None] - m[None, :]) <= 1))
    # Equal words agree in all places and more: padding agrees with padding.
    other = (n[i] != m[j]) | (prefix[i, j] < n[i])
    return i[other], j[other], prefix[i[other], j[other]].astype(np.int64)


def near_words(counts: DataFrame, total: int) -> DataFrame:
    """``word, n_near, best``: how many of the ``total`` words are one edit from each, and the most frequent (struct of n, word).

    Ties go to the word that is least by code points. A pair is compared under the halves that it agrees in, and counts in
    the first of these alone.
    """

    def halves(shorter):
        size = F.floor(shorter / 2).cast("int")
        first, last = F.substring("word", F.lit(1), size), F.substring("word", F.length("word") - size + 1, size)
        return [F.struct(shorter.alias("shorter"), F.lit(side).alias("side"), half.alias("half")) for side, half in enumerate((first, last))]

    # As the shorter of a pair or its equal, and as the longer one.
    length = F.length("word")
    keyed = counts.select("word", "n", length.alias("_length"), F.explode(F.array(*halves(length), *halves(length - 1))).alias("_k"))
    keyed = keyed.select("word", "n", "_length", "_k.*")
    met = tiles(keyed, ["shorter", "side", "half"], "word", ["word", "n"], math.isqrt(4 * total) + 1, BLOCK, weight=F.length("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shorter, side = (batch.column(c).to_numpy() for c in ("shorter", "side"))
            for left, right, row, other, place, others in packed(batch):
                x, y = left.field("word"), right.field("word")
                names, names_y = x.to_pylist(), y.to_pylist()
                i, j, prefix = single_edits(names, names_y)
                own = row[i]
                least = np.minimum(np.fromiter((len(names[k]) for k in i), np.int64, len(i)), np.fromiter((len(names_y[k]) for k in j), np.int64, len(j)))
                good = (own == other[j]) & (place[i] < others[j]) & (least == shorter[own]) & ((side[own] == 0) | (prefix < shorter[own] // 2))
                i, j = pa.array(i[good]), pa.array(j[good])
                n, m = left.field("n"), right.field("n")
                columns = [(x.take(i), y.take(j)), (y.take(j), x.take(i)), (m.take(j), n.take(i))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["word", "near", "n"])

    pairs = met.select("shorter", "side", "left", "right").mapInArrow(run, "word string, near string, n bigint")
    best = F.min_by(F.struct("n", "near"), F.struct(-F.col("n"), F.col("near")))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts (see ``count_words``).

    ``form`` is the most frequent word one edit away if that is ``ratio`` times as frequent or more, else null; ``root`` is
    the last of the forms from a word on, the word itself if it has none. Texts are taken whole, of any length; a null or
    empty one has no words. A null doc_id counts as an empty one. Repeated rows count again. Ties go by code points. An
    empty table gives no row. Extra columns, whatever their names, play no part.
    """
    counts = cut(count_words(docs))
    total, most = counts.agg(F.count("*"), F.max("n")).first()
    near = near_words(counts, total)
    formed = F.col("best.n") >= ratio * F.col("n")
    found = counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n"))
    found = cut(found)
    links = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # A form is so many times as frequent, so a chain has few steps; each round doubles those that are taken.
    steps = math.log(max(most or 1, 1) / LEAST_COUNT + 1, ratio)
    for _ in range(math.ceil(math.log2(steps + 1)) if links.head(1) else 0):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("_after"))
        links = cut(links.join(after, "root", "left").select("word", F.coalesce("_after", "root").alias("root")))
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
