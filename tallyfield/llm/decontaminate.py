"""Benchmark decontamination: rare n-gram seeds pick passages, common words in order bound them, Smith-Waterman scores them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, bytes_of, code_points, grams, lowered, sliced, strings, words

SEED_WORDS = 2
#: A rare seed stands at most so often in the corpus, and so often again in each million of its words.
RARE = 50
#: An item of fewer words is found only in texts that have just its words.
MIN_WORDS = 3
MIN_SCORE = 0.4
#: The test items broadcast at once have at most about so many characters; a larger benchmark is taken in blocks.
BLOCK_CHARS = 8_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_FILTER_BITS = 22


def item_words(text: str | None) -> np.ndarray:
    return words(bytes_of(lowered(text or "")), NON_ALNUM)[2]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its score over the whole item's own (0 to 1), begin and end in the passage's words.

    One array step for each word of the item; a gap along the row is a running maximum. Of equal scores the alignment
    found first, with the first end, counts.
    """
    n = len(passage)
    if not len(item) or not n:
        return 0.0, 0, 0
    places = np.arange(n + 1)
    slope = -GAP * places
    row, begin = np.zeros(n + 1, np.int64), places
    best = (0, 0, 0)
    for word in item:
        across = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = row[1:] + GAP
        new, new_begin = np.zeros(n + 1, np.int64), places.copy()
        top = np.maximum(across, down)
        on = top > 0
        new[1:][on] = top[on]
        new_begin[1:][on] = np.where(across >= down, begin[:-1], begin[1:])[on]
        level = new + slope
        highest = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == highest, places, 0))
        row, begin = highest - slope, new_begin[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at)
    return best[0] / (MATCH * len(item)), best[1], best[2]


class Grams:
    """Sorted hashes behind a bit table that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._low(hashes)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``found`` a known hash stands, and which."""
        at = np.flatnonzero(self.bits[self._low(found)])
        if not len(at):
            return at, at
        k = np.searchsorted(self.hashes, found[at])
        k[k == len(self.hashes)] = 0
        hit = self.hashes[k] == found[at]
        return at[hit], k[hit]


class Seeds:
    """The n-grams of a block of items, the rare ones marked, with postings to the items.

    ``rate`` is what ``gram_rates`` gives for each of ``hashes``. Rare are the n-grams of at most ``rare`` and, of any run
    of words that alone can reach ``min_score``, the rarest, so that each such run has a rare one.
    """

    def __init__(self, items: list[np.ndarray], hashes: np.ndarray, rate: np.ndarray, min_score: float = MIN_SCORE, rare: float = RARE):
        self.items, self.lengths = items, np.array([len(x) for x in items], np.int64)
        found, of, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for i, x in enumerate(items):
            if len(x) < MIN_WORDS:
                continue
            g = grams(x, SEED_WORDS)
            rates = rate[np.searchsorted(hashes, g)]
            mark = rates <= rare
            width = min(len(g), max(1, math.ceil(min_score * len(x) - 1e-9) - SEED_WORDS + 1))
            runs = np.lib.stride_tricks.sliding_window_view(rates, width)
            mark[np.arange(len(runs)) + runs.argmin(axis=1)] = True
            g, at = np.unique(g, return_inverse=True)
            found.append(g)
            of.append(np.full(len(g), i))
            marks.append(np.bincount(at, mark) > 0)
        flat = np.concatenate(found)
        order = np.argsort(flat, kind="stable")
        self.of, self.rare = np.concatenate(of)[order], np.concatenate(marks)[order]
        own, first = np.unique(flat[order], return_index=True)
        self.grams, self.first = Grams(own), np.append(first, len(flat))
        # Of each item's different words the places, as bits, and how many more words it has than those.
        self.places_of: list[dict[int, int]] = [{} for _ in items]
        for x, places in zip(items, self.places_of, strict=True):
            for k, word in enumerate(x.tolist()):
                places[word] = places.get(word, 0) | 1 << k
        self.kinds = [(frozenset(p), len(x) - len(p)) for x, p in zip(items, self.places_of, strict=True)]
        self.whole: dict[bytes, list[int]] = {}
        for i, x in enumerate(items):
            if 0 < len(x) < MIN_WORDS:
                self.whole.setdefault(x.tobytes(), []).append(i)

    def bound(self, item: int, passage: list[int]) -> int:
        """The words of the item's longest common subsequence with the passage, bit-parallel: no alignment matches more."""
        places, full = self.places_of[item], (1 << int(self.lengths[item])) - 1
        row = full
        for x in passage:
            if here := places.get(x):
                here &= row
                row = (row + here | row - here) & full
        return (row ^ full).bit_count()

    def passages(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of each passage with a rare seed of the item or two different ones.

        Seeds no further apart than the item is long are one passage; one of more than two such lengths is split.
        """
        at, k = self.grams.places(grams(hashes, SEED_WORDS))
        if not len(at):
            return []
        times = self.first[k + 1] - self.first[k]
        posts = np.repeat(self.first[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
        order = np.lexsort((np.repeat(at, times), self.of[posts]))
        posts, places = posts[order], np.repeat(at, times)[order]
        of, gram = self.of[posts], np.repeat(k, times)[order]
        size = self.lengths[of]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (places[1:] - places[:-1] > size[1:])
        begins, chain = np.flatnonzero(new), np.cumsum(new) - 1
        picked = np.maximum.reduceat(self.rare[posts], begins) | (np.minimum.reduceat(gram, begins) != np.maximum.reduceat(gram, begins))
        part = (places - places[begins[chain]]) // (2 * size)
        new[1:] |= part[1:] != part[:-1]
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(of)) - 1
        keep = picked[chain[begins]]
        begins, ends = begins[keep], ends[keep]
        return list(zip(of[begins].tolist(), places[begins].tolist(), (places[ends] + SEED_WORDS).tolist(), strict=True))

    def matches(self, hashes: np.ndarray, min_score: float) -> Iterator[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) of each passage of a text that reaches ``min_score``."""
        if len(hashes) < MIN_WORDS:
            for item in self.whole.get(hashes.tobytes(), []):
                yield item, 1.0, 0, len(hashes)
        listed = None
        for item, first, last in self.passages(hashes):
            size = int(self.lengths[item])
            a, b = max(0, first - size), min(len(hashes), last + size)
            listed = hashes.tolist() if listed is None else listed
            kinds, more = self.kinds[item]
            need, passage = min_score * size - 1e-9, listed[a:b]
            # The looser bound is the quicker one.
            if len(kinds.intersection(passage)) + more >= need and self.bound(item, passage) >= need:
                score, begin, end = smith_waterman(self.items[item], hashes[a:b])
                if score >= min_score:
                    yield item, score, a + begin, a + end


def gram_rates(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """How often each of the n-grams stands in all documents, over the words in millions and one: a pass, counted in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(Grams(hashes))
    n = len(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, np.zeros(n + 1, np.int64)
        for batch in sliced(batches):
            for text in strings(batch, "text"):
                found = item_words(text)
                total += np.bincount(known.places(grams(found, SEED_WORDS))[1], minlength=n + 1)
                total[n] += len(found)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = docs.select("text").filter(F.col("text").isNotNull()).mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n + 1)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out[:n] / (1 + out[n] / 1e6)


def _blocks(docs: DataFrame, benchmark: DataFrame, min_score: float) -> Iterator[tuple[list, Seeds]]:
    """The items' ids and seeds, block by block; each block has about BLOCK_CHARS characters of items at most."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    block_of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items.filter(block_of == k).orderBy("item_id", "text").collect()
        found = [item_words(r.text) for r in rows]
        hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(grams(x, SEED_WORDS) for x in found if len(x) >= MIN_WORDS)]))
        rate = gram_rates(docs, hashes) if len(hashes) else np.zeros(0)
        yield [r.item_id for r in rows], Seeds(found, hashes, rate, min_score)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs of documents and test items: ``doc_id, item_id, score, start, end, passages``.

    ``score`` is the best passage's Smith-Waterman score over the item's own (0 to 1, at least ``min_score``), ``start``
    and ``end`` its code points in the text, ``passages`` how many of the document's passages reach ``min_score``.

    Seeds are an item's SEED_WORDS-grams. Rare ones, of which one suffices, stand at most RARE times, and as often again
    in each million words of all documents, or are the rarest of a run of words that could reach ``min_score`` alone; of
    the others it takes two. Passages that share too few words for ``min_score`` are not aligned.

    Null and empty texts match nothing, nor do items without a word; an item of fewer than MIN_WORDS words is found only
    in texts of just its words. Very long texts are taken whole, passage by passage. Repeated rows count once, and rows
    with one doc_id (null too) are one document. Ties in score: the passage that starts first. Either table may be empty.
    Extra columns, whatever their names, play no part.
    """
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    spark, parts = docs.sparkSession, []
    for ids, seeds in _blocks(docs, benchmark, min_score):
        shared = spark.sparkContext.broadcast(seeds)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in sliced(batches):
                found = []
                for i, text in enumerate(strings(batch, "text")):
                    data = bytes_of(lowered(text))
                    starts, ends, hashes = words(data, NON_ALNUM)
                    chars = None
                    for item, score, a, b in index.matches(hashes, min_score):
                        chars = code_points(data) if chars is None else chars
                        found.append((i, item, score, int(chars[starts[a]]), int(chars[ends[b - 1]])))
                at, *rest = zip(*found, strict=True) if found else [()] * 5
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
                columns = [batch.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "score", "start", "end"])

        texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
        found = texts.mapInArrow(find, f"doc_id {doc_kind}, item int, score double, start bigint, end bigint")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_kind}")
        parts.append(found.join(names, "item").drop("item"))
    best_first = F.struct(-F.col("score"), "start", "end")
    return (
        reduce(DataFrame.unionByName, parts)
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.max("score").alias("score"), F.min_by(F.struct("start", "end"), best_first).alias("best"), F.count("*").alias("passages"))
        .select("doc_id", "item_id", "score", "best.start", "best.end", "passages")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows that hold no test item (as ``find_leaks`` finds them), with all their columns.

    Each row is judged by its own text, whatever its doc_id (null or repeated); null and empty texts stay. Very long texts are
    searched whole. Repeated test items are one; with none all rows stay, and an empty table gives none. Extra columns,
    whatever their names, stay as they are.
    """
    at = docs.columns.index("text")
    kept = docs
    for _, seeds in _blocks(docs, benchmark, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in sliced(batches):
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([next(index.matches(item_words(x), min_score), None) is None for x in texts], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
