"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sliced, strings

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Languages whose sums are held at once.
BLOCK = 64
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters, made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of the texts, and the text of each.

    Texts are lower-cased, runs of other characters than letters count as one space, and n-grams of ORDERS that hold
    more than that space are kept; none crosses from one text to the next.
    """
    letters = _letters()
    codes = np.frombuffer("".join(f"\x00{x.lower()}\x00" for x in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(x.lower()) + 2 for x in texts), np.int64, len(texts))
    own = np.repeat(np.arange(len(texts)), lengths)
    is_letter = letters[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of others the first stands for all
    keep[:1] = True
    keep[1:] |= own[1:] != own[:-1]  # each text has its own beginning, whatever stands before it in the batch
    codes, own, is_letter = np.where(is_letter, codes, 32)[keep].astype(np.uint32), own[keep], is_letter[keep]
    found, texts_of = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h, some = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32), np.zeros(m, bool)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
            some |= is_letter[k : k + m]
        some &= own[:m] == own[n - 1 :]
        found.append((h[some] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13))
        texts_of.append(own[:m][some])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(texts_of)


def learn(docs: DataFrame, modulus: int = 5, held: int = 0) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (BUCKETS + 1 rows: buckets, then the prior).

    Learned from every row with a text and a language whose crc32(doc_id) modulo ``modulus`` is not ``held`` (a null
    doc_id is not learned from). Each task counts n-grams by language in a dense matrix; Spark sums these. What the
    driver gets is one number a bucket and language, so it is bounded by the languages that ``lang`` names, not by the
    documents. With nothing to learn from there are no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 256):
            texts, langs = strings(batch, "text"), batch.column("lang").to_pylist()
            buckets, of = gram_buckets(texts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            for i, name in enumerate(names):
                total = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                total[:BUCKETS] += np.bincount(buckets[which[of] == i], minlength=BUCKETS)
                total[BUCKETS] += int((which == i).sum())
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = (
        docs.select("text", F.col("lang").cast("string").alias("lang"), fold("doc_id", modulus).alias("fold"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != held))
        .select("text", "lang")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pandas()
    )
    langs = sorted(set(rows.lang))
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows.bucket.to_numpy(int), rows.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(int)] = rows.n.to_numpy()
    matrix = np.log(counts[:BUCKETS] + 0.5) - np.log(counts[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS)
    return langs, np.vstack([matrix, np.log((counts[BUCKETS:] + 1) / (counts[BUCKETS:].sum() + len(langs)))])


def predict(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text: sums of the log-probabilities of its n-grams' buckets."""
    if not langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    buckets, of = gram_buckets(texts)
    known = np.bincount(of, minlength=len(texts)) > 0
    best, top, total = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for first in range(0, len(langs), BLOCK):
        block = range(first, min(first + BLOCK, len(langs)))
        sums = np.stack([np.bincount(of, matrix[buckets, k], minlength=len(texts)) + matrix[BUCKETS, k] for k in block], axis=1)
        high = np.maximum(top, sums.max(axis=1))
        total = total * np.exp(top - high) + np.exp(sums - high[:, None]).sum(axis=1)
        better = sums.max(axis=1) > top
        best[better], top = first + sums.argmax(axis=1)[better], high
    return [langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, 1 / total, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, modulus: int = 5, held: int = 0) -> DataFrame:
    """Predict the language of every row: ``doc_id, held_out, lang_pred, score``.

    ``score`` is the posterior of the predicted language (0 to 1). A null text or one without a letter is ``und`` with
    score 0, as is every text if there was nothing to learn from. Languages with equal posterior: the first by name. A
    null doc_id has ``held_out`` false. Very long texts are taken whole. Repeated rows give repeated rows; an empty table
    gives none. Extra columns, whatever their names, play no part.
    """
    langs, matrix = model or learn(docs, modulus, held)
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            names, scores = predict(strings(batch, "text"), langs, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, min_score: float = 0.5, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows whose language is told with ``min_score`` or more, all columns as they are; ``und`` rows go.

    A null doc_id or repeated rows change nothing; null and empty texts go; an empty table gives none. Very long texts are
    judged whole. Of languages alike in score the first by name is taken. Extra columns, whatever their names, stay.
    """
    langs, matrix = learn(docs, modulus, held)
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            names, scores = predict(strings(batch, "text"), langs, shared.value)
            yield batch.filter(pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
