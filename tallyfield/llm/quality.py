"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bytes_of, fold, grams, sliced, strings, words

#: Hash buckets of words, of word shapes, and of measures of the whole text.
WORD_BUCKETS, SHAPE_BUCKETS, MEASURES = 3072, 960, 64
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + MEASURES
RANK = 64
#: At most so many labelled documents are the neighbours: those with the least hash of their id.
MAX_LABELLED = 4000
NEIGHBOURS = 25
THRESHOLD = 0.7
_SHAPE = np.arange(256, dtype=np.uint8)
for _chars, _as in ((range(97, 123), 97), (range(65, 91), 65), (range(48, 58), 48), (range(128, 256), 97)):
    _SHAPE[list(_chars)] = _as


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights: words, word shapes (letter case, digits, marks) and measures of repetition and length.

    Each of the three groups with square-rooted counts of norm 1, so that none drowns the others.
    """
    data = bytes_of(text)
    _, _, hashes = words(data)
    coded = _SHAPE[data]
    shapes = words(coded[np.concatenate(([True], coded[1:] != coded[:-1]))] if len(coded) else coded)[2]
    runs = grams(hashes, 5)
    repeated = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
    measures = np.array([int(repeated * 15), 16 + min(15, len(hashes).bit_length())])
    out, weights = [], []
    for found, buckets, base in ((hashes, WORD_BUCKETS, 0), (shapes, SHAPE_BUCKETS, WORD_BUCKETS), (measures.astype(np.uint64), MEASURES, WORD_BUCKETS + SHAPE_BUCKETS)):
        if len(found):
            at, n = np.unique((found % np.uint64(buckets)).astype(np.int64), return_counts=True)
            w = np.sqrt(n)
            out.append(at + base)
            weights.append(w / np.sqrt((w * w).sum()))
    return np.concatenate(out), np.concatenate(weights)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and of those with each term, over all documents; bounded by TERMS counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in sliced(batches):
            for text in strings(batch, "text"):
                total[terms(text)[0]] += 1
                n += 1
        total[TERMS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return int(out[TERMS]), out[:TERMS]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, seed: int = 7):
    """(term weights, projection, labelled vectors, their labels); empty vectors if there is no labelled row.

    Labelled rows: those with a label whose crc32(doc_id) modulo ``modulus`` is not ``held``, at most MAX_LABELLED of
    them, by the least hash of the id. Inverse document frequencies cover all documents.
    """
    n, df = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    chosen = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & (fold("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(MAX_LABELLED)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [terms(x) for x in strings(batch, "text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "terms", "weights"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # The chosen ids are MAX_LABELLED at most. Of a repeated one the text with the least hash counts.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .mapInArrow(vectors, f"doc_id {kind}, label double, terms array<bigint>, weights array<double>")
        .orderBy("doc_id")
        .collect()
    )
    matrix = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        matrix[k, r.terms] = np.array(r.weights) * idf[r.terms]
    if not rows:
        return idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    rank = min(RANK, len(rows))
    # Truncated SVD by subspace iteration.
    basis = np.linalg.qr(matrix @ np.random.default_rng(seed).standard_normal((TERMS, min(len(rows), rank + 16))).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    _, _, right = np.linalg.svd(basis.T @ matrix, full_matrices=False)
    projection = np.ascontiguousarray(right[:rank].T)
    latent = matrix @ projection
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return idf, projection, latent, np.array([r.label for r in rows])


def vote(sims: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of each row's k nearest, weighted by cosine (to the 8th power, none below 0); 0.5 without any weight.

    All that are as near as the k-th vote, so ties don't hang on an order.
    """
    k = min(k, sims.shape[1])
    if not k:
        return np.full(len(sims), 0.5)
    furthest = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    weight = np.where(sims >= furthest[:, None], np.maximum(sims, 0), 0).astype(np.float64)
    for _ in range(3):
        weight *= weight
    total = weight.sum(axis=1)
    return np.where(total > 0, weight @ labels / np.maximum(total, 1e-300), 0.5)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row's whole text: ``doc_id, held_out, score, predicted``.

    ``score`` (0 to 1) is the weighted vote of the nearest labelled documents over exact cosines, taken in blocks of
    rows. Null and empty texts are scored like any other, by their (empty) measures. ``predicted`` is 1 if the score
    reaches ``threshold``. Without labelled rows every score is 0.5. A null doc_id has ``held_out`` false. Very long texts
    are taken whole. Equally near neighbours all vote. Repeated rows give repeated rows; an empty table gives none. Extra
    columns, whatever their names, play no part. What is broadcast is bounded by MAX_LABELLED, TERMS and RANK.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, modulus, held))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, projection, latent, given = shared.value
        for batch in sliced(batches, 256):
            block = np.zeros((batch.num_rows, TERMS), np.float32)
            for k, text in enumerate(strings(batch, "text")):
                at, weights = terms(text)
                block[k, at] = weights * idf[at]
            own = block @ projection
            own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
            scores = np.clip(vote(own @ latent.T, given), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
