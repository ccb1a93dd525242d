"""Near-duplicates by Order MinHash: sketches of least shingles in text order, verified by banded edit alignment.

A text's shingles are all runs of SHINGLE words, each labelled with how often it stood there before. A sketch takes the
TAKEN labelled shingles least under one hash order and keeps them in the order of the text, so it is sensitive to the
order as edit similarity is. Two texts that share a part s of all their different shingles share one sketch with
probability near s ** TAKEN, one of SKETCHES with 1 - (1 - s ** TAKEN) ** SKETCHES: all but 1 in 10**12 where s is 0.8, and
95 % where s is 0.42, as it is with every tenth word changed. Texts of at most SHORT words are found exactly: each is bucketed
by pairs of its rarest labelled words, as many as must hold a pair that a similar text has among its own.

The similarity is that of the words: 1 - d / max(n, m), with d the edit distance of the two word sequences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, bytes_of, cut, gathered, grams, lowered, mix, sliced, spread, strings, words
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
TAKEN, SKETCHES = 3, 40
#: Texts of at most so many words meet by pairs of their rarest words, without loss; longer ones by sketches.
SHORT = 45
#: Texts of fewer words have no other near-duplicates than copies.
LEAST_WORDS = 4
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WIDE = 1 << 16
#: Texts of a block that is compared with another block at once.
BLOCK = 256
#: Bits of a text's signature: a power of two, near twelve for each word, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 11, 1 << 16


def text_words(text: str) -> np.ndarray:
    return words(bytes_of(lowered(text)), WHITE)[2]


def text_node(hashes: np.ndarray) -> int | None:
    """A 64-bit name of the word sequence; none for a text without words."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(hashes) else None


def labels(shingles: np.ndarray) -> np.ndarray:
    """The shingles, each labelled with how often it stood there before."""
    n = len(shingles)
    if not n:
        return shingles
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    places = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64)
    return mix(shingles + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketches(shingles: np.ndarray) -> np.ndarray:
    """The SKETCHES Order MinHash sketches, each as one hash with its number mixed in; none without shingles."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    labelled, places = labels(shingles), np.arange(n)
    taken = min(TAKEN, n)
    rows = SKETCHES if n <= _WIDE else 1
    out = np.empty(SKETCHES, np.uint64)
    for k in range(0, SKETCHES, rows):
        # Each order is a bijection of the 64-bit labels.
        orders = (labelled[None, :] ^ _SEEDS[k : k + rows, None]) * (_SEEDS[k : k + rows, None] | np.uint64(1))
        at = np.argpartition(orders, taken - 1, axis=1)[:, :taken] if taken < n else np.broadcast_to(places, (rows, n))
        kept = shingles[np.sort(at, axis=1)]
        total = _SEEDS[k : k + rows].copy()
        for j in range(taken):
            total = mix(total * np.uint64(3) + kept[:, j])
        out[k : k + rows] = total
    return out.view(np.int64)


def edit_similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - d / max(n, m) of two word sequences with edit distance d, if it is ``least`` or more, else 0.

    What both begin and end with is set aside; then a count of shared words bounds the rest, and a bit-parallel edit
    distance is taken over matches within the band that the similarity allows: two texts this similar are at most d
    words out of line.
    """
    n, m = len(x), len(y)
    size, longer = min(n, m), max(n, m)
    most = int((1 - least) * longer + 1e-9)
    if not size or longer - size > most:
        return 0.0
    differ = np.flatnonzero(x[:size] != y[:size])
    head = int(differ[0]) if len(differ) else size
    size -= head
    differ = np.flatnonzero(x[n - size :][::-1] != y[m - size :][::-1])
    tail = int(differ[0]) if len(differ) else size
    a, b = x[head : n - tail], y[head : m - tail]
    distance = max(len(a), len(b))
    if len(a) and len(b):
        (u, nu), (v, nv) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if distance - int(np.minimum(nu[i], nv[j]).sum()) > most:
            return 0.0
        distance = _band_distance(a.tolist(), b.tolist(), most)
    return 1 - distance / longer if distance <= most else 0.0


def _band_distance(a: list[int], b: list[int], band: int) -> int:
    """Edit distance with matches at most ``band`` off the diagonal, exact up to ``band``: a column of differences as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, window = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << 2 * band + 1) - 1
    up, down, distance = full, 0, len(a)
    for j, x in enumerate(b):
        same = places.get(x, 0)
        if same:
            same &= window << j - band if j >= band else window >> band - j
        across = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(across | up), up & across
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(same | down | more), more & (same | down)
    return distance


def sketched(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, sketches, labels`` of every row; the node is null for a text without words.

    Texts of at most SHORT words have labelled words and no sketches, those that may be similar to one of them have both.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, found, short = [], [], []
            for text in strings(batch, "text"):
                hashes = text_words(text)
                nodes.append(text_node(hashes))
                found.append(sketches(grams(hashes, SHINGLE)) if len(hashes) > SHORT else [])
                short.append(labels(hashes).view(np.int64) if LEAST_WORDS <= len(hashes) <= SHORT / least + 1e-9 else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(found, longs), pa.array(short, longs)], ["doc_id", "node", "sketches", "labels"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node bigint, sketches array<bigint>, labels array<bigint>")


def short_buckets(texts: DataFrame, least: float) -> DataFrame:
    """``node, bucket`` of the texts with labels: all pairs of each one's rarest labels that other texts have too.

    Of n words a text of similarity ``least`` shares ceil(least * n) or more, so of the rarest n - ceil(least * n) + 2 of
    either, in one order for all texts, at least two are common to both. These are 13 words at most, or 78 pairs.
    """
    each = texts.select("node", F.explode("labels").alias("label"))
    held = each.join(each.groupBy("label").agg(F.count("*").alias("texts")), "label")
    ranked = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "label"))).alias("found"))
    n = F.size("found")
    first = F.slice("found", 1, (n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 2).cast("int"))
    own = F.transform(F.filter(first, lambda x: x["texts"] > 1), lambda x: x["label"])
    pairs = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    return ranked.select("node", F.explode(pairs).alias("bucket"))


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` (nodes) whose texts are as similar as asked, with ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            x, y = batch.column("x"), batch.column("y")
            sims = np.array([edit_similarity(x[k].values.to_numpy(), y[k].values.to_numpy(), least) for k in range(batch.num_rows)])
            keep = pa.array(np.flatnonzero(sims > 0))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(sims[sims > 0], pa.float64())], ["a", "b", "similarity"])

    x = texts.select(F.col("node").alias("a"), F.col("words").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similarity double")


def signature(words_of: np.ndarray) -> bytes:
    """A bit for each of a text's words, labelled with how often it stood there before."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (12 * len(words_of) - 1).bit_length()))
    marked = np.zeros(bits, bool)
    marked[(labels(words_of.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marked).tobytes()


def _folded(marks: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of 64-bit numbers, the longer ones folded to ``size`` bytes."""
    rows = []
    for x in marks:
        row = np.frombuffer(x, np.uint64)
        while len(row) * 8 > size:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


def block_pairs(outside: list[tuple], members: list[tuple], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """The pairs ``(a, b)`` of two blocks' texts in different components that lengths and signatures allow to be similar.

    A text is ``(node, root, in the largest component, words, signature, lesser buckets)``. No more words are common to two texts than
    bits, and words of the one whose bit another has too. Two texts outside the largest component meet twice and are given
    once, and two that share several buckets are given in the least alone.
    """
    if not outside or not members:
        return []
    nodes, roots, largest, sizes = (np.array(x) for x in list(zip(*members, strict=True))[:4])
    lesser = [m[5] for m in members]
    length = min(len(x[4]) for x in (*outside, *members))
    theirs, mine = _folded([x[4] for x in members], length), _folded([x[4] for x in outside], length)
    spare = sizes - np.bitwise_count(theirs).sum(axis=1, dtype=np.int64)
    out = []
    for (node, root, _, size, _, before), own in zip(outside, mine, strict=True):
        most = np.maximum(sizes, size) * (1 - least) + 1e-9
        at = np.flatnonzero((roots != root) & (largest | (node < nodes)) & (np.abs(sizes - size) <= most))
        if not len(at):
            continue
        common = np.bitwise_count(theirs[at] & own).sum(axis=1, dtype=np.int64)
        common += np.minimum(spare[at], size - int(np.bitwise_count(own).sum()))
        near = np.maximum(sizes[at], size) - common <= most[at]
        known = set(before)
        out += [(min(node, b), max(node, b)) for k, b in zip(at[near].tolist(), nodes[at[near]].tolist(), strict=True) if known.isdisjoint(lesser[k])]
    return out


def _block_pairs(placed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` between different components within each bucket of ``placed`` (``bucket, node, root, largest``).

    A bucket's texts are dealt by length into classes, of which only neighbours hold texts that may be similar, and these
    into blocks of about BLOCK texts; those outside the largest component are dealt into blocks of their own. Each pair of
    blocks is a row of signatures, so the rows are far fewer than the pairs and none is unbounded; no text travels here.
    """
    size_class = F.floor(F.log(F.col("size")) / math.log(1 / least) + 1e-9).cast("int").alias("class")
    signed = texts.select("node", "size", "signature").join(placed.groupBy("node").agg(F.collect_set("bucket").alias("_all")), "node")
    light = placed.join(texts.select("node", size_class), "node").withColumn("_in", F.col("root") == F.col("largest"))
    parts = gathered(light, ["bucket", "class"], "node", ["node", "root", "_in"], math.isqrt(placed.count()) + 1)
    outs = F.sum(F.size(F.filter("_rows", lambda x: ~x["_in"])))
    sizes = parts.groupBy("bucket", "class").agg(F.ceil(F.sum(F.size("_rows")) / BLOCK).alias("_blocks"), F.ceil(outs / BLOCK).alias("_out_blocks"))
    light = cut(spread(parts.join(sizes, ["bucket", "class"])))
    entry = F.struct("node", "root", F.col("_in").alias("largest"), "size", "signature", F.filter("_all", lambda x: x < F.col("bucket")).alias("lesser"))
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    members = light.select("bucket", "class", "node", "root", "_in", block("_blocks").alias("block")).join(signed, "node").groupBy("bucket", "class", "block").agg(F.collect_list(entry).alias("members"))
    out_rows = light.filter(~F.col("_in")).select("bucket", "class", "node", "root", "_in", block("_out_blocks").alias("_block"))
    outside = out_rows.join(signed, "node").groupBy("bucket", "class", "_block").agg(F.collect_list(entry).alias("outside"))
    # Sent to each block of the bucket's like lengths by name, so that the pairs of one bucket are spread over many tasks.
    counts = light.select("bucket", "class", "_blocks").distinct()
    sent = outside.select("bucket", "outside", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class")).join(counts, ["bucket", "class"])
    sent = sent.select("bucket", "class", "outside", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(column: pa.Array, k: int) -> list[tuple]:
            x = column[k].values
            return list(zip(*(x.field(i).to_pylist() for i in range(6)), strict=True))

        for batch in batches:
            found = [pair for k in range(batch.num_rows) for pair in block_pairs(read(batch.column("outside"), k), read(batch.column("members"), k), least)]
            columns = zip(*found, strict=True) if found else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])

    return sent.join(members, ["bucket", "class", "block"]).select("outside", "members").mapInArrow(run, "a bigint, b bigint").distinct()


def _words_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, size, words (32-bit), signature`` of the given nodes, each from one of its documents."""
    first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [text_words(x) for x in strings(batch, "text")]
            nodes = batch.column("node").to_pylist()
            # A repeated doc_id brings other texts too.
            keep = [k for k, (h, node) in enumerate(zip(hashes, nodes, strict=True)) if text_node(h) == node]
            found = [hashes[k].astype(np.uint32).view(np.int32) for k in keep]
            columns = [pa.array([nodes[k] for k in keep], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array([signature(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "words", "signature"])

    return docs.select("doc_id", "text").join(first, "doc_id").mapInArrow(run, "node bigint, size int, words array<int>, signature binary").dropDuplicates(["node"])


def find_links(docs: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` that join all different texts which candidates and verification bring together, few for each.

    Texts that share a sketch, or short ones that share a pair of their rarest words, are candidates. First each text of
    a bucket is verified against the bucket's two leaders, its least and greatest node, so that a bucket costs two pairs a
    text. Then the components so found are looked at again: in a bucket with more than one, the texts outside the largest
    are compared, block by block, with all texts of other components by length and signature, and what passes is verified.
    Pairs within one component need no verifying, so no link between components is lost and a bucket of thousands of
    copies is never paired with itself.
    """
    texts = rows.filter(F.size("sketches") > 0).select("node", "sketches").dropDuplicates(["node"])
    short = rows.filter(F.size("labels") > 0).select("node", "labels").dropDuplicates(["node"])
    buckets = texts.select("node", F.explode("sketches").alias("bucket")).union(short_buckets(short, least))
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter(F.col("low") < F.col("high"))
    shared = cut(buckets.join(leaders, "bucket"))  # rows of buckets with two texts or more
    to_leader = F.explode(F.array("low", "high")).alias("leader")
    pairs = shared.select("node", to_leader).filter(F.col("node") != F.col("leader")).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    members = shared.select("node").distinct()
    texts = cut(_words_of(members, rows, docs))
    known = cut(_verify(pairs, texts, least)).select("a", "b")
    roots = components(known)
    placed = shared.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots"))
    placed = cut(placed.join(mixed.filter(F.col("roots") > 1).select("bucket", "largest"), "bucket"))
    more = cut(_verify(_block_pairs(placed, texts, least), texts, least))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {x.lower() for x in df.columns}:
        name += "_"
    return name


def group(docs: DataFrame, least: float = SIMILARITY, rows: DataFrame | None = None) -> DataFrame:
    """The near-duplicate class of every row: ``doc_id, class_id, class_size, keep``.

    ``class_id`` is the least doc_id of the class, ``keep`` marks that document's row. Exact copies (equal words in any
    case and spacing) are one text; texts of fewer than LEAST_WORDS words have no other near-duplicates than copies. A null
    text or one without words is a class of its own, as is a row with a null doc_id (its class_id is null, and it is
    kept, as no id could name it). Repeated rows are copies. Very long texts are taken whole. An empty table gives no row.
    Extra columns, whatever their names, play no part.
    """
    rows = cut(sketched(docs, least)) if rows is None else rows
    named = rows.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    roots = components(find_links(docs, named, least))
    # Counted by text before classes are put together, so copies are summed where they lie.
    texts = named.groupBy("node").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = texts.groupBy("root").agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("class_size"))
    of_text = texts.join(classes, "root").select("node", "class_id", "class_size")
    # A row without a text or an id has no partner; each has a key of its own, so that none of them gather.
    none = F.col("node").isNull() | F.col("doc_id").isNull()
    keyed = rows.select("doc_id", "node", F.when(none, F.monotonically_increasing_id()).otherwise(F.col("node")).alias("_key"), none.alias("_none"))
    found = keyed.join(of_text.withColumnRenamed("node", "_key"), "_key", "left")
    own = F.col("_none") | F.col("class_size").isNull()
    return found.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (own | (F.col("doc_id") == F.col("class_id"))).alias("keep"),
        "node",
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate class, with all its columns: the one with the least doc_id.

    Rows with a null doc_id are all kept. Of a repeated doc_id the rows are told apart by their text, and of equal rows
    one is kept. Null and empty texts are kept, very long ones taken whole; an empty table gives none. Extra columns,
    whatever their names, stay as they are.
    """
    rows = cut(sketched(docs, least))
    found = cut(group(docs, least, rows))
    repeated = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("doc_id")
    dropped = found.filter(~F.col("keep")).select("doc_id")
    single = docs.join(dropped.union(repeated), "doc_id", "left_anti").select(*docs.columns)
    if not repeated.head(1):
        return single
    # Rows whose doc_id stands there more than once are told apart by their text.
    schema = docs.schema
    names = schema.names
    node, by_id, by_node = (_fresh(docs, x) for x in ("_node", "_id", "_kept"))

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes = [text_node(text_words(x)) for x in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], schema=batch.schema.append(pa.field(node, pa.int64())))

    several = docs.join(repeated, "doc_id", "left_semi").select(*names).mapInArrow(with_node, T.StructType([*schema.fields, T.StructField(node, T.LongType())]))
    kept = found.filter("keep").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias(by_id), F.col("node").alias(by_node)).distinct()
    several = several.join(kept, (F.col(by_id) == F.col("doc_id")) & F.col(node).eqNullSafe(F.col(by_node))).dropDuplicates(["doc_id", node])
    return single.union(several.select(*names))
