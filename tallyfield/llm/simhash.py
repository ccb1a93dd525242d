"""Document fingerprints: SimHash by weighted votes on 64 signed bits, and Hamming search by permuted block tables.

DataFrame functions only. The 64 votes are summed as 32 longs of two 32-bit lanes, bit i in the low lane and bit i + 32
in the high one, so a text may weigh up to 2**32 - 1 (over 300 million words).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 64
#: A term counts by its length in code points, as short words are the common ones that any text has, up to this, so that
#: no single long string outvotes a text.
MAX_WEIGHT = 12
RADIUS = 3
#: Blocks of the permuted tables; each table keys on all but RADIUS of them.
BLOCKS = 6
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def vote(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, the ``fingerprint`` (long) of the texts under each key and their number ``times``; without a term it is 0.

    Terms are runs of other characters than white space. Rows of one key vote together, so alike rows vote as one does.
    """
    terms = texts.select(*keys, F.posexplode(F.split(F.col(text), r"\s+")).alias("_at", "_term"))
    first = F.when(F.col("_at") == 0, 1).otherwise(0).cast("long").alias("_first")
    weighed = terms.select(*keys, first, F.xxhash64("_term").alias("_hash"), F.least(F.length("_term"), F.lit(MAX_WEIGHT)).cast("long").alias("_weight"))
    lanes = [F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(_long(_LANES)) * F.col("_weight")).alias(f"_{i}") for i in range(32)]
    sums = weighed.groupBy(*keys).agg(F.sum("_weight").alias("_all"), F.sum("_first").alias("times"), *lanes)
    bits = F.lit(0).cast("long")
    for i in range(32):
        for lane, place in ((F.col(f"_{i}").bitwiseAND(_long(_LOW)), i), (F.shiftrightunsigned(F.col(f"_{i}"), 32), i + 32)):
            bits = bits.bitwiseOR(F.when(lane * 2 > F.col("_all"), _long(1 << place)).otherwise(_long(0)))
    return sums.select(*keys, bits.alias("fingerprint"), "times")


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as ``times`` says, which goes."""
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits (0 to 1)."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def neighbours(queries: DataFrame, all_fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of different rows' fingerprints within ``radius`` bits: ``query, found`` (longs, both distinct).

    Both inputs have distinct longs in ``fingerprint``. Two fingerprints within the radius agree in all but ``radius`` of
    the ``blocks`` blocks at least, so they meet in the table that keys on those; each pair is given by the first table
    in which it meets, so no pair comes twice and no distinct-step is needed. A null fingerprint finds nothing.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be smaller than the number of blocks")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    kept = list(combinations(range(blocks), blocks - radius))
    tables = [sum(masks[k] for k in t) for t in kept]
    first = [next((n for n, t in enumerate(kept) if not any(differ >> k & 1 for k in t)), -1) for differ in range(1 << blocks)]

    def spread(df: DataFrame, name: str) -> DataFrame:
        keyed = F.array(*[F.struct(F.lit(n).alias("t"), F.col("fingerprint").bitwiseAND(_long(m)).alias("key")) for n, m in enumerate(tables)])
        return df.select(F.col("fingerprint").alias(name), F.explode(keyed).alias("_k")).select(name, "_k.t", "_k.key")

    q, a = spread(queries, "query"), spread(all_fingerprints, "found")
    xor = q["query"].bitwiseXOR(a["found"])
    differ = sum((F.when(xor.bitwiseAND(_long(m)) != 0, 1 << k).otherwise(0) for k, m in enumerate(masks)), F.lit(0))
    meets = F.element_at(F.array(*map(F.lit, first)), differ + 1) == q["t"]
    return q.join(a, (q["t"] == a["t"]) & (q["key"] == a["key"]) & (F.bit_count(xor) <= radius) & meets).select("query", "found")


def successors(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id`` in descending order of distinct ids, the first after the last.

    Ids alone are range-partitioned; within a partition the next is one row on, and what follows a partition's last id
    is read from the partitions' greatest ids. No partition holds all ids. Where each id lies is saved before it is used
    twice, as range bounds may differ when a lost partition is dealt again.
    """
    dealt = ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    dealt = cut(dealt.repartitionByRange(F.col("doc_id").desc()).withColumn("_part", F.spark_partition_id()))
    # One row a partition, so these windows hold the number of partitions.
    ends = dealt.groupBy("_part").agg(F.max("doc_id").alias("_top"))
    over = Window.orderBy("_part")
    ends = ends.select("_part", F.coalesce(F.lead("_top").over(over), F.max("_top").over(Window.partitionBy())).alias("_after"))
    inner = F.lead("doc_id").over(Window.partitionBy("_part").orderBy(F.col("doc_id").desc()))
    return dealt.withColumn("_next", inner).join(ends, "_part").select("doc_id", F.coalesce("_next", "_after").alias("next_id"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprint every row's whole text: ``doc_id, fingerprint (long), n_chars``; a null text is the empty one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_same"), F.length(text).cast("long").alias("n_chars"))
    return repeated(vote(rows, ["doc_id", "_same", "n_chars"])).drop("_same")


def _prints(rows: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, with the latter's SHA-256."""
    half = F.floor(F.col("n_chars") / 2)
    own = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = rows.withColumn("edited", F.concat(own, F.substring(F.col("_lent"), F.lit(1), half.cast("int"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited"))])
    both = edited.select("doc_id", "_same", "n_chars", F.unhex(F.sha2("edited", 256)).alias("_sha"), F.explode(kinds).alias("_t")).select("doc_id", "_same", "n_chars", "_sha", F.col("_t.kind").alias("_kind"), F.col("_t.text").alias("text"))
    return (
        vote(both, ["doc_id", "_same", "n_chars", "_sha", "_kind"])
        .groupBy("doc_id", "_same", "n_chars", "_sha")
        .agg(*[F.max(F.when(F.col("_kind") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("fp", "edited_fp"))], F.max("times").alias("times"))
    )


def compare_edited(docs: DataFrame, radius: int = RADIUS, query_modulus: int = 100) -> DataFrame:
    """Fingerprint each row's text and the text edited with the next document's beginning.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_rows``. The edit:
    the last floor(n_chars / 2) code points give way to the first as many (or all) of the next document's, by descending
    doc_id, the first after the last. ``near_rows``: for ids divisible by ``query_modulus``, how many other rows of the
    whole table have a fingerprint within ``radius`` bits; null for other ids.

    A null text is the empty one. A single document is its own next. Rows with one doc_id are one place in the order,
    and there the text with the least hash stands for them; repeated rows give a row each. A null doc_id has no next
    document: nothing is put in, and ``near_next`` is null. Very long texts are taken whole (see above for how long). An
    empty table gives no row. Extra columns, whatever their names, play no part.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_same"), F.length(text).cast("long").alias("n_chars"))
    # Texts are shuffled once: both joins below read the same rows with the same columns by doc_id.
    placed, unplaced = rows.filter(F.col("doc_id").isNotNull()), rows.filter(F.col("doc_id").isNull())
    order = successors(docs)
    half = F.floor(F.col("n_chars") / 2)
    # What each document lends to the one before it, no longer than that one can take.
    needs = placed.groupBy("doc_id").agg(F.max(half).cast("int").alias("_need")).join(order, "doc_id")
    needs = needs.select(F.col("doc_id").alias("_before"), F.col("next_id").alias("doc_id"), "_need")
    lent = (
        placed.join(needs, "doc_id")
        .select(F.col("_before").alias("doc_id"), F.substring(F.col("text"), F.lit(1), F.least("_need", F.col("n_chars").cast("int"))).alias("_lent"), F.col("_same").alias("_by"))
        .groupBy("doc_id")
        .agg(F.min_by("_lent", "_by").alias("_lent"))
    )
    prints = _prints(placed.join(lent, "doc_id")).union(_prints(unplaced.withColumn("_lent", F.lit(""))))
    prints = cut(prints)  # read four times below
    following = prints.groupBy("doc_id").agg(F.min_by("fp", "_same").alias("next_fp"))
    following = following.join(order.withColumnRenamed("doc_id", "_before"), F.col("doc_id") == F.col("next_id")).select(F.col("_before").alias("doc_id"), "next_fp")
    counted = prints.groupBy("fp").agg(F.sum("times").alias("_rows"))
    is_query = F.coalesce(F.col("doc_id") % query_modulus == 0, F.lit(False))
    queries = prints.filter(is_query).select(F.col("fp").alias("fingerprint")).distinct()
    near = neighbours(queries, counted.select(F.col("fp").alias("fingerprint")), radius)
    near = near.join(counted, F.col("found") == F.col("fp")).groupBy("query").agg((F.sum("_rows") - 1).alias("_near"))
    both = prints.join(following, "doc_id", "left")
    # Only the queries are joined: the other rows have no key to meet under.
    asked = both.filter(is_query).join(near.withColumnRenamed("query", "fp"), "fp", "left")
    others = both.filter(~is_query).withColumn("_near", F.lit(None).cast("long"))
    return repeated(asked.unionByName(others)).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("_near").alias("near_rows"),
    )
