"""Merkle manifest: a tree of digests over each source's documents and one over the sources, with proofs.

H is the SHA-256 of its inputs one after the other, in lowercase hex; digests go in as hex text. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 5
#: Rows for each task at least, so that the upper levels, of ever fewer rows, are few tasks.
TASK_ROWS = 20_000


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[c]) for c in FIELDS])


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``group`` by ``order``, and ``n``, how many the group has.

    Rows are range-partitioned by group and order, so a hot group lies in many tasks; a place is that within the task's
    part of the group and what the group has in the parts before. Where each row lies is saved before it is counted.
    Equal rows may take each other's places; the last key deals them over parts.
    """
    keys = [group, *order]
    dealt = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = cut(dealt.repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id()))
    tasks = _tasks(dealt.count())
    dealt = dealt.coalesce(tasks)
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows")).coalesce(tasks)
    of_group = Window.partitionBy(group)  # a row a part
    before = F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of_group).alias("n")).coalesce(tasks)
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_tie"))
    found = dealt.withColumn("_at", inner).join(parts, [group, "_part"]).coalesce(tasks)
    return found.withColumn("idx", F.col("_before") + F.col("_at") - 1).drop("_tie", "_part", "_at", "_before")


def parents(nodes: DataFrame, tasks: int, arity: int = ARITY) -> DataFrame:
    """``group, run, n, children``: each run of ``arity`` consecutive nodes (``group, idx, n, digest``), children in order.

    A sibling-shift self-join: the node in slot zero of a run computes the places of its siblings (its own plus each slot
    offset, or by XOR with 1 for pairs), these meet the nodes that lie there, and slot zero's row emits the parent.
    """
    first = nodes.filter(F.col("idx") % arity == 0).select("group", "idx", "n")
    places = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long"))) if arity == 2 else F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda d: F.col("idx") + d)
    wanted = first.select("group", "n", F.explode(places).alias("idx")).filter(F.col("idx") < F.col("n")).select("group", "idx")
    shifted = nodes.filter(F.col("idx") % arity != 0).join(wanted, ["group", "idx"]).coalesce(tasks)
    met = nodes.filter(F.col("idx") % arity == 0).select("group", "idx", "n", "digest").union(shifted.select("group", "idx", "n", "digest"))
    run = F.floor(F.col("idx") / arity).cast("long").alias("run")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    return met.groupBy("group", run, "n").agg(listed.alias("children")).coalesce(tasks)


def siblings(children: Column, slot: Column) -> Column:
    """What the run has before and after a slot, each as one text."""
    rest = F.slice(children, slot + 2, F.greatest(F.size(children) - slot - 1, F.lit(0)))
    return F.struct(F.array_join(F.slice(children, F.lit(1), slot), "").alias("before"), F.array_join(rest, "").alias("after"))


def tree(leaves: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """The tree of each group over ``group, idx, n, digest``: ``roots`` (group, root) and ``runs`` of the leaves.

    ``runs``: group, run, children (the digests of the run) and path (before and after of each ancestor, from the run's own
    node up), for groups of two leaves or more. While a group has several nodes, each run of ``arity`` of them, the last
    one even of one node, becomes their H. Levels are as many as the largest group's logarithm; each is a few equi-joins
    of ever fewer rows, by group and place.
    """
    # How many nodes of groups with several each level has.
    reach = [arity**k for k in range(64) if arity**k < 1 << 63]
    nodes_of = [F.sum(F.when(F.col("n") > p, F.ceil(F.col("n") / p))).alias(f"_{k}") for k, p in enumerate(reach)]
    counts = [c for c in leaves.filter(F.col("idx") == 0).agg(*nodes_of).first() if c]
    nodes, levels, roots = leaves, [], leaves.filter(F.col("n") == 1).select("group", F.col("digest").alias("root"))
    for rows in counts:
        runs = cut(parents(nodes.filter(F.col("n") > 1), _tasks(rows), arity))
        levels.append((runs, _tasks(rows)))
        nodes = runs.select("group", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), digest(F.array_join("children", "")).alias("digest"))
        roots = roots.union(nodes.filter(F.col("n") == 1).select("group", F.col("digest").alias("root")))
    none = F.array().cast("array<struct<before:string,after:string>>")
    below = None
    for runs, tasks in reversed(levels):
        top = runs.filter(F.col("n") <= arity).select("group", "run", "children", none.alias("path"))
        if below is not None:
            # The path of a run's own node: its siblings in the run above, then that one's path.
            above = below.select("group", F.col("run").alias("_up"), F.col("children").alias("_others"), F.col("path").alias("_path"))
            lower = runs.filter(F.col("n") > arity).withColumn("_up", F.floor(F.col("run") / arity).cast("long")).join(above, ["group", "_up"]).coalesce(tasks)
            own = siblings(F.col("_others"), (F.col("run") % arity).cast("int"))
            top = top.union(lower.select("group", "run", "children", F.concat(F.array(own), "_path").alias("path")))
        below = top
    if below is None:
        below = leaves.filter("false").select("group", F.col("idx").alias("run"), F.array("digest").alias("children"), none.alias("path"))
    return roots, below


def folded(start: Column, path: Column) -> Column:
    """The root that a node's digest and its siblings' give, level by level."""
    return F.aggregate(path, start, lambda acc, x: digest(x["before"], acc, x["after"]))


def proof(path: Column) -> Column:
    """H of all siblings from the leaf's run to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def manifest(docs: DataFrame, arity: int = ARITY, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """Each row's leaf, its source's and the whole table's digest, its proof, and whether its present text folds to the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. A leaf is H of the FIELDS, each with its byte
    count. Of a source, leaves ascend by doc_id (null first), rows of one doc_id by leaf; equal rows are leaves of their
    own. Sources ascend by their UTF-8 bytes, null first; an empty source is another than null. Rows whose crc32 of
    doc_id is divisible by ``modulus`` are read as tampered with: A-Z of their text are lower-cased; a null doc_id's are
    not. Null and empty fields differ, and very long texts are hashed whole. An empty table gives no row. Extra columns,
    whatever their names, play no part.
    """
    own = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    changed = own | {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}
    # One key for each source that sorts as they do: null before the empty one.
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group")
    rows = docs.select("doc_id", group, leaf(own).alias("leaf"), F.when(tampered, leaf(changed)).alias("_changed"))
    placed = cut(numbered(rows, "group", ["doc_id", "leaf"]))
    subroots, runs = tree(placed.select("group", "idx", "n", F.col("leaf").alias("digest")), arity)
    sources = cut(numbered(subroots.withColumn("_every", F.lit("")), "_every", ["group"]))
    roots, tops = tree(sources.select(F.lit("").alias("group"), "idx", "n", F.col("root").alias("digest")), arity)
    whole = roots.first()
    # The path of each source's subroot on a row a source; the root is one value.
    up = F.floor(F.col("idx") / arity).cast("long")
    upper = sources.select(F.col("group").alias("source_group"), F.col("root").alias("subroot"), F.col("idx").alias("_at"), up.alias("run"))
    upper = upper.join(tops.select("run", "children", "path"), "run", "left").withColumn("root", F.lit(whole and whole["root"]).cast("string"))
    slot = (F.col("_at") % arity).cast("int")
    none = F.array().cast("array<struct<before:string,after:string>>")
    of_source = F.when(F.col("children").isNull(), none).otherwise(F.concat(F.array(siblings(F.col("children"), slot)), "path"))
    upper = cut(upper.select(F.col("source_group").alias("group"), "subroot", "root", of_source.alias("_top")))
    # A run's path and its source's are put together before the leaves meet them, a sixteenth of the rows.
    several = placed.filter(F.col("n") > 1).withColumn("run", F.floor(F.col("idx") / arity).cast("long"))
    met = several.join(runs.join(upper, "group").withColumn("_path", F.concat("path", "_top")).drop("path", "_top"), ["group", "run"])
    met = met.withColumn("_path", F.concat(F.array(siblings(F.col("children"), (F.col("idx") % arity).cast("int"))), "_path"))
    lone = placed.filter(F.col("n") == 1).join(upper, "group").withColumn("_path", F.col("_top"))
    kept = ["doc_id", "leaf", "_changed", "subroot", "root", "_path"]
    found = met.select(*kept).union(lone.select(*kept)).withColumn("folded_root", folded(F.coalesce("_changed", "leaf"), F.col("_path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("_path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
