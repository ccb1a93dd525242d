"""URL filters: a trie over reversed host labels and path prefixes, longest match first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits the host and its subdomains if the url's path starts with the rule's path.
CONTRACT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Host labels of link farms under the public example domains; consulted when no rule above fits.
FARM_RULES = tuple(("block", f"{label}.example.{top}", "") for label in ("spam-farm", "casino-win", "free-bets") for top in ("com", "net", "org"))
#: A table of at most so many rules is broadcast as a trie; a larger one is joined.
MAX_RULES = 100_000
#: Characters of a rule's path by which a larger table is joined.
KEY_CHARS = 8


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, each node's ``None`` entry a trie of path segments.

    Path nodes are keyed by whole segments. A rule's last segment may be only the beginning of the url's, so a node's
    ``None`` entry holds the last ones with their lengths, the longest first. Of rules with one host and path the last holds.
    """
    root: dict = {}
    nodes: dict[int, dict] = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        tails, _ = node.setdefault(None, ({}, []))
        tails[tail] = (host + path, verdict)
        nodes[id(node)] = node
    for node in nodes.values():
        tails, lengths = node[None]
        lengths[:] = sorted({len(x) for x in tails}, reverse=True)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: most host labels, then the longest path."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        if None in node and (found := _path_match(node[None], path)):
            best = found
        if label not in node:
            return best
        node = node[label]
    return (None in node and _path_match(node[None], path)) or best


def _path_match(node: dict, path: str) -> tuple[str, str] | None:
    """In steps that grow with the path, not with the number of rules."""
    best = None
    for segment in path.split("/"):
        if None in node:
            tails, lengths = node[None]
            size = next((n for n in lengths if n <= len(segment) and segment[:n] in tails), None)
            if size is not None:
                best = tails[segment[:size]]
        if segment not in node:
            return best
        node = node[segment]
    return best


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url_host, url_path, rule, verdict`` of the distinct urls (``host, path``) that a rule of the table fits.

    The way for a table of any size: each url is looked up under every end of its host and the first KEY_CHARS characters
    of its path or fewer, a rule stands under its host and as much of its path; the longest that fits holds.
    """
    kept = rules.select("verdict", F.col("host").alias("_host"), F.col("path").alias("_path")).filter("_host IS NOT NULL AND _path IS NOT NULL")
    keyed = kept.withColumn("_key", F.substring("_path", 1, KEY_CHARS))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = F.transform(F.sequence(F.lit(0), F.least(F.lit(KEY_CHARS), F.length("path"))), lambda k: F.substring(F.col("path"), F.lit(1), k))
    asked = urls.select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.explode(ends).alias("_host"), keys.alias("_keys"))
    asked = asked.select("url_host", "url_path", "_host", F.explode("_keys").alias("_key"))
    fits = asked.join(keyed, ["_host", "_key"]).filter(F.startswith("url_path", "_path"))
    first = F.struct(F.length("_host"), F.length("_path"), "verdict")
    return fits.groupBy("url_host", "url_path").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), "verdict"), first).alias("_best")).select("url_host", "url_path", "_best.rule", "_best.verdict")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased) and path (up to ``?`` or ``#``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules=CONTRACT_RULES, further=FARM_RULES, default: str = "allow") -> DataFrame:
    """Judge every row's ``url``; one row each with ``page_id, host, path, rule, verdict, listed``.

    ``rule`` is the longest of ``rules`` that fits, else null; its verdict holds. Where none fits, the longest of
    ``further`` decides (``listed``), else ``default``. A null url or one without ``://`` has an empty host and path,
    so only ``default`` applies; very long urls are taken whole. Repeated rows give equal rows, a null page_id stays null,
    and an empty table gives none. Extra columns, whatever their names, play no part.

    ``rules`` may be a table (``verdict, host, path``; rows with a null host or path fit nothing, and of two verdicts for
    one host and path the later in the alphabet holds). It is broadcast as a trie up to MAX_RULES rows and joined beyond.
    """
    host, path = split_url(F.col("url"))
    joined = None
    if isinstance(rules, DataFrame):
        if len(rules.select("verdict").limit(MAX_RULES + 1).collect()) > MAX_RULES:
            urls = pages.select(host.alias("host"), path.alias("path")).distinct()
            joined, rules = join_rules(urls, rules), ()
        else:
            rules = sorted(tuple(r) for r in rules.select("verdict", "host", "path").collect() if r.host is not None and r.path is not None)
    elif len(rules) > MAX_RULES:
        raise ValueError("give so many rules as a table")
    tries = pages.sparkSession.sparkContext.broadcast((build_trie(rules), build_trie(further)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tries.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            out = []
            for h, p in zip(hosts, paths, strict=True):
                hit = longest_match(first, h, p)
                more = None if hit else longest_match(second, h, p)
                out.append((hit[0] if hit else None, (hit or more or (None, default))[1], more[0] if more else None))
            rule, verdict, listed = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), *(pa.array(x, pa.string()) for x in (rule, verdict, listed))],
                ["page_id", "host", "path", "rule", "verdict", "listed"],
            )

    # The id keeps its own type.
    kind = pages.schema["page_id"].dataType.simpleString()
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string, listed string"
    )
    if joined is None:
        return judged
    best = joined.select(F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    return judged.drop("rule").join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_rule").alias("rule"), F.coalesce("_verdict", "verdict").alias("verdict"), F.when(F.col("_rule").isNull(), F.col("listed")).alias("listed")
    )
