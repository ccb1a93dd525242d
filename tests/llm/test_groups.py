"""SimHash groups, the Merkle manifest and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import merkle, queries, simhash_groups, spelling
from tallyfield.llm.common import table
from tests.compare import spark_rows, sql_rows


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# SimHash groups


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    """The least id reachable from each of ``(id, fingerprint)`` by links of all pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def got_groups(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_text_fingerprint_is_the_plain_one_for_texts_of_all_sizes(monkeypatch):
    r = random.Random(3)
    texts = ["", None, " \t\n", "one", "One two", "a b c", "É é ß\x0bx", "x" * 5000] + [" ".join(r.choice("ab cd\xa0e Fg hIj \x85 Üx".split(" ")) for _ in range(r.randint(1, 700))) for _ in range(30)]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(simhash_groups, "_PIECE", piece)
        for text in texts:
            assert simhash_groups.text_fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_simhash_query_gives_the_components_of_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    assert got_groups(queries.op11_simhash_dedup(spark, sf_dir)) == plain_groups(rows)


@pytest.mark.parametrize("partitions", [None, 1, 3])
def test_links_join_all_fingerprints_within_the_radius(spark, monkeypatch, partitions):
    """Chains, a hub of thousands of neighbours and correlated bits, for every number of partitions."""
    r = random.Random(5)
    found = {r.getrandbits(64) for _ in range(300)}
    for f in list(found)[:120]:
        for _ in range(3):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            found.add(f)
    hub = r.getrandbits(64)
    found |= {hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} if partitions is None else {hub ^ (1 << a) for a in range(64)}
    found |= {(r.getrandbits(32) * 0x100000001) for _ in range(100)}
    rows = [(k, f) for k, f in enumerate(sorted(found))]
    if partitions:
        monkeypatch.setattr(simhash_groups, "partition_count", lambda n, radius: partitions)
        monkeypatch.setattr(simhash_groups, "BLOCK", 100)
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in rows]
    got = simhash_groups.links(spark.createDataFrame(signed, "fingerprint bigint"), len(rows)).collect()
    root = {f: f for _, f in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x in got:
        a, b = sorted((find(x["a"] % (1 << 64)), find(x["b"] % (1 << 64))))
        root[b] = a
    least = {}
    for k, f in rows:
        least.setdefault(find(f), k)
    assert sorted(((k, f"{f:016x}", least[find(f)]) for k, f in rows), key=str) == plain_groups(rows)
    if partitions is None:
        pairs = sum((a ^ b).bit_count() <= 3 for k, (_, a) in enumerate(rows) for _, b in rows[:k])
        assert len(got) < pairs / 4  # links, not the pairs of the hub's two thousand neighbours


def test_allocation_is_the_cheapest_of_all():
    r = np.random.default_rng(2)
    costs = r.random((40, 4, 5)) * np.array([0, 1, 3, 9, 30])
    got = simhash_groups.allocate(costs, 0)
    from itertools import product

    for row, t in zip(costs, got, strict=True):
        cost = lambda ts, row=row: sum(row[p, t + 1] for p, t in enumerate(ts))
        assert t.sum() == 0
        assert cost(t) == pytest.approx(min(cost(ts) for ts in product(range(-1, 4), repeat=4) if sum(ts) == 0))


def test_a_frequent_value_of_a_partition_is_not_asked_for():
    """A value that most fingerprints have costs most candidates, so others of its partitions take wider thresholds."""
    values, counts = np.array([0], np.uint64), np.array([10**6])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    parts = [list(range(16 * p, 16 * p + 16)) for p in range(4)]
    t = simhash_groups.allocate(simhash_groups._estimates(np.array([0x123456789ABC0000, 0x123456789ABCDEF0], np.uint64), parts, [(values, counts), none, none, none], 2 * 10**6, 3), 0)
    assert t[0, 0] == -1
    assert t[1].tolist() != t[0].tolist() and t[1, 0] >= 0


def test_bits_that_repeat_each_other_share_a_partition():
    r = np.zeros((64, 64))
    for a, b in ((3, 40), (5, 63), (17, 22)):
        r[a, b] = r[b, a] = 0.9
    parts = simhash_groups.group_bits(r, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert {len(p) for p in parts} == {16}
    for a, b in ((3, 40), (5, 63), (17, 22)):
        assert any(a in p and b in p for p in parts)


def test_more_fingerprints_take_fewer_and_wider_partitions():
    counts = [simhash_groups.partition_count(10**k) for k in range(1, 11)]
    assert counts == sorted(counts, reverse=True)
    assert counts[0] == 4 and counts[-1] <= 2


def test_simhash_edge_cases(docs, spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = docs([(7, None), (3, ""), (9, "A b C"), (5, "a B c"), (5, "a B c"), (None, "a b c"), (None, "none else has this"), (1, long), (2, long + " end")])
    got = got_groups(simhash_groups.group(rows))
    assert got == plain_groups([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows.collect()])
    assert {(i, c) for i, _, c in got} >= {(7, 3), (3, 3), (9, 5), (None, 5), (None, None), (2, 1)}
    assert simhash_groups.group(docs([])).collect() == []


# Merkle manifest


def plain_manifest(rows, arity=16):
    def h(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return h("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def tree(leaves):
        """The root, and for each leaf the before and after of every level."""
        paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(level) > 1:
            for k, p in enumerate(paths):
                run, slot = divmod(at[k], arity)
                own = level[run * arity : run * arity + arity]
                p.append(("".join(own[:slot]), "".join(own[slot + 1 :])))
                at[k] = run
            level = [h("".join(level[k : k + arity])) for k in range(0, len(level), arity)]
        return level[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, found = [], {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in own])
        subroots.append(root)
        found[s] = list(zip(own, paths, strict=True))
    out = []
    if subroots:
        root, tops = tree(subroots)
        for s, sub, top in zip(sources, subroots, tops, strict=True):
            for r, path in found[s]:
                now = dict(r)
                if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                    now["text"] = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), r["text"])
                fold = leaf(now)
                for before, after in path + top:
                    fold = h(before + fold + after)
                proof = h("".join(b + a for b, a in path + top))
                out.append((r["doc_id"], leaf(r), sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def got_manifest(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_query_is_the_plain_tree_and_its_sql(spark, sf_dir):
    got = got_manifest(queries.op12_merkle_manifest(spark, sf_dir))
    assert got == plain_manifest(rows_of(table(spark, sf_dir, "documents")))
    assert 0 < sum(not r[-1] for r in got) < len(got)
    assert spark_rows(queries.op12_merkle_manifest(spark, sf_dir)) == sql_rows(sf_dir, queries.oracle_sql()["op12_merkle_manifest"])


@pytest.mark.parametrize("arity", [2, 16])
def test_manifest_of_uneven_sources(spark, arity):
    """Lone leaves, runs of one, a hot source of many levels, null and empty sources, repeated rows."""
    r = random.Random(6)
    sizes = {"hot": 300, "b": 17, "c": 16, "d": 1, "é": 33, "": 2, None: 5} | {f"s{k}": r.randint(1, 4) for k in range(30)}
    rows = [(r.randrange(200), None if r.random() < 0.1 else "Text Ä " + "X" * r.randrange(4), r.choice(["en", None]), s, r.choice([5, None]), "x", "y") for s, n in sizes.items() for _ in range(n)]
    rows += rows[:20] + [(None, "No Id", "en", "hot", 3, "x", "y"), (None, "No Id", "en", "hot", 3, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, idx string")
    assert got_manifest(merkle.manifest(df.repartition(5), arity)) == plain_manifest(rows_of(df), arity)


def test_manifest_edge_cases(docs, spark):
    long = "Ab" * 300_000
    one = docs([(5, long)])
    assert got_manifest(merkle.manifest(one)) == plain_manifest(rows_of(one))
    assert merkle.manifest(one).first()["root"] == merkle.manifest(one).first()["leaf"]
    same = docs([(5, "A")] * 40)
    assert got_manifest(merkle.manifest(same)) == plain_manifest(rows_of(same))
    assert merkle.manifest(docs([])).collect() == []


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    form, nears = {}, {}
    for w, n in counts.items():
        close = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        nears[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, nears[w], counts.get(form[w])))
    return sorted(out, key=str)


def got_variants(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_spelling_operator_is_the_plain_one(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("doc_id < 60")
    got = got_variants(spelling.variants(rows))
    assert got == plain_variants([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert any(f for _, f, *_ in got)


def test_spelling_query_is_its_sql(spark, sf_dir):
    assert spark_rows(queries.op13_spelling_variants(spark, sf_dir)) == sql_rows(sf_dir, queries.oracle_sql()["op13_spelling_variants"])


def test_single_edits_are_all_and_only_those():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abä") for _ in range(r.randint(1, 7))) for _ in range(500)})
    i, j, prefix = spelling.single_edits(words, words[::-1])
    other = words[::-1]
    assert {(words[a], other[b]) for a, b in zip(i, j, strict=True)} == {(a, b) for a in words for b in words if near(a, b)}
    assert all(words[a][:p] == other[b][:p] and words[a][p : p + 1] != other[b][p : p + 1] for a, b, p in zip(i, j, prefix, strict=True))


def test_a_hot_half_is_compared_in_blocks_and_each_pair_counts_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 200)
    r = random.Random(1)
    words = {"prefix" + "".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(400)} | {"x" * 300, "x" * 301, "ÿ" * 40 + "é", "ÿ" * 40}
    counts = [(w, r.randint(2, 9)) for w in sorted(words)]
    got = {x["word"]: (x["n_near"], x["best"]["near"]) for x in spelling.near_words(spark.createDataFrame(counts, "word string, n bigint"), len(counts)).collect()}
    n = dict(counts)
    want = {}
    for w in words:
        close = [v for v in words if near(w, v)]
        if close:
            want[w] = (len(close), min(close, key=lambda v: (-n[v], v)))
    assert got == want


def test_forms_lead_to_the_last(docs):
    """A chain of forms, each ten times as frequent as the one before; text past the words plays no part."""
    ids = [k for k in range(2000) if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w in ("variant", "variand", "varinnd", "varinndo"))]
    words = ["Varinndo"] * 2 + ["varinnd"] * 20 + ["VARIAND"] * 200 + ["variant"] * 2000
    rows = docs([(ids[0], " 1x_".join(words)), (ids[1], None), (ids[2], "")])
    got = {r["word"]: r for r in spelling.variants(rows).collect()}
    assert {w: (r["form"], r["root"], r["n"]) for w, r in got.items()} == {"varinndo": ("varinnd", "variant", 2), "varinnd": ("variand", "variant", 20), "variand": ("variant", "variant", 200), "variant": (None, "variant", 2000)}


def test_spelling_edge_cases(docs):
    long = "abcdefgh" * 40_000
    rows = [(None, "Wörterbuch wörterbuch"), (4, "ÄHNLICH ähnlich ÄHNLICH"), (4, "ÄHNLICH ähnlich ÄHNLICH"), (8, f"{long} {long} {long}x {long}x"), (9, None), (10, "a_b c-d 12")]
    assert got_variants(spelling.variants(docs(rows))) == plain_variants(rows)
    assert spelling.variants(docs([])).collect() == []
    assert spelling.variants(docs([(1, None)])).filter(F.col("word").isNotNull()).collect() == []
