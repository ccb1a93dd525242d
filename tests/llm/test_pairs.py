"""Operators on pairs and corpora: near-duplicates, leaks, fingerprints, language model, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import class_lm, components, decontaminate, near_dedup, queries, simhash
from tallyfield.llm.common import grams, words


def similarity(a, b):
    """1 - edit distance over the longer length, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return 1 - row[-1] / max(len(a), len(b)) if a and b else 0.0


def some_words(r, n, kinds=400):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def edited(r, text, edits):
    out = list(text)
    for _ in range(edits):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice([[], ["new"], [out[k], f"x{r.randrange(99)}"]])
    return out


# Near-duplicates


def test_edit_similarity_is_the_plain_one():
    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(30) for _ in range(r.randint(1, 40))]
        b = list(a) if r.random() < 0.1 else edited(r, a, r.randint(0, min(8, len(a) - 1)))
        b = [x if isinstance(x, int) else 77 for x in b] or [1]
        plain = similarity(a, b)
        got = near_dedup.edit_similarity(np.array(a, np.int32), np.array(b, np.int32), 0.8)
        assert got == (pytest.approx(plain) if plain >= 0.8 - 1e-9 else 0.0)


def test_block_pairs_hold_all_similar_texts_of_other_components():
    r = random.Random(8)
    base = [r.randrange(10**6) for _ in range(60)]
    texts, words_of = [], {}
    for k in range(30):
        x = np.array([v if r.random() < 0.95 else r.randrange(10**6) for v in base] if k % 3 else [r.randrange(10**6) for _ in range(50)], np.int32)
        texts.append((k, k % 4, k % 4 == 0, len(x), near_dedup.signature(x), []))
        words_of[k] = x.tolist()
    for k, x in ((40, np.arange(9000, dtype=np.int32)), (41, np.arange(9000, 500, -1, dtype=np.int32))):  # many words for the bits, and another order
        texts.append((k, k, False, len(x), near_dedup.signature(x), []))
        words_of[k] = x.tolist()
    pairs = near_dedup.block_pairs([t for t in texts if not t[2]], texts)
    got = set(pairs)
    want = {(a[0], b[0]) for a, b in combinations(texts[:30], 2) if a[1] != b[1] and similarity(words_of[a[0]], words_of[b[0]]) >= 0.8}
    assert len(got) == len(pairs) and want <= got and (40, 41) in got
    assert len(got) < 1.5 * len(want)
    assert not near_dedup.block_pairs([(*t[:5], [3]) for t in texts if not t[2]], [(*t[:5], [2, 3]) for t in texts])  # given in another bucket


def test_sketches_keep_the_order_of_the_text():
    r = random.Random(1)
    a = grams(words(np.frombuffer(" ".join(some_words(r, 200)).encode(), np.uint8))[2], 5)
    assert (near_dedup.sketches(a) == near_dedup.sketches(a.copy())).all()
    swapped = np.concatenate((a[100:], a[:100]))
    assert (near_dedup.sketches(a) == near_dedup.sketches(swapped)).mean() < 0.45  # the same set in another order; a quarter lies wholly in one half
    assert len(near_dedup.sketches(a[:0])) == 0 and len(near_dedup.sketches(a[:2])) == near_dedup.SKETCHES


def brute_classes(rows):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    root = {k: k for k in range(len(texts))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        x, y = texts[a][1], texts[b][1]
        if x and (x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and similarity(x, y) >= 0.8 - 1e-9):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(texts)}


def test_classes_equal_those_of_all_pairs(docs):
    r = random.Random(9)
    rows, k = [], 0
    for size, edits in ((1, 0), (12, 1), (40, 6), (25, 12), (6, 0), (3, 2)):
        base = some_words(r, r.randint(60, 160), 5000)
        for c in range(size):
            rows.append((k * 7 % 1009, " ".join(edited(r, base, r.randint(0, edits) if c else 0))))
            k += 1
    passage = some_words(r, 50, 5000)
    for _ in range(30):  # unlike texts with a passage in common
        rows.append((k * 7 % 1009, " ".join(some_words(r, 40, 5000) + passage + some_words(r, 40, 5000))))
        k += 1
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b c"), (2004, "A  b C"), (2005, "a b d")]
    out = near_dedup.group(docs(rows)).collect()
    want = brute_classes(rows)
    assert {x.doc_id: x.class_id for x in out} == want
    sizes = Counter(want.values())
    assert all(x.class_size == sizes[x.class_id] and x.keep == (x.doc_id == x.class_id) for x in out)


def test_short_texts_are_found_exactly(docs):
    """4 to 60 words: with one or two words more, and with edits; many of them begin with a common line."""
    r = random.Random(12)
    line = some_words(r, 6, 5000)
    rows = []
    for n in [*range(4, 16), *range(18, 61, 6)]:
        for c in range(3):
            base = (line if c == 2 else []) + some_words(r, n, 5000)
            rows += [" ".join(x) for x in (base, [*base, "more"], [*base, "and", "more"], ["before", *base], edited(r, base, 1), base[:-1])]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    assert {x.doc_id: x.class_id for x in near_dedup.group(docs(rows)).collect()} == brute_classes(rows)


def test_near_dedup_edges(docs):
    r = random.Random(2)
    long = " ".join(some_words(r, 120_000, 10**6))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "one two three four five six"), (1, "other words are here and now"), (3, long), (4, long + " end"), (5, None)]
    df = docs(rows)
    df = df.withColumns({"_node": F.lit("x"), "_ID": F.lit(1), "_kept": F.lit(2), "_key": F.lit(3), "size": F.lit(4), "words": F.lit(5)})
    kept = near_dedup.keep_one(df)
    assert kept.schema == df.schema
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == sorted([(1, rows[0][1]), (0, rows[0][1]), (1, rows[4][1]), (3, long), (5, "")])
    assert near_dedup.group(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, x) for x in range(201, 260)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x.node: x.root for x in components.components(df).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100} | {x: 200 for x in range(201, 260)}
    assert components.components(df.limit(0)).count() == 0


# Leaks


def plain_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if x == y else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return table.max() / (2 * len(a))


def test_smith_waterman_is_the_plain_one():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 15))] for _ in range(2))
        score, begin, end = decontaminate.smith_waterman(np.array(a), np.array(b))
        assert score == pytest.approx(plain_alignment(a, b))
        if score:
            assert plain_alignment(a, b[begin:end]) == pytest.approx(score)
    assert decontaminate.smith_waterman(np.array([1]), np.array([], int)) == (0.0, 0, 0)


@pytest.fixture
def leaks(spark, docs):
    r = random.Random(6)
    items = [(k, " ".join(some_words(r, r.randint(20, 45), 3000)).capitalize() + ".") for k in range(12)] + [(12, None), (13, "of"), (14, ""), (12, "x y")]
    body = lambda n: some_words(r, n, 3000)
    rows = [(k, " ".join(body(200))) for k in range(20)]
    for k in range(12):
        w = items[k][1].lower().rstrip(".").split()
        rows.append((100 + k, " ".join([*body(50), *w, *body(50)])))
        rows.append((200 + k, " ".join([*body(30), *(x if r.random() > 0.12 else "changed" for x in w), *body(60)])))
    rows += [(300 + k, " ".join([*body(20), *items[0][1].lower().rstrip(".").split(), *body(20)])) for k in range(40)]  # in most documents
    rows += [(400, None), (401, ""), (402, (items[1][1] + " ") * 50), (403, "word " * 300_000 + items[2][1])]
    return docs(rows), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string"), rows, items


def test_leaks_equal_the_alignment_of_all_pairs(leaks):
    df, bench, rows, items = leaks
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find_leaks(df, bench).collect()}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in rows:
        if i == 403:
            assert (403, 2) in got
            continue
        for k, item in items[:12]:
            hit = got.get((i, k))
            words_of = split(t)
            score = plain_alignment(split(item), words_of) if len(words_of) < 400 else None
            if score is not None and score >= decontaminate.MIN_SCORE:
                assert hit and hit.score == pytest.approx(score), (i, k)
                assert split(t[hit.start : hit.end])[0] in split(item)
            elif score is not None:
                assert hit is None, (i, k)
    assert got[402, 1].score == 1.0 and got[402, 1].passages > 1
    assert not {13, 14} & {k for _, k in got}
    kept = {x.doc_id for x in decontaminate.without_leaks(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert set(range(20)) <= kept


def test_short_and_much_edited_copies_are_found(spark, docs):
    """Copies of 8 to 20 words with 20 to 35 % of the words changed, each third among them, against all alignments."""
    r = random.Random(21)
    items = [some_words(r, n, 3000) for n in (8, 9, 10, 12, 12, 14, 16, 16, 18, 20)]
    copies = []
    for k, w in enumerate(items):
        copies.append((k, [x if j % 3 < 2 else "changed" for j, x in enumerate(w)]))
        copies += [(k, [x if r.random() > share else f"c{r.randrange(99)}" for x in w]) for share in (0.2, 0.25, 0.33, 0.35) for _ in range(8)]
    rows = [[*some_words(r, 30, 3000), *w, *some_words(r, 30, 3000)] for _, w in copies]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find_leaks(docs([" ".join(w) for w in rows]), bench).collect()}
    want = {(i, k): s for i, w in enumerate(rows) for k, item in enumerate(items) if (s := plain_alignment(item, w)) >= decontaminate.MIN_SCORE}
    assert got == pytest.approx(want) and len(want) > 200


def test_leak_edges(leaks, docs):
    df, bench, _, _ = leaks
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    once, twice = (sorted((x.doc_id, x.item_id, x.passages) for x in decontaminate.find_leaks(d, bench).collect()) for d in (df, df.union(df)))
    assert once == twice


def test_a_benchmark_in_blocks_gives_the_same(leaks, monkeypatch):
    df, bench, _, _ = leaks
    whole = sorted((x.doc_id, x.item_id, x.score) for x in decontaminate.find_leaks(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1000)
    assert sorted((x.doc_id, x.item_id, x.score) for x in decontaminate.find_leaks(df, bench).collect()) == whole


# Fingerprints


def plain_fingerprint(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        h, k = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), 12)
        total += k
        for i in range(64):
            votes[i] += k * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_fingerprints_of_texts_and_edited_texts(docs):
    r = random.Random(5)
    texts = {k * 3: " ".join(some_words(r, r.randint(0, 80))) + r.choice(["", " é日", "\n"]) for k in range(60)} | {500: "", 501: None, 502: "x " * 50_000}
    df = docs(list(texts.items()))
    rows = {x.doc_id: x for x in simhash.compare_edited(df, query_modulus=3).collect()}
    order = sorted(texts, reverse=True)
    prints = {k: plain_fingerprint(t or "") for k, t in texts.items()}
    for p, k in enumerate(order):
        t, following = texts[k] or "", order[(p + 1) % len(order)]
        half = len(t) // 2
        e = t[: len(t) - half] + (texts[following] or "")[:half]
        x = rows[k]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (f"{prints[k]:016x}", f"{plain_fingerprint(e):016x}")
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert x.near_edited == like(prints[k], plain_fingerprint(e)) and x.near_next == like(prints[k], prints[following])
        assert x.near_rows == (sum((prints[k] ^ v).bit_count() <= 3 for v in prints.values()) - 1 if k % 3 == 0 else None)


def test_permuted_tables_find_all_within_the_radius(spark):
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            v = s
            for b in r.sample(range(64), r.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint bigint")
    q = spark.createDataFrame([(signed(v),) for v in seeds], "fingerprint bigint")
    for radius, blocks in ((3, 6), (1, 3), (4, 7)):
        got = [(x.query, x.found) for x in simhash.neighbours(q, df, radius, blocks).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(signed(a), signed(b)) for a in seeds for b in values if (a ^ b).bit_count() <= radius}


def test_fingerprint_edges(docs):
    one = simhash.compare_edited(docs([(7, "only one")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f"), (2, None)]
    df = docs(rows).withColumns({"_same": F.lit("x"), "_lent": F.lit(1), "times": F.lit(2), "fp": F.lit(3)})
    out = simhash.compare_edited(df).collect()
    assert sorted((x.doc_id or 0, x.n_chars) for x in out) == [(0, 3), (1, 3), (1, 3), (1, 3), (2, 0)]
    assert Counter(x.fingerprint for x in out if x.doc_id == 1).most_common(1)[0][1] == 2
    assert simhash.fingerprint(df).count() == 5
    assert [x.near_next for x in out if x.doc_id is None] == [None]
    assert simhash.compare_edited(docs(rows).limit(0)).count() == 0
    assert {x.fingerprint for x in simhash.fingerprint(docs([(1, ""), (2, None)])).collect()} == {0}


def test_fingerprint_plan_has_no_python(spark, sf_dir):
    plan = simhash.compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Language model


def test_base_score_and_counts_equal_plain_ones(docs, monkeypatch):
    monkeypatch.setattr(class_lm, "BROADCAST", 60)
    monkeypatch.setattr(class_lm, "CLUSTERED", 20)
    r = random.Random(7)
    texts = [" ".join(some_words(r, r.randint(0, 60), 150)) + r.choice(["", " É", "\tTHE\x0bthe\n", "\x1c x　y"]) for _ in range(60)] + [None, "", "unseen words"]
    rows = {x.doc_id: x for x in class_lm.score(docs(texts)).collect()}
    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    count = Counter(w for s, h in zip(split, held, strict=True) if not h for w in s)
    n, v = sum(count.values()), len(count)
    for k, s in enumerate(split):
        x = rows[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(s), sum(w in count for w in s), n)
        assert x.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s))
        assert x.score < 0 and x.perplexity == pytest.approx(10 ** (-x.score / x.n_tokens))


def test_class_model_is_a_distribution_over_seen_words():
    """Given any class before, the seen words' probabilities and the discounted rest add up to one."""
    r = np.random.default_rng(1)
    bigrams = r.integers(0, 50, (10 + class_lm.SHAPES, 10 + class_lm.SHAPES))
    of = class_lm.exchange(bigrams, 10, 3)
    assert sorted(set(of[10:])) == list(range(3, 3 + class_lm.SHAPES)) and set(of[:10]) <= {0, 1, 2}
    onehot = np.eye(int(of.max()) + 1)[of]
    pairs = onehot.T @ bigrams @ onehot
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    step = (pairs + class_lm.PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + class_lm.PRIOR)
    assert step.sum(axis=1) == pytest.approx(np.ones(len(step)))


def likelihood(bigrams, of):
    onehot = np.eye(int(of.max()) + 1)[of]
    pairs = onehot.T @ bigrams @ onehot
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))


def test_exchange_never_lowers_the_likelihood_and_finds_clear_classes():
    r = np.random.default_rng(2)
    kind = np.arange(12) % 2  # words of one kind follow those of the other
    bigrams = np.zeros((12 + class_lm.SHAPES, 12 + class_lm.SHAPES), np.int64)
    bigrams[:12, :12] = np.where(kind[:, None] != kind[None, :], r.integers(20, 60, (12, 12)), r.integers(0, 3, (12, 12)))
    of = class_lm.exchange(bigrams, 12, 2)
    assert len({tuple(of[:12][kind == k]) for k in (0, 1)}) == 2 and all(len(set(of[:12][kind == k])) == 1 for k in (0, 1))
    start = np.concatenate([np.zeros(12, int), 2 + np.arange(class_lm.SHAPES)])
    start[np.argsort(-bigrams[:12].sum(axis=1), kind="stable")] = np.arange(12) % 2
    assert likelihood(bigrams, of) >= likelihood(bigrams, start)


def test_further_words_get_the_class_of_the_highest_likelihood():
    """Against the whole likelihood of the corpus with the word in each of the classes."""
    r = np.random.default_rng(3)
    n, further = 4, 6  # single-word classes, then words that are in their shapes
    kinds = n + further
    shape = r.integers(0, 3, further)
    of = np.concatenate([np.arange(n), n + shape, [n + class_lm.SHAPES - 1]])
    words_of = r.choice(kinds + 1, 400, p=np.append(np.full(n, 0.15), np.full(further + 1, 0.4 / (further + 1))))
    bigrams = np.zeros((kinds + 1, kinds + 1))
    np.add.at(bigrams, (words_of[:-1], words_of[1:]), 1)
    total = n + class_lm.SHAPES
    onehot = np.eye(total)[of]
    gains = class_lm.Gains(onehot.T @ bigrams @ onehot)
    entries = []
    for k in range(further):
        w = n + k
        out, into = bigrams[w].copy(), bigrams[:, w].copy()
        out[w] = into[w] = 0
        found = np.concatenate((out @ onehot, into @ onehot, [bigrams[w, w]]))
        entries += [(k, c, int(x)) for c, x in enumerate(found) if x]
    got = gains.best(shape, *(np.array(x) for x in zip(*entries)))

    def whole(w, c):
        moved = of.copy()
        moved[w] = c
        pairs = np.eye(total)[moved].T @ bigrams @ np.eye(total)[moved]
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))

    assert got.tolist() == [int(np.argmax([whole(n + k, c) for c in range(n)])) for k in range(further)]


def test_every_training_word_has_a_class_by_its_neighbours(docs, monkeypatch):
    """Words of one shape outside the clustering, in two kinds that follow different frequent words."""
    monkeypatch.setattr(class_lm, "BROADCAST", 30)
    monkeypatch.setattr(class_lm, "CLUSTERED", 4)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm.exchange, "__defaults__", (4, 6))
    r = random.Random(8)
    text = lambda: " ".join(f"{x} {r.choice([y, f'{x}w{r.randrange(100, 160)}'])}" for x, y in (r.choice((("a", "c"), ("b", "d"))) for _ in range(60)))
    like, unlike = "a aw105 a c b bw105 " * 10, "a bw105 a c b aw105 " * 10
    texts = [text() for _ in range(80)]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = {x.doc_id: x for x in class_lm.score(docs([*enumerate(texts), (held[0], like), (held[1], unlike)])).collect()}
    assert rows[held[0]].n_known == 61 and rows[held[0]].base_score == pytest.approx(rows[held[1]].base_score)
    assert rows[held[0]].score > rows[held[1]].score + 10


def test_language_model_edges(docs):
    df = docs([None, (None, "a b"), "a", (0, "a b c"), "w " * 200_000])
    rows = class_lm.score(df).collect()
    assert len(rows) == 5 and all(x.score <= 0 for x in rows)
    assert class_lm.score(df.limit(0)).count() == 0
    alone = class_lm.score(docs([(None, "a b")])).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens) for x in alone] == [(3, 0, 0)]


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = queries.op6_class_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# Pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    item = " ".join(some_words(r, 30, 3000))
    texts = [" ".join(f"{x}{r.choice('abcdefgh')}" for x in ["the", "and", "of", "was"] * 10) + f" {' '.join(some_words(r, 30, 3000))}" for _ in range(12)]
    rows = list(enumerate(texts)) + [(50, texts[0]), (51, "12345 !!!"), (52, None), (53, f"the start {item} the end of it"), (54, texts[1] + " password=hunter2222")]
    df = docs(rows).drop("class_id", "score", "node")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "bpe"]
    kept = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns
    got = {x.doc_id: x for x in kept.collect()}
    assert set(range(12)) - {1} <= set(got) and not {50, 51, 52, 53} & set(got)
    assert all("hunter2222" not in x.text for x in got.values())
    out = {x.doc_id: x.n_tokens for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(got)


def test_pipeline_stages_on_odd_rows(spark, docs, sf_dir):
    """Null ids and texts, repeated rows, a very long text and clashing columns go through every stage; so does no row."""
    import corpus_pipeline

    r = random.Random(3)
    long = " ".join(some_words(r, 40_000))
    texts = [(1, "the cat sat on the mat by the door " * 3), (1, "the cat sat on the mat by the door " * 3), (None, "a lone row of plain words that stays here"), (None, "a lone row of plain words that stays here"), (4, None), (5, ""), (6, long), (7, long + " more")]
    odd, none = docs(texts + [(k, " ".join(some_words(r, 30))) for k in range(8, 30)]), docs([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, sf_dir)
        assert kept.schema.names == odd.schema.names, name
        rows = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
        assert sum(i is None and t is not None for i, t in rows) == 2, name
        assert any(t and len(t) > 10_000 for _, t in rows), name
        if name == "near_dedup":
            assert [i for i, t in rows].count(1) == 1 and 7 not in [i for i, _ in rows]
        assert stage(spark, none, sf_dir).count() == 0, name
    encoded = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert len(encoded) == len(texts) + 22 and sum(x.n_tokens == 0 for x in encoded) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf_dir).count() == 0
