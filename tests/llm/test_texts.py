"""Operators on single texts: secrets, licenses, BPE, URLs, language, quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import bpe, language_id, license_scan, quality, queries, secrets, url_filter

from ..compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(sf_dir, queries.oracle_sql()[name])


# Secrets


def plain_secrets(text):
    patterns = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return sorted(((k, *m.span()) for k, p in patterns.items() for m in p.finditer(text) if fits[k](m)), key=lambda s: (s[1], list(patterns).index(s[0])))


def test_base_secrets_equal_the_plain_patterns(docs):
    r = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "secret: token: abcdefgh", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x.y=z", "\u212a", "ſecret=abcdefg"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = secrets.scan(docs(texts)).collect()
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.spans if s.kind != "entropy"] == plain_secrets(texts[row.doc_id])


def test_entropy_by_counts_is_the_entropy_of_each_window():
    r = random.Random(5)
    for _ in range(50):
        s = "".join(r.choice("abcdef0123") for _ in range(r.randint(1, 60)))
        n = min(20, len(s))
        best = max(-sum(c / n * math.log2(c / n) for c in Counter(s[k : k + n]).values()) for k in range(len(s) - n + 1))
        assert secrets.window_entropy(s) == pytest.approx(best, abs=1e-9)


def test_random_strings_are_found_and_allowed_ones_not():
    found = lambda t: [s for s in secrets.find_secrets(t) if s[0] == "entropy"]
    assert found("see qX7vB2nM9kL4pR8tW3zY6cF1 now") == [("entropy", 4, 28)]
    for t in ("123e4567-e89b-12d3-a456-426614174000", "a/long/path/to/some/module/name", "12345678901234567890123", "AAAAAAAAAAAAAAAAAAAAAAAA1", "thisisaverylongwordwithoutanydigits"):
        assert not found(t), t


def test_secret_edges_and_redaction(docs):
    long = "word " * 200_000 + "password=hunter22" + " tail" * 1000
    df = docs([None, "", "clean text", "token: abcdef1 and AKIA" + "A" * 16, long])
    out = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert (out[0].text, out[1].text, out[2].text) == (None, "", "clean text")
    assert out[3].text == "[SECRET] and [SECRET]" and out[3].n_chars == len(out[3].text)
    assert "hunter22" not in out[4].text and out[4].text.endswith(" tail")
    assert secrets.redact(df).schema == df.schema
    d = {r.doc_id: r for r in secrets.digest(secrets.scan(df)).collect()}
    assert d[0].base_sha256 == hashlib.sha256(b"").hexdigest() and d[0].spans == ""
    assert (d[3].n_assign, d[3].n_access, d[3].n_hex) == (1, 1, 0)
    assert d[3].base_sha256 == hashlib.sha256(d[3].spans.encode()).hexdigest()
    assert secrets.scan(df.limit(0)).count() == 0
    assert secrets.scan(df.union(df)).count() == 10


# Licenses


def test_licenses_exact_edited_and_absent(docs):
    gpl = license_scan.TEMPLATES["GPL-3.0 notice"]
    words = gpl.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 11 != 5)
    texts = [None, "", "é " * 50 + "Released under the MIT License. More.", "x " + edited + " y", " ".join(reversed(words)), "the license of the work", "Released under the MIT License. " * 3]
    rows = license_scan.scan(docs(texts)).collect()
    by = lambda k: [(r.license, r.start, r.end) for r in rows if r.doc_id == k]
    assert by(2) == [("MIT", 100, 130)] and texts[2][100:130] == "Released under the MIT License"
    assert "GPL-3.0 notice" in [x[0] for x in by(3)] and [r.license for r in rows if r.doc_id == 3 and r.best] == ["GPL-3.0 notice"]
    assert next(r.coverage for r in rows if r.doc_id == 3 and r.best) == pytest.approx(len(edited.split()) / len(words), abs=0.05)
    assert by(0) == by(1) == by(4) == by(5) == []
    assert len(by(6)) == 3
    assert license_scan.scan(docs(texts).limit(0)).count() == 0


def test_banded_alignment_is_the_plain_one_within_the_band():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 5, r.integers(0, 14)), r.integers(0, 5, r.integers(0, 14))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = license_scan.align(a, b, 50, int(r.integers(-3, 4)))
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_licenses_against_all_places_one_by_one(docs, monkeypatch):
    """Every start of every text, by the plain table, against the scan: exact and edited notices, short ones too."""
    r = random.Random(14)
    templates = {k: v for k, v in license_scan.TEMPLATES.items() if len(v.split()) < 60}
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    texts = []
    for name in sorted(templates):
        own = templates[name].split()
        for share in (0, 0, 0.1, 0.15):
            w = [x if r.random() >= share else "other" for x in own]
            texts.append(" ".join(["lorem", "ipsum"] * r.randint(1, 9) + w + ["dolor"] * 5))
    texts += ["Released under an MIT License", "lorem ipsum " * 40, " ".join(r.choice(["the", "license", "of", "mit", "under"]) for _ in range(80))]
    got = {(x.doc_id, x.license) for x in license_scan.scan(docs(texts), templates).collect()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    want = set()
    for i, t in enumerate(texts):
        for name, template in templates.items():
            own, w = split(template), split(t)
            band = max(2, len(own) // 5)
            if any(lcs(own, w[max(0, k - band) : k + len(own) + band]) >= 0.8 * len(own) for k in range(len(w))):
                want.add((i, name))
    # Plain windows are wider than the band, so they may hold more, never less.
    assert got <= want and len(want - got) <= 0.02 * len(want) and (len(texts) - 3, "MIT") in got
    monkeypatch.setattr(license_scan, "INDEX_WORDS", 30)
    assert {(x.doc_id, x.license) for x in license_scan.scan(docs(texts), templates).collect()} == got


def test_license_edges(docs):
    notice = "Released under the MIT License."
    df = docs([(None, notice), (1, notice), (1, notice), (2, "word " * 300_000 + notice)])
    assert sorted((x.doc_id or 0, x.start) for x in license_scan.scan(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1_500_000)]


def test_winnowing_takes_one_of_every_window():
    h = np.random.default_rng(2).integers(0, 9, 60).astype(np.uint64)
    for w in (1, 2, 5, 70):
        picked = set(license_scan.winnow(h, w).tolist())
        for k in range(max(1, len(h) - w + 1)):
            window = range(k, min(len(h), k + w))
            assert picked & set(window)
            assert min(h[list(window)]) == min(h[p] for p in picked & set(window))


# URLs


def plain_rule(url, rules):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(v, h, p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: (r[1].count("."), len(r[1]), len(r[2])), default=None)


def test_urls_against_all_rules_one_by_one(spark):
    r = random.Random(7)
    hosts = ["example.com", "A.Example.COM", "example.net", "xexample.net", "org", "b.org", "com", "notcom", "spam-farm.example.org", "m.casino-win.example.net", "É.com", "", "example.com:80"]
    paths = ["/en/7", "/en/70/x", "/en", "/en/8", "/de/8", "/de/81", "/de/", "/es/1", "", "/en//7", "/de"]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a=/en/', '#x', '?u=http://com/en/'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://a.com\n/en/x", "x" * 100_000 + "://org/es/"]
    df = spark.createDataFrame([(k, u, "h", "dup") for k, u in enumerate(urls)], "page_id bigint, url string, html string, verdict string")
    for row in url_filter.judge_urls(df).collect():
        host, path, rule = plain_rule(urls[row.page_id], url_filter.CONTRACT_RULES)
        assert (row.host, row.path) == (host, path), urls[row.page_id]
        assert row.rule == (rule[1] + rule[2] if rule else None), urls[row.page_id]
        more = plain_rule(urls[row.page_id], url_filter.FARM_RULES)[2]
        assert row.verdict == (rule or more or ("allow",))[0]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.transducer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())


def test_bpe_equals_the_library(both):
    mine, library = both
    r = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "-", "-" * 9, "é", "日", "1", "'s", "'LL", "the", "ing", "<|endoftext|>", "\x1c", "\x85", "ÃÂ", "=", "\u3000", "😀", "\u0301", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 150))) for _ in range(1500)] + ["", "a" * 5000, " " * 3000, "ab" * 3000, "-" * 3001]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = mine.encode(t)
        assert ids == e.ids, t[:80]
        assert mine.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_streams_as_it_does_whole(both):
    mine, _ = both
    data = ("abc" * 1500 + "é" * 700).encode()
    ids = mine.merge(data[:300])
    assert [mine.bytes_of[k] for k in mine.stream([data[:300]])] == ids
    for size in (1, 7, 256, 5000):
        blocks = (data[k : k + size] for k in range(0, len(data), size))
        assert list(mine.stream(blocks)) == list(mine.stream([data]))
    stream = mine.stream(iter([b"ab" * 2000, b"cd"]))
    assert next(stream) in mine.bytes_of  # given out before the piece has ended


def test_tokens_are_stable_after_the_lookahead():
    """All texts over a small merge list: what lies the lookahead before the end stays, whatever comes; a shorter one doesn't do."""
    mine = bpe.Transducer.__new__(bpe.Transducer)
    merges = [("b", "c"), ("a", "b"), ("a", "a"), ("aa", "bc"), ("c", "ab"), ("bc", "a")]
    names = [*"abc", *dict.fromkeys(a + b for a, b in merges)]
    mine.id_of = {x.encode(): k for k, x in enumerate(names)}
    mine.bytes_of = {k: x for x, k in mine.id_of.items()}
    mine.rank = {(a.encode(), b.encode()): k for k, (a, b) in enumerate(merges)}
    mine.rule = {mine.id_of[a] << 32 | mine.id_of[b]: k for (a, b), k in mine.rank.items()}
    mine.made = {mine.id_of[a + b]: (k, mine.id_of[a], mine.id_of[b]) for (a, b), k in mine.rank.items()}
    mine.longest, mine._edges, mine._fits = 4, ({}, {}), {}
    assert 1 < mine.chain <= len(merges)
    changed = 0
    for k in range(3**9):
        text = "".join("abc"[k // 3**i % 3] for i in range(9)).encode()
        ids = [mine.id_of[x] for x in mine.merge(text)]
        assert list(mine.stream([text[:4], text[4:]])) == ids
        for size in range(1, 9):
            ends, shorter = np.cumsum([len(mine.bytes_of[x]) for x in ids]), mine.merge(text[:size])
            before = np.cumsum([len(x) for x in shorter])
            differ = next((i for i, (x, y) in enumerate(zip(ends, before)) if x != y), None)
            if differ is not None and differ < len(shorter):
                tokens_after = len(shorter) - differ
                changed = max(changed, tokens_after)
                assert tokens_after <= mine.chain
    assert changed > 1


def test_every_token_is_its_own_encoding_and_fits_are_what_merging_gives(both):
    mine, _ = both
    tokens = list(mine.id_of.items())
    assert all(list(mine.stream([b])) == [i] for b, i in tokens[::7])
    r = random.Random(2)
    for _ in range(3000):
        (a, i), (b, j) = r.choice(tokens), r.choice(tokens)
        assert mine.fits(i, j) == (mine.merge(a + b) == [a, b])


def test_bpe_cuts_chunks_only_where_pieces_begin(both):
    mine, _ = both
    text = ("word  two\n\n three 'll x1 " * 9000)[: bpe.CHUNK * 2 + 123]
    parts = list(mine.chunks(text))
    assert len(parts) > 1 and "".join(parts) == text
    assert [p for part in parts for p in bpe.SPLIT.findall(part)] == bpe.SPLIT.findall(text)


def test_decoder_goes_on_across_tokens(both):
    mine, _ = both
    ids = [mine.id_of[bytes([b])] for b in "日é".encode()]
    assert mine.decode(ids) == "日é"
    assert mine.decode(ids[:1]) == "\ufffd"


def test_bpe_query_edges(docs):
    df = docs([None, "", "hello world", "x" * 300_000, (None, "no id")])
    rows = {r.doc_id: r for r in bpe.encode_decode(df, keep=True).collect()}
    assert rows[None].n_tokens == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[0].n_tokens, rows[0].ids_sha256, rows[0].decoded_sha256) == (0, empty, empty)
    assert rows[2].decoded == "hello world" and rows[2].ids_sha256 == hashlib.sha256(",".join(map(str, rows[2].ids)).encode()).hexdigest()
    assert rows[3].decoded_sha256 == hashlib.sha256(b"x" * 300_000).hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0 and bpe.encode_decode(df.union(df)).count() == 10


# Languages


def test_gram_buckets_do_not_cross_texts_and_skip_other_characters():
    both, of = language_id.gram_buckets(["Ab-c 12", "!!", "", "xyz"])
    assert set(of.tolist()) == {0, 3}
    alone, _ = language_id.gram_buckets(["xyz"])
    assert sorted(both[of == 3]) == sorted(alone)
    assert sorted(language_id.gram_buckets(["a--9 b"])[0]) == sorted(language_id.gram_buckets(["A b"])[0])


def test_language_scores_are_the_posteriors(docs):
    langs = ["en" if k % 2 else "de" for k in range(40)]
    texts = ["the quick fox %d" % k if k % 2 else "der schnelle fuchs %d" % k for k in range(40)]
    df = docs(texts, langs)
    names, matrix = language_id.learn(df)
    learned = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    counts = {x: Counter() for x in ("de", "en")}
    for k in learned:
        counts[langs[k]].update(language_id.gram_buckets([texts[k]])[0].tolist())
    assert names == ["de", "en"]
    for c, name in enumerate(names):
        for b, n in counts[name].items():
            assert matrix[b, c] == pytest.approx(math.log((n + 0.5) / (sum(counts[name].values()) + 0.5 * language_id.BUCKETS)))
    rows = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(rows[k].lang_pred == langs[k] for k in range(40))
    assert all(rows[k].held_out == (k not in learned) for k in range(40))


def test_language_edges(docs):
    df = docs([None, "", "123 !!", "the cat", (None, "the dog"), "the " * 300_000], "en")
    rows = language_id.identify(df).collect()
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1, 2)] == [("und", 0.0)] * 3
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    nothing = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0
    assert sorted(r.text or "" for r in language_id.keep(df).collect()) == sorted(["the cat", "the dog", "the " * 300_000])
    assert language_id.keep(df).schema == df.schema


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


# Quality


def test_votes_are_those_of_all_cosines():
    r = np.random.default_rng(3)
    a, b = r.standard_normal((20, 8)), r.standard_normal((50, 8))
    sims = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    labels = r.integers(0, 2, 50).astype(float)
    for row, got in zip(sims, quality.vote(sims, labels, 7), strict=True):
        near = np.argsort(-row)[:7]
        w = np.maximum(row[near], 0) ** 8
        assert got == pytest.approx((w * labels[near]).sum() / w.sum())
    assert quality.vote(np.zeros((2, 0)), np.zeros(0)).tolist() == [0.5, 0.5]
    assert quality.vote(-np.ones((1, 3)), np.ones(3)).tolist() == [0.5]


def test_quality_edges(spark, docs):
    df = docs([None, "", "good words here", "###!! %%% ###", (None, "x"), "word " * 200_000])
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (3, 0, 1), (99, 1, 1), (0, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(df, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_a_language_table_of_any_size_is_scored_in_blocks(monkeypatch):
    r = np.random.default_rng(4)
    langs = [f"l{k:03}" for k in range(150)]
    matrix = np.log(r.dirichlet(np.ones(language_id.BUCKETS + 1), 150).T)
    texts = ["some words here", "", "others", "a b c " * 50]
    whole = language_id.predict(texts, langs, matrix)
    monkeypatch.setattr(language_id, "BLOCK", 1000)
    names, scores = language_id.predict(texts, langs, matrix)
    assert names == whole[0] and scores == pytest.approx(whole[1])
    doubled = language_id.predict(texts, ["a", "b"], np.column_stack((matrix[:, 0], matrix[:, 0])))
    assert doubled[0] == ["a", "und", "a", "a"] and doubled[1] == pytest.approx([0.5, 0, 0.5, 0.5])  # of equals the first by name


def test_equal_cosines_all_vote():
    sims, labels = np.array([[0.9, 0.5, 0.5, 0.5, 0.1]]), np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    assert quality.vote(sims, labels, 2) == pytest.approx((0.9**8 + 0.5**8) / (0.9**8 + 3 * 0.5**8))


def test_keys_of_letters_and_parts_beside_other_spans():
    found = lambda t: [(k, t[a:b]) for k, a, b in secrets.find_secrets(t)]
    assert found("qXvBnMkLpRtWzYcFsDgHjK") == [("entropy", "qXvBnMkLpRtWzYcFsDgHjK")]
    for t in ("ThisIsACamelCaseNameOfSomething", "some_HTTP_header/of-A/long/Name", "abcdefghijklmnopqrstuvwxyz0123456789"):
        assert not found(t), t
    key = "qX7vB2nM9kL4pR8tW3zY6cF1"
    hexed = "0123abcd" * 4
    assert found(key + "Z" + hexed + "Z" + key) == [("entropy", key + "Z"), ("hex", hexed), ("entropy", "Z" + key)]
    assert found(key + "/abcdefghij/" + key) == [("entropy", key + "/"), ("entropy", "/" + key)]


def test_many_keys_in_one_text_take_time_as_its_length():
    import time

    text = " ".join("0123abcd" * 4 + " qX7vB2nM9kL4pR8tW3zY6cF1" for _ in range(20_000))
    began = time.time()
    assert len(secrets.find_secrets(text)) == 40_000
    assert time.time() - began < 20


def test_rules_from_a_table_broadcast_or_joined(spark, monkeypatch):
    r = random.Random(11)
    hosts = ["a.com", "b.a.com", "com", "c.net", "x.c.net"]
    table = list({(h, p): (r.choice(["allow", "block"]), h, p) for h in hosts for p in ("", "/en", "/en/", "/en/long/path/12", "/en/long/path/1", "/d")}.values())
    rules = spark.createDataFrame([*table, ("block", None, "/x"), ("allow", "q", None)], "verdict string, host string, path string")
    urls = [f"http://{r.choice(['', 'm.'])}{r.choice(hosts)}{r.choice(['', '/', '/en/long/path/123', '/en/7', '/e', '/de'])}" for _ in range(200)] + [None, "", "x"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id bigint, url string")
    rows = sorted(map(str, url_filter.judge_urls(df, rules).collect()))
    for x in url_filter.judge_urls(df, rules).collect():
        rule = plain_rule(urls[x.page_id or 0], table)[2]
        assert (x.rule, x.verdict) == ((rule[1] + rule[2], rule[0]) if rule else (None, "allow"))
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)
    assert sorted(map(str, url_filter.judge_urls(df, rules).collect())) == rows
    assert url_filter.judge_urls(df, rules.limit(0)).count() == len(rows)
