"""SQL of the operators on groups that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"('0x' || substring(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT"
    steps = "list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda i: {byte}), lambda a, b: {steps}, 4294967295::BIGINT), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _leaf(text: str) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, leaves: str, levels: int, arity: int) -> list[str]:
    """Levels of nodes (g, idx, n, digest) of each group; a group's last level is the one with a single node."""
    out = [f"{name}0 AS (SELECT * FROM {leaves})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
  SELECT g, idx // {arity} AS idx, (n + {arity - 1}) // {arity} AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
  FROM {name}{k} WHERE n > 1 GROUP BY g, idx // {arity}, n)""")
    return out


def _siblings(name: str, level: int, arity: int) -> str:
    """The digests before and after each node of a level within its run."""
    order = f"PARTITION BY g, idx // {arity} ORDER BY idx ROWS BETWEEN"
    return (
        f"SELECT g, idx, coalesce(string_agg(digest, '') OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
        f"coalesce(string_agg(digest, '') OVER ({order} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{level} WHERE n > 1"
    )


def manifest_sql(levels: int = 6, arity: int = 16, modulus: int = 5) -> str:
    """The Merkle manifest of up to arity ** levels rows a source and as many sources."""
    parts = [
        f"""l AS (
  SELECT doc_id, source AS g, {_leaf("text")} AS digest,
         CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % {modulus} = 0 THEN {_leaf(_lower("text"))} END AS changed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l
)""",
        *_tree("a", "(SELECT g, idx, n, digest FROM numbered)", levels, arity),
        "subs AS (" + " UNION ALL ".join(f"SELECT g, digest FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        "tops AS (SELECT g AS source, digest, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM subs)",
        *_tree("b", "(SELECT 0 AS g, idx, n, digest FROM tops)", levels, arity),
        "root AS (" + " UNION ALL ".join(f"SELECT digest FROM b{k} WHERE n = 1" for k in range(levels + 1)) + ")",
    ]
    start = "SELECT m.doc_id, m.g, m.digest AS leaf, s.digest AS subroot, s.idx AS top, root.digest AS root, m.idx, coalesce(m.changed, m.digest) AS fold, '' AS path FROM numbered m JOIN tops s ON m.g IS NOT DISTINCT FROM s.source, root"
    parts.append(f"f0 AS ({start})")
    for k in range(2 * levels):
        name, level, at, group = ("a", k, "idx", "f.g IS NOT DISTINCT FROM s.g") if k < levels else ("b", k - levels, "top", "true")
        parts.append(f"""f{k + 1} AS (
  SELECT f.doc_id, f.g, f.leaf, f.subroot, f.top, f.root, f.idx,
         CASE WHEN s.idx IS NULL THEN f.fold ELSE sha256(s.before || f.fold || s.after) END AS fold,
         f.path || coalesce(s.before || s.after, '') AS path
  FROM f{k} f LEFT JOIN ({_siblings(name, level, arity)}) s ON {group} AND s.idx = f.{at} // {arity**level})""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{2 * levels}"


def spelling_sql(ratio: int = 10, spoiled: int = 31, rounds: int = 5) -> str:
    """Spelling variants: pairs meet by the word with one place blanked or left out."""
    steps = [
        f"r{k + 1} AS (SELECT r.word, coalesce(t.root, r.root) AS root FROM r{k} r LEFT JOIN r{k} t ON r.root = t.word)"
        for k in range(rounds)
    ]
    return f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, {_lower("run")} AS run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM lowered
), spoiled AS (
  SELECT CASE WHEN h % {spoiled} = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), blanked AS (
  SELECT word, n, unnest(list_transform(range(0, length(word)::BIGINT), lambda i: left(word, i::INT) || '_' || substring(word, (i + 2)::INT))) AS k FROM w
), cut AS (
  SELECT word, n, unnest(list_distinct(list_transform(range(0, length(word)::BIGINT), lambda i: left(word, i::INT) || substring(word, (i + 2)::INT)))) AS k FROM w
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM blanked a JOIN blanked b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.k = w.word
  UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.k = w.word
), best AS (
  SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {ratio} * w.n THEN b.near END AS form, CASE WHEN b.m >= {ratio} * w.n THEN b.m END AS form_n
  FROM w LEFT JOIN best b ON w.word = b.word AND b.place = 1
), r0 AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
), {", ".join(steps)}
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN r{rounds} r ON f.word = r.word
"""
