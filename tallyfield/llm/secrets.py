"""Secret scans: fixed patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, strings

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in any text that ASSIGN matches.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WINDOW = 20
#: Character classes of candidates, the narrowest first, and the least entropy in bits of a window of WINDOW characters.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), None),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0),
    ("upper", re.compile(r"[A-Z0-9]+"), 3.4),
    ("lower", re.compile(r"[a-z0-9]+"), 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
#: Words of one case or capitalised, numbers, or one letter.
_PART = r"(?:(?:[A-Z]?+[a-z]{2,}+|(?:As|At|Be|By|Do|Id|If|In|Is|It|My|No|Of|On|Or|To|Up)(?![a-z])|[A-Z]{2,}+)++|[0-9]++|[A-Za-z])"
#: Candidates that are no secrets: UUIDs; paths and dashed or underscored numbers and words, each of one case or with a
#: capital before small letters. Letters in any other mix of cases are no words.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(rf"{_PART}(?:[/_+-]++{_PART})*+[/_+=-]*+"),
)
#: Runs of an alphabet, which are no secrets; what stands beside one in a candidate is looked at by itself.
ALPHABETS = re.compile("0123456789|abcdefghij(?:klmnopqrst(?:uvwxyz)?)?|ABCDEFGHIJ(?:KLMNOPQRST(?:UVWXYZ)?)?")


def window_entropy(candidate: str, window: int = WINDOW, enough: float = math.inf) -> float:
    """Highest Shannon entropy in bits of any window, by counts kept up as the window slides; ends at ``enough``."""
    n = min(window, len(candidate))
    if not n:
        return 0.0
    bits = [0.0, *(k * math.log2(k) for k in range(1, n + 2))]
    counts: dict[str, int] = {}
    total = best = 0.0  # total: sum of count * log2(count)
    for i, c in enumerate(candidate):
        k = counts.get(c, 0)
        total += bits[k + 1] - bits[k]
        counts[c] = k + 1
        if i >= n:
            gone = candidate[i - n]
            k = counts[gone]
            total += bits[k - 1] - bits[k]
            counts[gone] = k - 1
        if i >= n - 1:
            best = max(best, math.log2(n) - total / n)
            if best >= enough:
                break
    return best


def is_random(candidate: str) -> bool:
    if any(x.fullmatch(candidate) for x in ALLOWED):
        return False
    least = next(bits for _, x, bits in CLASSES if x.fullmatch(candidate))
    return least is not None and window_entropy(candidate, enough=least) >= least


def _outside(begin: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of begin:end of WINDOW characters or more that the spans, in order of their starts, leave."""
    for a, b in taken:
        if a - begin >= WINDOW:
            yield begin, a
        begin = max(begin, b)
    if end - begin >= WINDOW:
        yield begin, end


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; ``entropy`` only where no other span lies.

    Base spans and candidates are both walked once, in order.
    """
    found = []
    low = text.lower()
    if any(x in low for x in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    at, reach = 0, 0  # spans before ``at`` end before the candidate, but for one that may end at ``reach``
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        while at < len(base) and base[at][0] < begin:
            reach = max(reach, base[at][1])
            at += 1
        taken = [(begin, reach)] if reach > begin else []
        while at < len(base) and base[at][0] < end:
            taken.append(base[at])
            reach = max(reach, base[at][1])
            at += 1
        for a, b in _outside(begin, end, taken):
            for x, y in _outside(a, b, [r.span() for r in ALPHABETS.finditer(text, a, b)]):
                if is_random(text[x:y]):
                    found.append(("entropy", x, y))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame) -> DataFrame:
    """Every row's secrets: ``doc_id, spans array<struct<kind, start, end>>``, whole texts, in code points.

    A null or empty text has no spans; very long texts are taken whole, in time that grows as they do. Spans of one kind
    never overlap; those of different patterns may, and then all are kept, by start and then kind. Rows are handled alone:
    repeated rows give repeated rows, a null doc_id stays null, and an empty table gives none. Extra columns, whatever
    their names, play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t)] for t in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``scan``'s: counts of the base kinds and the joined span texts."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), counts[3])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask`` (overlapping spans by one) and ``n_chars`` to fit.

    All rows, repeated ones and those with a null doc_id too, and all other columns, whatever their names, stay as they are;
    a text without secrets, null and empty ones too, is untouched. Very long texts are scanned whole; an empty table gives
    none. Entropy tells no keys of one case of letters alone: such runs count as words.
    """
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            out = []
            for text in texts:
                done, pieces = 0, []
                for _, a, b in find_secrets(text or ""):
                    if a >= done:
                        pieces += [text[done:a], mask]
                    done = max(done, b)
                out.append("".join([*pieces, text[done:]]) if pieces else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k)
                columns[k] = pa.array([n if a is b or a == b else len(b) for a, b, n in zip(texts, out, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_type(c.type) for f, c in zip(batch.schema, columns, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
