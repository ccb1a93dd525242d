"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

A token sequence is the encoding of its bytes exactly if every two neighbours are what their joined bytes encode to, so
only one token can end at a place, and a way through the piece is its encoding. A token is stable, and is emitted, once
the merge list's sufficient lookahead of bytes has come after it; what waits is bounded by that lookahead, not by the
piece. Every piece goes this way; a cache in front holds what the transducer gave for short pieces.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sliced, strings

#: The byte-level scheme's split pattern; ASCII separators 1C-1F are no white space in it. Fixed value.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Before such a space a piece always begins.
SAFE_CUT = regex.compile(r"(?<=[^\p{White_Space}])\x20(?=[^\p{White_Space}])")
CHUNK = 1 << 16
#: Characters of a piece that come to the transducer at once; longest piece, and number of pieces, whose ids are kept.
BLOCK = 1 << 12
KEPT, CACHE = 1 << 10, 200_000
_SHORT = (2, 1)


def byte_letters() -> dict[str, int]:
    """The scheme's letter of each byte: printable Latin-1 bytes stand for themselves, the rest for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """The ids of pieces; those of a piece not seen yet are found when they are asked for."""

    def __init__(self, coder: Transducer):
        super().__init__()
        self.coder = coder

    def __missing__(self, text: str) -> list[int]:
        # A piece of one block is all there at once.
        ids = self.coder._way(text.encode("utf-8", "replace"), -1)[0] if len(text) <= BLOCK else list(self.coder.piece(text))
        if len(text) <= KEPT:
            self[text] = ids
        return ids


class Transducer:
    """Encodes and decodes with one vocabulary file; ``path`` is a parameter, nothing is copied from the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = data["model"]
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.longest = max(map(len, self.id_of), default=1)
        self.by_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # Each rule as ids, and of each token the rule that makes it: its rank and the two parts.
        self.rule = {self.id_of[a] << 32 | self.id_of[b]: k for (a, b), k in self.rank.items()}
        self.made = {self.id_of[a + b]: (k, self.id_of[a], self.id_of[b]) for (a, b), k in self.rank.items()}
        self._edges: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}
        self._cache = _Pieces(self)

    @functools.cached_property
    def chain(self) -> int:
        """How many tokens what follows can change: the longest chain of rules by which a difference goes to the left.

        Merges go by rank. Of two continuations of the same bytes, the difference reaches one token x further left only by
        a rule (x, y) whose y stands in one of them alone. It then begins at x, so the next rule further left has a
        right part that begins with x (x is among the parts at its left edge), and a higher rank.
        """
        reach: dict[int, int] = {}
        longest = 0
        for pair in sorted(self.rule, key=self.rule.__getitem__):
            left, right = pair >> 32, pair & 0xFFFFFFFF
            n = 1 + max(reach.get(part, 0) for part, _ in self.edge(right, 0))
            reach[left] = max(reach.get(left, 0), n)
            longest = max(longest, n)
        return longest

    @functools.cached_property
    def lookahead(self) -> int:
        """The bytes after a token from which on nothing can change it any more: those of the chain's tokens."""
        return self.chain * self.longest

    @functools.cached_property
    def reach(self) -> dict[bytes, tuple[int, ...]]:
        """The lengths of the tokens that begin with each three bytes that any token begins with, and 2 and 1; longest first."""
        out: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                out.setdefault(token[:3], {1, 2}).add(len(token))
        return {k: tuple(sorted(v, reverse=True)) for k, v in out.items()}

    def merge(self, piece: bytes) -> list[bytes]:
        """The merge list applied as it is defined: the best-ranked pair first, the leftmost of equals. For short pieces."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at the token's left (0) or right (1) edge while it is being merged, the smallest first.

        Each with the rank of the rule that takes it up into the next.
        """
        found = self._edges[side].get(token)
        if found is None:
            found, gone, at = [], 1 << 60, token
            while True:
                found.append((at, gone))
                if at not in self.made:
                    break
                gone, at = self.made[at][0], self.made[at][1 + side]
            self._edges[side][token] = found = found[::-1]
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are what their joined bytes encode to.

        They are not if some rule joins the parts at their border before either part is taken up on its own side.
        """
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            left, right, rule = self.edge(a, 1), self.edge(b, 0), self.rule
            i = j = 0
            found = True
            while True:
                (x, x_gone), (y, y_gone) = left[i], right[j]
                rank = rule.get(x << 32 | y)
                if rank is not None and rank < x_gone and rank <= y_gone:
                    found = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_gone <= y_gone:
                    i += 1
                else:
                    j += 1
            if len(self._fits) >= CACHE:
                self._fits.clear()
            self._fits[key] = found
        return found

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that comes in blocks of bytes, each as soon as it is stable."""
        held, before = b"", -1
        for block in data:
            held += block
            if len(held) >= 2 * self.lookahead:
                out, ends = self._way(held, before)
                stable = bisect.bisect_right(ends, len(held) - self.lookahead)
                if stable:
                    yield from out[:stable]
                    held, before = held[ends[stable - 1] :], out[stable - 1]
        yield from self._way(held, before)[0]

    def _way(self, held: bytes, before: int) -> tuple[list[int], list[int]]:
        """The tokens of what is held after the token ``before``, and where each ends.

        By the longest next token that fits, going back where none does. A way that gets to the end is the encoding, as
        all neighbours fit. Only one token can end at a place, so a place from which there is no way on is never tried
        again.
        """
        get, known, fits, reach = self.id_of.get, self._fits.get, self.fits, self.reach.get
        size = len(held)
        ends, out, dead = [0], [before], set()
        begin, furthest = 0, size
        while begin < size:
            for length in reach(held[begin : begin + 3], _SHORT):
                end = begin + length
                if end > furthest:
                    continue
                token = get(held[begin:end])
                if token is not None and end not in dead:
                    fit = before < 0 or known(before << 32 | token)
                    if fit or fit is None and fits(before, token):
                        ends.append(end)
                        out.append(token)
                        begin, before, furthest = end, token, size
                        break
            else:
                if not begin:
                    raise ValueError("a byte without a token")
                dead.add(begin)
                furthest = ends.pop() - 1
                out.pop()
                begin, before = ends[-1], out[-1]
        return out[1:], ends[1:]

    def piece(self, text: str) -> Iterator[int]:
        return self.stream(text[k : k + BLOCK].encode("utf-8", "replace") for k in range(0, len(text), BLOCK))

    def chunks(self, text: str) -> Iterator[str]:
        """The text in chunks that begin where a piece begins."""
        begin = 0
        while begin < len(text):
            cut = SAFE_CUT.search(text, begin + CHUNK) if begin + CHUNK < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[begin:end]
            begin = end

    def encoded(self, text: str) -> Iterator[list[int]]:
        """Ids of the whole text in lists of bounded length; special tokens' strings in it become their ids."""
        begin = 0
        for m in self.by_special.finditer(text) if self.by_special else ():
            yield from self._plain(text[begin : m.start()])
            yield [self.special[m[0]]]
            begin = m.end()
        yield from self._plain(text[begin:] if begin else text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encoded(text)))

    def _plain(self, text: str) -> Iterator[list[int]]:
        cache = self._cache
        for part in self.chunks(text):
            if len(part) > 2 * CHUNK:
                # No space lets it be cut, so its pieces are taken one by one.
                yield from self._uncut(part)
                continue
            if len(cache) > CACHE:
                cache.clear()
            yield list(chain.from_iterable(map(cache.__getitem__, SPLIT.findall(part))))

    def _uncut(self, text: str) -> Iterator[list[int]]:
        out: list[int] = []
        for m in SPLIT.finditer(text):
            for token in self.piece(m[0]):
                out.append(token)
                if len(out) >= CHUNK:
                    yield out
                    out = []
        if out:
            yield out

    def decoded(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """The text of the ids, special tokens kept, by a byte-to-text state machine that goes on across tokens."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for part in ids:
            yield machine.decode(b"".join(map(get, part)))
        yield machine.decode(b"", final=True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decoded([ids]))


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each process and file."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """Encode every row's whole text and decode it again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``keep`` also ``ids`` and ``decoded``. A null text is the empty one: no tokens, hashes of the empty text. Of a
    very long text only a bounded number of ids is held at once (all with ``keep``). Texts are handled alone, so repeated
    rows give repeated rows, a null doc_id stays null, and an empty table gives none; there are no ties. Extra columns,
    whatever their names, play no part. ``path`` is read on the executors; by default it is the installed vocabulary file.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path or vocabulary())
        for batch in sliced(batches, 256):
            n, hashes, again, kept, texts = [], [], [], [], []
            for text in strings(batch, "text"):
                count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                all_ids: list[int] = []
                parts: list[str] = []

                def counted(text=text, of_ids=of_ids, all_ids=all_ids) -> Iterator[list[int]]:
                    nonlocal count
                    for ids in coder.encoded(text):
                        of_ids.update(("," * (count > 0) + ",".join(map(coder.text_of.__getitem__, ids))).encode())
                        count += len(ids)
                        if keep:
                            all_ids.extend(ids)
                        yield ids

                for part in coder.decoded(counted()):
                    of_text.update(part.encode("utf-8", "replace"))
                    if keep:
                        parts.append(part)
                n.append(count)
                hashes.append(of_ids.hexdigest())
                again.append(of_text.hexdigest())
                if keep:
                    kept.append(all_ids)
                    texts.append("".join(parts))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(again, pa.string())]
            if keep:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    more = ", ids array<int>, decoded string" if keep else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
