"""LM scoring: Brown class-based bigrams with exchange clustering, over counts of the whole corpus.

A word is a 59-bit hash with 5 bits of word shape (``SHAPES`` kinds) below. The ``CLUSTERED`` most frequent words form the
classes by exchange clustering, with every other word in a class of its shape; then each further word of the training texts
moves from its shape to the class of the highest likelihood, by its own neighbours' classes. A text's log-probability is the
sum over its tokens of log10 p(class | class before) + log10 p(word | class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, byte_table, cut, fold, sliced, strings, words

SHAPE_BITS = 5
SHAPES = 1 << SHAPE_BITS
END = np.uint64(SHAPES - 1)
#: Words in the exchange clustering, and those whose counts and classes are broadcast; further words are joined by shuffle.
CLUSTERED, BROADCAST = 2000, 131_072
CLASSES, ROUNDS = 64, 6
DISCOUNT, PRIOR = 0.5, 2.0
#: A neighbour's code, below how often it stood there; codes of classes stay below ``RARE``, the mark of a word joined later.
_CODES, RARE = 256, 255
#: Times whose likelihood gains are looked up, and neighbours that are weighed at once.
_TIMES, _WEIGHED = 32, 1 << 15
_BUFFER = 4_000_000
_MARKS = byte_table(bytes(i for i in range(33, 127) if not chr(i).isalpha()))
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def tokens(text: str) -> np.ndarray:
    """Keys of the text's words (A-Z lower-cased, split at white space) and the end token, key 31."""
    data = _UPPER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    starts, ends, hashes = words(data, WHITE)
    if not len(starts):
        return np.array([END])
    flat = lambda x: np.maximum.reduceat(x, starts).astype(np.uint64)  # noqa: E731  separators are never high and no marks
    size = np.minimum((ends - starts) // 3, 5).astype(np.uint64)
    shape = size + np.uint64(6) * (flat((data >= 128).view(np.uint8)) + np.uint64(2) * flat(_MARKS[data].view(np.uint8)))
    return np.append((hashes & ~np.uint64(SHAPES - 1)) | shape, END)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts one after another, and how many each has."""
    each = [tokens(x) for x in texts]
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), np.array([len(x) for x in each], np.int64)


def count_words(training: DataFrame) -> DataFrame:
    """``key, n`` of all tokens of ``text``: counted in each task's buffers, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        held: list[np.ndarray] = []
        for batch in sliced(batches):
            held.append(_flat(strings(batch, "text"))[0])
            if sum(map(len, held)) >= _BUFFER:
                yield out()
        if held:
            yield out()

    return training.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` words (``key, n``): all those whose count is high enough, by a histogram of counts."""
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toArrow().to_pandas().sort_values("level", ascending=False)
    fits = histogram[histogram.words.cumsum() <= most]
    if not len(fits):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    return counts.filter(level >= int(fits.level.min())).toArrow().to_pandas().sort_values(["n", "key"], ascending=[False, True])


class Symbols:
    """Numbers of the clustered words, then of the shapes (the end token's shape is the last)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.view(np.uint64))
        self.size = len(keys) + SHAPES

    def of(self, found: np.ndarray) -> np.ndarray:
        at, hit = _lookup(self.keys, found)
        return np.where(hit, at, len(self.keys) + (found & np.uint64(SHAPES - 1)).astype(np.int64))


def _lookup(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.searchsorted(keys, found)
    at[at == len(keys)] = 0
    return at, keys[at] == found


def count_bigrams(training: DataFrame, symbols: Symbols) -> np.ndarray:
    """The matrix of neighbouring symbols, each text between end tokens; bounded by (CLUSTERED + SHAPES) squared."""
    shared = training.sparkSession.sparkContext.broadcast(symbols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.size * own.size, np.int32)
        for batch in sliced(batches):
            flat, _ = _flat(strings(batch, "text"))
            if len(flat):
                s = own.of(flat)
                before = np.concatenate(([own.size - 1], s[:-1]))  # texts end in the end token, so it stands before the next
                codes, n = np.unique(before * own.size + s, return_counts=True)
                total[codes] += n.astype(np.int32)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 18)].astype(np.int32)), pa.array(total[at[k : k + (1 << 18)]])], ["pair", "n"])

    rows = training.select("text").mapInArrow(count, "pair int, n int").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols.size * symbols.size, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(symbols.size, symbols.size)


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol: words are moved, the most frequent first, to where the class bigrams' likelihood is highest.

    The shapes (symbols from ``n_words`` on) keep a class of their own. Ends when a round moves nothing.
    """
    size = len(bigrams)
    classes = max(1, min(classes, n_words))
    total = classes + size - n_words
    of = np.concatenate([np.zeros(n_words, np.int64), classes + np.arange(size - n_words)])
    order = np.argsort(-bigrams[:n_words].sum(axis=1), kind="stable")
    of[order] = np.arange(n_words) % classes
    onehot = np.eye(total)[of]
    right = bigrams @ onehot  # symbol before, class after
    left = bigrams.T @ onehot  # symbol after, class before
    pairs = onehot.T @ right
    own = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            a, self_n = of[w], float(bigrams[w, w])
            r, le = right[w].copy(), left[w].copy()
            n_out, n_in = r.sum(), le.sum()
            if not n_out and not n_in:
                continue
            r[a] -= self_n
            le[a] -= self_n
            # Take w out of its class.
            pairs[a] -= r
            pairs[:, a] -= le
            pairs[a, a] -= self_n
            row, column = pairs.sum(axis=1), pairs.sum(axis=0)
            rows_gain = _nlogn(pairs[own] + r) - _nlogn(pairs[own])
            cols_gain = _nlogn(pairs[:, own].T + le) - _nlogn(pairs[:, own].T)
            gain = rows_gain.sum(axis=1) + cols_gain.sum(axis=1)
            gain += -rows_gain[own, own] - cols_gain[own, own] + _nlogn(pairs[own, own] + r[own] + le[own] + self_n) - _nlogn(pairs[own, own])
            gain -= _nlogn(row[own] + n_out) - _nlogn(row[own]) + _nlogn(column[own] + n_in) - _nlogn(column[own])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += r
            pairs[:, b] += le
            pairs[b, b] += self_n
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return of


def neighbours(training: DataFrame, symbols: Symbols, of: np.ndarray) -> DataFrame:
    """``key, found`` of the words outside the clustering: what stands beside them, counted in each task's buffers.

    An entry is times * _CODES + code; with T classes the code is the class after, T + the class before, or 2 T for the word
    itself, which is one pair. A word's occurrences each have one before, so these and the pairs with itself add up to its count.
    """
    shared, total = training.sparkSession.sparkContext.broadcast((symbols, of.astype(np.int64))), int(of.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, classes_of = shared.value

        def out():
            keys, at = np.unique(np.concatenate(held[0]), return_inverse=True)
            pairs, n = np.unique(at * _CODES + np.concatenate(held[1]), return_counts=True)
            for part in held:
                part.clear()
            word, code = np.divmod(pairs, _CODES)
            begins = np.searchsorted(word, np.arange(len(keys) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(begins), pa.array(n * _CODES + code))], ["key", "found"])

        held: tuple[list, list] = ([], [])
        for batch in sliced(batches):
            flat, _ = _flat(strings(batch, "text"))
            if len(flat):
                s = own.of(flat)
                c = classes_of[s]
                further = s >= len(own.keys)
                further &= flat != END
                before, after = np.append(END, flat[:-1]), np.append(flat[1:], END)
                left, right = np.append(c[len(c) - 1 :], c[:-1]), np.append(c[1:], c[len(c) - 1 :])  # the last token is an end token
                to_right, to_left, twice = further & (after != flat), further & (before != flat), further & (before == flat)
                held[0].extend((flat[to_right], flat[to_left], flat[twice]))
                held[1].extend((right[to_right], total + left[to_left], np.full(int(twice.sum()), 2 * total)))
            if sum(map(len, held[0])) >= _BUFFER // 2:
                yield out()
        if sum(map(len, held[0])):
            yield out()

    return training.select("text").mapInArrow(count, "key bigint, found array<bigint>")


class Gains:
    """The class of the highest likelihood for words that leave their shape, each against the same class bigrams."""

    def __init__(self, pairs: np.ndarray):
        self.pairs, self.total = pairs.astype(float), len(pairs)
        self.n = n = self.total - SHAPES
        self.cells = np.concatenate((self.pairs[:n].T, self.pairs[:, :n]))  # by code, what each class has there
        times = np.arange(_TIMES + 1)[:, None, None]
        self.table = _nlogn(self.cells + times) - _nlogn(self.cells)

    def best(self, shape: np.ndarray, word: np.ndarray, code: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Class of each word; its neighbours ``word, code, times`` are in order of the words, at least one for each."""
        n, total, m = self.n, self.total, len(shape)
        side, j = np.divmod(code, total)
        gain = np.zeros((len(word), n))
        near = np.zeros((2, m, n))
        inner = (side < 2) & (j < n)
        near[side[inner], word[inner], j[inner]] = times[inner]
        counted = lambda k: np.bincount(word[side == k], times[side == k], minlength=m)
        right, left, twice = counted(0), counted(1), counted(2)
        own = (side < 2) & (j == n + shape[word])
        few = (side < 2) & ~own & (times <= _TIMES)
        gain[few] = self.table[times[few], code[few]]
        many = (side < 2) & ~own & (times > _TIMES)
        gain[many] = _nlogn(self.cells[code[many]] + times[many, None]) - _nlogn(self.cells[code[many]])
        # Neighbours of the word's own shape: its pairs are first taken out of there.
        rest = np.maximum(self.cells[code[own]] - near[1 - side[own], word[own]], 0)
        gain[own] = _nlogn(rest + times[own, None]) - _nlogn(rest)
        gain = np.add.reduceat(gain, np.searchsorted(word, np.arange(m)), axis=0)
        # Within a class the pairs of both sides, and the word's with itself, are one cell's.
        diagonal = self.pairs.diagonal()[:n]
        w, c = np.nonzero((near[0] > 0) & (near[1] > 0))
        r, le, p = near[0, w, c], near[1, w, c], diagonal[c]
        gain[w, c] += _nlogn(p + r + le) - _nlogn(p + r) - _nlogn(p + le) + _nlogn(p)
        w = np.flatnonzero(twice)
        inside = diagonal + near[0, w] + near[1, w]
        gain[w] += _nlogn(inside + twice[w, None]) - _nlogn(inside)
        for margin, more in ((self.pairs.sum(axis=1)[:n], right + twice), (self.pairs.sum(axis=0)[:n], left + twice)):
            gain -= _nlogn(margin + more[:, None]) - _nlogn(margin)
        return gain.argmax(axis=1)


def assign(found: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``key, n, class`` of every word of ``neighbours``: a group-by on the word, streamed in the order of the words."""
    shared = found.sparkSession.sparkContext.broadcast(Gains(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value

        def out(keys: np.ndarray, entries: np.ndarray):
            new = np.append(True, keys[1:] != keys[:-1])
            merged, at = np.unique((np.cumsum(new) - 1) * _CODES + entries % _CODES, return_inverse=True)
            times = np.bincount(at, entries // _CODES).astype(np.int64)
            word, code = np.divmod(merged, _CODES)
            words_of = keys[new]
            shape = words_of & (SHAPES - 1)
            n = np.bincount(word[code >= gains.total], times[code >= gains.total], minlength=len(words_of)).astype(np.int64)
            begins = np.searchsorted(word, np.arange(len(words_of) + 1))
            classes, first = [], 0
            while first < len(words_of):
                last = max(first + 1, int(np.searchsorted(begins, begins[first] + _WEIGHED, "right")) - 1)
                x = slice(begins[first], begins[last])
                classes.append(gains.best(shape[first:last], word[x] - first, code[x], times[x]))
                first = last
            return pa.RecordBatch.from_arrays([pa.array(words_of), pa.array(n), pa.array(np.concatenate(classes).astype(np.int32))], ["key", "n", "class"])

        keys, entries = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("found")
            keys = np.append(keys, np.repeat(batch.column("key").to_numpy(), lists.value_lengths().to_numpy()))
            entries = np.append(entries, lists.flatten().to_numpy())
            if len(keys):
                # The last word may go on in the next batch.
                whole = len(keys) - int((keys[::-1] != keys[-1]).argmax() if keys[0] != keys[-1] else len(keys))
                if whole:
                    yield out(keys[:whole], entries[:whole])
                    keys, entries = keys[whole:], entries[whole:]
        if len(keys):
            yield out(keys, entries)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, n bigint, class int")


class Known:
    """What is broadcast to number the tokens: the BROADCAST most frequent words with counts and classes.

    ``unseen`` is the class of a word of each shape that no training text has: the one that most further words of the shape
    have, or most further words of any; without such words the shape keeps its class.
    """

    def __init__(self, known: pd.DataFrame, symbols: Symbols, of: np.ndarray, broadcast: pd.DataFrame, by_shape: pd.DataFrame):
        order = np.argsort(known.key.to_numpy().view(np.uint64))
        self.keys, self.counts = known.key.to_numpy().view(np.uint64)[order], known.n.to_numpy()[order].astype(float)
        self.end = int(of[-1])
        self.classes = np.full(len(self.keys), self.end, np.int64)
        for keys, classes in ((symbols.keys, of[: len(symbols.keys)]), (broadcast.key.to_numpy().view(np.uint64), broadcast["class"].to_numpy())):
            at, hit = _lookup(self.keys, keys)
            assert hit.all()
            self.classes[at] = classes
        self.unseen = of[len(symbols.keys) :].copy()
        table = np.zeros((SHAPES, int(of.max()) + 1))
        table[by_shape["shape"].to_numpy(), by_shape["class"].to_numpy()] = by_shape["words"].to_numpy()
        if len(by_shape):
            self.unseen[:-1] = np.where(table.any(axis=1), table.argmax(axis=1), table.sum(axis=0).argmax())[:-1]


def steps(pairs: np.ndarray) -> np.ndarray:
    """log10 p(class | class before), less the log10 of the class's tokens, by which each word's count is divided."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    step = np.log10((pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
    return step - np.log10(np.maximum(pairs.sum(axis=0), 1))


def discounted(count: np.ndarray) -> np.ndarray:
    """log10 of the discounted count; a word never seen has the discount alone."""
    return np.log10(np.where(count > 0, count - DISCOUNT, DISCOUNT))


def class_pairs(numbered: DataFrame, total: int, end: int) -> np.ndarray:
    """The matrix of neighbouring classes in ``codes``, each text between end tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total * total, np.int64)
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).astype(np.int64)
            if len(c):
                n += np.bincount(np.append(end, c[:-1]) * total + c, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    rows = numbered.select("codes").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(total * total)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(total, total)


def number(rows: DataFrame, known: Known, further: DataFrame, n: int, v: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, numerator, codes``: the class of each token, one byte, and the sums.

    The words that are not broadcast are joined with ``further`` by a shuffle on the word, as many rows as a text has
    different ones, and brought back to their text by a shuffle on the row, which is streamed in order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        for batch in sliced(batches, 256):
            flat, sizes = _flat(strings(batch, "text"))
            of_text = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            at, hit = _lookup(k.keys, flat)
            codes = np.full(len(flat), RARE, np.uint8)
            numerator, base_log = np.zeros(len(flat)), np.zeros(len(flat))
            if len(k.keys):
                count = k.counts[at[hit]]
                codes[hit] = k.classes[at[hit]]
                numerator[hit] = discounted(count)
                base_log[hit] = np.log10((count + 1) / (n + v + 1))
            elif len(flat):  # nothing to learn from: the end token alone is told apart
                codes[flat == END] = k.end
                numerator[flat == END], base_log[flat == END] = discounted(np.zeros(1)), -np.log10(n + v + 1)
                hit = hit | (flat == END)
            add = lambda x: np.bincount(of_text, x, minlength=len(sizes))
            n_known = add(hit).astype(np.int64) if len(k.keys) else np.zeros(len(sizes), np.int64)
            rest = np.flatnonzero(~hit)
            # Different further words of each text, with their places in the order of the text's further words.
            order = rest[np.lexsort((flat[rest], of_text[rest]))]
            new = np.ones(len(order), bool)
            new[1:] = (flat[order[1:]] != flat[order[:-1]]) | (of_text[order[1:]] != of_text[order[:-1]])
            rare = order[new]
            begins = np.searchsorted(of_text[rare], np.arange(len(sizes) + 1))
            which = np.empty(len(flat), np.int32)
            which[order] = np.cumsum(new) - 1
            raw, places = codes.tobytes(), [which[rest[a:b]] - begins[i] for i, (a, b) in enumerate(zip(*(np.searchsorted(of_text[rest], np.arange(len(sizes)) + x) for x in (0, 1)), strict=True))]
            nothing = len(rare)
            texts = np.concatenate((np.arange(len(sizes)), of_text[rare]))
            column = lambda own: pa.concat_arrays([own, pa.nulls(nothing, own.type)])
            number_of = np.arange(nothing) - begins[of_text[rare]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row").take(pa.array(texts)),
                    pa.array(np.concatenate((np.full(len(sizes), -1), number_of)).astype(np.int32)),
                    pa.array(np.concatenate((-1 - batch.column("_row").to_numpy(), flat[rare].view(np.int64)))),
                    column(batch.column("doc_id")),
                    column(batch.column("held_out")),
                    *(column(pa.array(x)) for x in (sizes, n_known, add(base_log), add(numerator))),
                    column(pa.array([raw[a : a + b] for a, b in zip(first.tolist(), sizes.tolist(), strict=True)], pa.binary())),
                    column(pa.array([x.astype(np.int32).tobytes() for x in places], pa.binary())),
                ],
                ["_row", "_at", "key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "numerator", "codes", "places"],
            )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value

        def out(table: pa.Table):
            at = table["_at"].to_numpy()
            begins = np.flatnonzero(at < 0)
            ends = np.append(begins[1:], len(at))
            count = table["n"].to_numpy()
            classes = np.where(count > 0, table["class"].to_numpy(), k.unseen[table["key"].to_numpy() & (SHAPES - 1)])
            logs, base_logs = discounted(count), np.log10((count + 1) / (n + v + 1))
            own = table.take(pa.array(begins))
            n_known, base, numerator = (own[c].to_numpy().copy() for c in ("n_known", "base_score", "numerator"))
            codes = own["codes"].to_pylist()
            for i, (a, b, raw) in enumerate(zip(begins.tolist(), ends.tolist(), own["places"].to_pylist(), strict=True)):
                if raw:
                    x = a + 1 + np.frombuffer(raw, np.int32)
                    n_known[i] += int((count[x] > 0).sum())
                    base[i] += base_logs[x].sum()
                    numerator[i] += logs[x].sum()
                    text = np.frombuffer(codes[i], np.uint8).copy()
                    text[text == RARE] = classes[x]
                    codes[i] = text.tobytes()
            columns = [own["doc_id"], own["held_out"], own["n_tokens"], *(pa.array(x) for x in (n_known, base, numerator)), pa.array(codes, pa.binary())]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "numerator", "codes"]
            return pa.Table.from_arrays(columns, names).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_at").to_numpy() < 0)
            if not len(begins):
                held.append(batch)
                continue
            # The last text's words may go on in the next batch.
            held.append(batch.slice(0, begins[-1]))
            if table := pa.Table.from_batches(held):
                yield from out(table)
            held = [batch.slice(begins[-1])]
        if held:
            yield from out(pa.Table.from_batches(held))

    spread = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        local,
        f"_row bigint, _at int, key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, numerator double, codes binary, places binary",
    )
    # A text's own row travels under a key of its own, so that no null key gathers them.
    joined = spread.join(further, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", F.lit(0)))
    return joined.repartition("_row").sortWithinPartitions("_row", "_at").mapInArrow(
        resolve, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, numerator double, codes binary"
    )


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Score every row's whole text.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``: learned from the rows whose
    crc32(doc_id) modulo ``modulus`` is not ``held`` (never from a null doc_id, whose ``held_out`` is false). The base is
    the add-one unigram; ``score`` is the class model's log10 probability and ``perplexity`` 10 ** (-score / n_tokens).
    A null or empty text is its end token alone. With nothing to learn from all counts are 0. Repeated rows are learned
    from and scored each; an empty table gives none. Very long texts are taken whole, in parts. Words of one count are
    ranked by their key, and of classes alike in likelihood the lower one is taken, so ties fall the same way each time.
    Extra columns, whatever their names, play no part.

    Counts, neighbours and class bigrams cover all training texts and every one of their words.
    """
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"))
    training = docs.filter(fold("doc_id", modulus) != held)
    counts = cut(count_words(training))
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = sums.n or 0, sums.v
    frequent = most_frequent(counts, BROADCAST)
    symbols = Symbols(frequent.key.to_numpy()[frequent.key.to_numpy() != int(END)][:CLUSTERED])
    bigrams = count_bigrams(training, symbols)
    of = exchange(bigrams, len(symbols.keys))
    total = int(of.max()) + 1
    onehot = np.eye(total)[of]
    further = cut(assign(neighbours(training, symbols, of), onehot.T @ bigrams @ onehot))
    shape = F.col("key").bitwiseAND(F.lit(SHAPES - 1)).cast("int").alias("shape")
    by_shape = further.groupBy(shape, "class").agg(F.count("*").alias("words")).toArrow().to_pandas()
    least = int(frequent.n.min()) if len(frequent) else 1 << 62
    broadcast = further.filter(F.col("n") >= least).select("key", "class").toArrow().to_pandas()
    known = Known(frequent, symbols, of, broadcast, by_shape)
    numbered = cut(number(rows, known, further.filter(F.col("n") < least), n, v))
    pairs = class_pairs(numbered.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")), total, known.end)
    shared, end = docs.sparkSession.sparkContext.broadcast(steps(pairs)), known.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in sliced(batches):
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8)
            first = np.append(0, np.cumsum(batch.column("n_tokens").to_numpy())[:-1])
            own = np.add.reduceat(step[np.append(np.uint8(end), c[:-1]), c], first) + batch.column("numerator").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(own)], [*batch.schema.names[:5], "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = numbered.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )
