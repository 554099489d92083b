"""Katz backoff of any order (three words by default) over the whole corpus.

Documents are coded once: a slice of them becomes one row with its distinct words and each token's place
among those. Whatever a slice must know of the corpus it asks of tables that are dealt by hash: it sends
each distinct n-gram once, with how often it was seen in training; the bucket sums up over all slices and
answers. So a word or n-gram in a third of all texts is one entry a slice, and a bucket's size depends on
the number of buckets, which follows the input. There is a table for each length, each asked with what the
one before has answered:

1. words, compared letter by letter: a number, small for frequent words, and the count;
2. and longer n-grams, as the numbers of their words, dealt by their history (all words but the last): the
   count, which discounts the history leaves room for, and, where an n-gram was not seen, the numbers of its history's
   followers by count and the sum of their lower-order masses. An n-gram comes with its own lower-order count
   from each slice that has seen it in training, so a bucket needs no other table. The n-grams of a history seen HOT times or more are dealt to as many
   buckets as that takes; what these have summed up meets in an ordinary aggregation by history.

P(w | h) = d(r) r / c(h) where the n-gram's count r is not 0, else alpha(h) P(w | h'), h' being h without
its first word, down to P(w) = d(r) r / N; where h was not seen, P(w | h'). What discounting leaves at the end is the
probability of the one unknown word. Good-Turing discounts d hold for counts up to GT_MAX where the counts of counts
allow, for each length apart. alpha(h) is what makes P(. | h) sum to one; where nothing would be left for unseen
words, one is added to the denominator. All n-grams count, however rare.

The first words' histories are end tokens. Nulls count as empty texts, whose only token is the end; a null
doc_id trains unless the checksum of the empty text keeps it out; repeated rows count as often as they stand there; an
empty table gives an empty one. Texts of any length are read whole; other columns are left alone. The rows
of docs are to come in the same order whenever a task is run again, as they do from files: write() others first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import SPACE, Words, mix, release, slices
from relspark.llm.substring import pack, unpack

ORDER = 3
GT_MAX = 5
HELD_OUT = (7, 2)
BUCKET_CHARS = 4 << 20
CODED_BYTES = 4 << 20
"""Bytes of text that are coded as one row: the more, the fewer times an n-gram is sent."""
HOT = 1 << 16
END = b"\n"  # no word holds it
STRIDE = 0x9E3779B1
STATE = "slice long, ids binary, none binary, held binary, size binary, lens binary, chars binary, counts binary, tokens binary"
ASKED = "bucket long, slice long, k array<binary>, p binary, q binary, split binary"
MET = "slice long, bucket long, v binary, w binary, e binary, f binary, hs array<array<long>>, hist array<long>, n array<long>, low double"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
GROUPS = 256
"""Groups in which the buckets' sums are added up first."""
COUNTED = GT_MAX + 3  # the total, the number of distinct ones, and those that occur 1 to GT_MAX + 1 times


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training: by the checksum of its id (none: of the empty text)."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _schema(shape: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([pa.field(c.split()[0], kinds[c.split()[1]]) for c in shape.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _strings(lens: np.ndarray, chars: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lens)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars))])


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the characters, end to end."""
    _, ends, chars = strings.buffers()
    at = np.frombuffer(ends, "<i8")[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, "<i8")
    return np.diff(at).astype("<u4"), np.frombuffer(chars, np.uint8)[at[0] : at[-1]] if at[-1] else np.zeros(0, np.uint8)


def _packed(columns: list[np.ndarray]) -> list[bytes]:
    """Columns of rows that are mostly in order: a column as differences from the row before where all earlier columns are the same there."""
    kind = "<u4" if max(int(c.max(initial=0)) for c in columns) < 1 << 32 else "<u8"
    out, same = [], None
    for c in columns:
        c = c.astype(kind)
        step = np.diff(c, prepend=c.dtype.type(0))  # wraps round below 0
        out.append(kind[2].encode() + pack(step if same is None else np.where(same, step, c)))
        still = np.concatenate([[False], c[1:] == c[:-1]]) if len(c) else np.zeros(0, bool)
        same = still if same is None else same & still
    return out


def _unpacked(data: list[bytes]) -> list[np.ndarray]:
    out, same = [], None
    for x in data:
        kind = f"<u{x[:1].decode()}"
        step = unpack(x[1:], kind)
        c = np.cumsum(step, dtype=kind)
        if same is not None and len(c):
            start = np.flatnonzero(~same)
            base = np.concatenate([np.zeros(1, kind), c])[start]  # before each run
            c = c - np.repeat(base, np.diff(np.append(start, len(c))))
        out.append(c.astype("<u8"))
        still = np.concatenate([[False], c[1:] == c[:-1]]) if len(c) else np.zeros(0, bool)
        same = still if same is None else same & still
    return out


def _places(lens: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of words."""
    w, ends = Words.__new__(Words), np.cumsum(lens, dtype=np.int64)
    w.buf = chars
    return w.hashes(ends - lens, ends)


def coded(docs: DataFrame) -> DataFrame:
    schema = _schema(STATE)

    def row(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, counts = [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts])
        found = pa.chunked_array([p[2] for p in parts]).combine_chunks().dictionary_encode()
        n = len(counts)
        tokens = np.zeros(len(found) + n, np.int64)  # the end is word 0
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(counts + 1) - 1] = False
        tokens[inside] = found.indices.to_numpy() + 1
        words = pa.concat_arrays([pa.array([END], pa.large_binary()), found.dictionary])
        held = np.array([held_out(i) for i in ids], bool)
        every = np.bincount(tokens, minlength=len(words))
        order = np.argsort(-every, kind="stable")  # tokens are kept as ranks, which are mostly small
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        train = np.bincount(tokens[~np.repeat(held, counts + 1)], minlength=len(words))
        lens, chars = _parts(words.take(pa.array(order)))
        cols = (number, pack(np.array([i or 0 for i in ids], "<i8")), pack(np.array([i is None for i in ids])), pack(held), pack((counts + 1).astype("<u4")), pack(lens), pack(chars), pack(train[order].astype("<u4")), pack(rank[tokens].astype("<u4")))
        return _batch([cols], schema)

    def run(batches):
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, least=CODED_BYTES):
                w = Words(part.column("text"), lower=True)
                parts.append((part.column("doc_id").to_pylist(), w.count, _strings(w.end - w.start, w.buf[~SPACE[w.buf]])))
                size += len(w.buf)
                if size >= CODED_BYTES:
                    yield row(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield row(number, parts)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, STATE)


def discounts(of: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to GT_MAX + 1 (the last holds for all above), from the numbers of things counted 1 to GT_MAX + 1 times."""
    d = np.ones(GT_MAX + 2)
    n = [0, *of]
    common = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT_MAX + 1):
        if n[r] and n[r + 1] and common < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    d[0] = 0
    return d


def ranked(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of columns of whole numbers from 0, and where a new one begins in it.
    Mostly a row and its place fit 64 bits; sorting such numbers takes about a third of the time of sorting places by values."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    n = len(columns[0])
    last = n.bit_length()
    if sum(bits) + last <= 64:
        key = columns[0].astype(np.uint64)
        for c, b in zip(columns[1:], bits[1:]):
            key <<= np.uint64(b)
            key |= c.astype(np.uint64, copy=False)
        key <<= np.uint64(last)
        key |= np.arange(n, dtype=np.uint64)
        return _ordered(key, last)
    order = np.lexsort(columns[::-1])
    return order, _differ(columns, order)


def _ordered(key: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys that hold their places in the last bits: these in the keys' order, and where the bits before them change."""
    key.sort()
    order = (key & np.uint64((1 << last) - 1)).astype(np.int64)
    key >>= np.uint64(last)
    return order, _differ([key])


def _differ(columns: list[np.ndarray] | tuple[np.ndarray, ...], order: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Where rows in an order are not the same as the row before."""
    new = np.ones(len(columns[0][order]), bool)
    new[1:] = False
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return new


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of whole numbers from 0, in order, and the place of each row among them."""
    order, new = ranked(*columns)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = order[new]
    return [c[first] for c in columns], inverse


class Level:
    """The distinct n-grams of one length in a slice, by bucket: their history and their lower-order n-gram (both as places
    among the n-grams one shorter), their last word, and each token's n-gram."""

    bucket: np.ndarray
    hist: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    of: np.ndarray
    split: np.ndarray  # whether its history is dealt to several buckets
    count: np.ndarray  # in all of training, once answered


class Slice:
    """A row of the state, with levels below upto, which have been answered, and (unless it is the last) the one to ask."""

    def __init__(self, row: dict, buckets: int, upto: int, hot: int = HOT, last: bool = False):
        self.number, self.row, self.buckets, self.hot = row["slice"], row, buckets, hot
        self.size, self.held = unpack(row["size"], "<u4").astype(np.int64), unpack(row["held"], "bool")
        lens, chars = unpack(row["lens"], "<u4"), unpack(row["chars"], "u1")
        self.words, h = _strings(lens, chars), _places(lens, chars)
        self.asked, self.high = np.argsort(h, kind="stable"), 64 - (buckets - 1).bit_length()
        self.word_bucket = (h[self.asked] >> np.uint64(self.high)).astype(np.int64)
        if upto < 2:
            return
        rank, count = (np.empty(len(h), np.int64) for _ in range(2))
        rank[self.asked] = answer(row["a1"], "v", "<u4") * np.int64(buckets) + self.word_bucket
        count[self.asked] = answer(row["a1"], "w", "<u8")
        order = np.argsort(rank)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = unpack(row["tokens"], "<u4")
        self.end = int(place[_index(self.words, END)])
        self.first = np.cumsum(self.size) - self.size
        one = Level()
        one.word, one.count = rank[order], count[order]
        one.of = np.append(place.astype(np.int32)[tokens], np.int32(self.end))  # the last is no token: a history of ends
        self.hash = mix(one.word.astype(np.uint64))
        one.bucket = (mix(self.hash) >> np.uint64(self.high)).astype(np.int32)
        self.levels = {1: one}
        self.d = {k: discounts(row[f"s{k}"][2:]) for k in range(1, upto)}
        for k in range(2, upto + (not last)):
            self.levels[k] = self.level(k)
            if k < upto:
                self.levels[k].count = answer(row[f"a{k}"], "v", "<u8").astype(np.int64)

    def history_counts(self, k: int) -> np.ndarray:
        """How often each n-gram of k - 1 words was a history in training."""
        below = self.levels[k - 1]
        if k == 2:
            return below.count
        counts = below.count.copy()
        counts[below.of[-1]] = self.levels[1].count[self.end]
        return counts

    def level(self, k: int) -> Level:
        below, one, out = self.levels[k - 1], self.levels[1], Level()
        hist = np.empty(len(below.of), np.int32 if len(below.of) < 1 << 31 else np.int64)  # places and buckets are small
        hist[1:] = below.of[:-1]
        hist[self.first] = hist[-1] = below.of[-1]
        # A history has one share of n-grams for each bucket that it is dealt to. Shares are numbered by bucket.
        split = np.minimum(1 + self.history_counts(k) // self.hot, self.buckets)
        start = np.cumsum(split) - split
        owner = np.repeat(np.arange(len(split), dtype=hist.dtype), split)
        bucket = np.repeat(below.bucket, split)
        if dealt := len(owner) > len(split):
            at = np.flatnonzero((split > 1)[owner])
            bucket[at] = (bucket[at] + (at - start[owner[at]]) * STRIDE) % self.buckets
        by = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")  # of 16 bits: by counting
        place = np.empty(len(by), hist.dtype)
        place[by] = np.arange(len(by))
        share = place[start][hist]
        if dealt:
            hot = np.flatnonzero((split > 1)[hist])
            h = hist[hot]
            share[hot] = place[start[h] + (self.hash[one.of[hot]] % split[h].astype(np.uint64)).astype(np.int64)]
        order, new = ranked(share, one.of)
        out.of = np.empty(len(order), hist.dtype)
        out.of[order] = np.cumsum(new, dtype=hist.dtype) - 1
        first = order[new]
        by = by[share[first]]
        out.bucket, out.hist, out.word, out.lower = bucket[by], owner[by], one.of[first], below.of[first]
        out.split = (split > 1)[out.hist]
        return out

    def mass(self, k: int) -> np.ndarray:
        count = self.levels[k].count
        return self.d[k][np.minimum(count, GT_MAX + 1)] * count

    def columns(self, k: int, which: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """The numbers of the words of n-grams, word by word."""
        at = self.levels[k]
        if k == 1:
            return [at.word[which]]
        return [*self.columns(k - 1, at.hist[which]), self.levels[1].word[at.word[which]]]

    def request(self, k: int) -> tuple[np.ndarray, Callable]:
        """Of each key its bucket (ascending), and what to send of a run of keys."""
        if k == 1:
            words, counts = self.words.take(pa.array(self.asked)), unpack(self.row["counts"], "<u4")[self.asked]
            return self.word_bucket, lambda i, j: ([pack(x) for x in _parts(words.slice(i, j - i))], pack(counts[i:j]), None, None)
        at, columns, d = self.levels[k], self.columns(k), self.d[k - 1].astype("<f8").tobytes()
        seen = np.bincount(at.of[:-1][~np.repeat(self.held, self.size)], minlength=len(at.word)).astype("<u4")
        lower = np.where(seen > 0, self.levels[k - 1].count[at.lower], 0).astype("<u4")  # only what was seen has a mass
        return at.bucket, lambda i, j: ([*_packed([c[i:j] for c in columns]), d], pack(seen[i:j]), pack(lower[i:j]), pack(at.split[i:j]))

    def probabilities(self, order: int) -> np.ndarray:
        """Of each n-gram of the greatest length."""
        total, _, *of = self.row["s1"]
        d, one = self.d[1], self.levels[1]
        left = 1 - sum(d[r] * r * of[r - 1] for r in range(1, GT_MAX + 1)) / max(total, 1) - (total - sum(r * of[r - 1] for r in range(1, GT_MAX + 1))) / max(total, 1)
        over = total if left >= 1e-9 else total + 1  # nothing for unknown words: one is added to the denominator
        p = np.where(one.count > 0, self.mass(1) / max(over, 1), left if left >= 1e-9 else 1 / over)
        norm = np.full(1, float(max(over, 1)))  # of the masses of the n-grams below, by their history
        below = np.zeros(len(one.word), np.int64)
        for k in range(2, order + 1):
            at, d, counts = self.levels[k], self.d[k], self.history_counts(k)
            runs, zero = _runs(at.hist, at.split, at.count)
            mask, some = np.zeros(len(counts), np.uint8), runs[zero]
            mask[runs] = answer(self.row[f"a{k}"], "w", "u1")
            numbers, low = answer(self.row[f"a{k}"], "e", "<u4").reshape(-1, GT_MAX), answer(self.row[f"a{k}"], "f", "<f8")
            if told := self.row.get(f"x{k}"):
                mine = np.unique(at.hist[at.split])
                place = {tuple(key): h for h, *key in zip(mine.tolist(), *(c.tolist() for c in self.columns(k - 1, mine)))}
                hot = [place[tuple(x["hist"])] for x in told]
                mask[hot] = [sum(1 << r for r in range(GT_MAX) if x["n"][r]) for x in told]
                some = np.concatenate([some, hot])
                numbers, low = np.concatenate([numbers, [x["n"][:GT_MAX] for x in told]]), np.concatenate([low, [x["low"] for x in told]])
            room = sum(1 << r for r in range(GT_MAX) if d[r + 1] < 1)
            over = np.maximum(counts + ((mask & room) == 0), 1).astype(np.float64)
            alpha = np.ones(len(counts))  # where it matters: some n-gram of a history that was seen was not
            some, numbers, low = (x[counts[some] > 0] for x in (some, numbers, low))
            kept = counts[some] - (numbers * ((1 - d[1 : GT_MAX + 1]) * np.arange(1, GT_MAX + 1))).sum(1)
            alpha[some] = (1 - kept / over[some]) / np.maximum(1 - low / norm[below[some]], 1e-12)
            none, lower = np.flatnonzero(at.count == 0), p
            p = self.mass(k) / over[at.hist]
            p[none] = alpha[at.hist[none]] * lower[at.lower[none]]
            norm, below = over, at.lower
        return p


def _index(words: pa.Array, word: bytes) -> int:
    return pc.index(words, pa.scalar(word, words.type)).as_py()


def _runs(hist: np.ndarray, split: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the histories that are not split, in the order of their n-grams: which they are, and whether one of their n-grams was not seen."""
    at = np.flatnonzero(~split)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = hist[at]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[start], np.logical_or.reduceat(count[at] == 0, start)


def answer(parts: list | None, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpack(p[name], kind) for p in parts or [])])


def _stats(counts: np.ndarray) -> list[int]:
    return [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, GT_MAX + 2).astype(np.int64), minlength=GT_MAX + 3)[1 : GT_MAX + 2].tolist()]


def _meet_words(group: pa.Table) -> pa.Table:
    rows = group.sort_by("slice").to_pydict()
    words = pa.chunked_array([_strings(unpack(k[0], "<u4"), unpack(k[1], "u1")) for k in rows["k"]]).combine_chunks().dictionary_encode()
    of = words.indices.to_numpy()
    counts = np.bincount(of, weights=np.concatenate([unpack(p, "<u4") for p in rows["p"]]), minlength=len(words.dictionary)).astype("<u8")
    rank = np.empty(len(counts), "<u4")
    rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(counts))
    out, at = [(-1 - rows["bucket"][0] % GROUPS, None, None, None, None, None, [], None, _stats(counts), 0.0)], 0
    for number, bucket, k in zip(rows["slice"], rows["bucket"], rows["k"]):
        mine = of[at : at + len(unpack(k[0], "<u4"))]
        out.append((number, bucket, pack(rank[mine]), pack(counts[mine]), None, None, [], None, None, None))
        at += len(mine)
    return pa.Table.from_batches([_batch(out, _schema(MET))])


def _grouped(columns: list[np.ndarray], key: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal n-grams stand together, where a new one begins in it, and a number of the history of each distinct one.
    Hashes of n-grams and histories tell them apart as long as no two share one; otherwise the words' numbers do."""
    i = len(key).bit_length()  # entries and hashes cut to what these leave are sorted as one number
    cut = lambda x: x >> np.uint64(i) << np.uint64(i) | np.arange(len(x), dtype=np.uint64)
    order, new = _ordered(cut(key), i)
    if (new == _differ(columns, order)).all():
        head = order[new]
        by, first = _ordered(cut(history[head]), i)
        if (first == _differ(columns[:-1], head[by])).all():
            hist = np.empty(len(head), np.int64)
            hist[by] = np.cumsum(first) - 1
            return order, new, hist
    order, new = ranked(*columns)
    return order, new, np.cumsum(_differ(columns[:-1], order)[new]) - 1


def _meet(group: pa.Table) -> pa.Table:
    rows = group.sort_by("slice").to_pydict()
    each = [_unpacked(k[:-1]) for k in rows["k"]]
    d = np.frombuffer(rows["k"][0][-1], "<f8")  # the discounts of the lower order, alike in all rows
    size = [len(k[0]) for k in each]
    columns = [np.concatenate(c) for c in zip(*each)]
    del each, group
    seen, lower, split = (np.concatenate([unpack(x, kind) for x in rows[c]]) for c, kind in (("p", "<u4"), ("q", "<u4"), ("split", "bool")))
    lower = d[np.minimum(lower, GT_MAX + 1)] * lower
    h = np.zeros(len(split), np.uint64)
    for c in columns[:-1]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    w = mix(columns[-1])
    order, head, hist = _grouped(columns, mix(h + w * np.uint64(0xD6E8FEB86659FD93)), h)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    lower = np.maximum.reduceat(lower[order], np.flatnonzero(head))  # 0 from slices that have not seen the n-gram
    counts = np.bincount(of, weights=seen).astype(np.int64)
    n_hist = int(hist.max()) + 1
    numbers = np.stack([np.bincount(hist, weights=counts == r, minlength=n_hist) for r in range(1, GT_MAX + 1)], 1).astype("<u4")
    low = np.bincount(hist, weights=lower, minlength=n_hist)
    mask = ((numbers > 0) << np.arange(GT_MAX)).sum(1).astype("u1")
    out, at = [(-1 - rows["bucket"][0] % GROUPS, None, None, None, None, None, [], None, _stats(counts), 0.0)], 0
    hot = np.unique(hist[of[split]], return_index=True)
    entry = np.flatnonzero(split)[hot[1]] if len(hot[0]) else []
    for g, k in zip(hot[0].tolist(), list(entry)):
        out.append((-1 - GROUPS - (int(h[k]) >> 2), None, None, None, None, None, [], [int(c[k]) for c in columns[:-1]], numbers[g].tolist() + [0] * (COUNTED - GT_MAX), float(low[g])))
    for number, bucket, n in zip(rows["slice"], rows["bucket"], size):
        mine, apart = of[at : at + n], split[at : at + n]
        runs, zero = _runs(hist[mine], apart, counts[mine])
        some = at + np.flatnonzero(apart)
        hs = sorted(set(zip(*(c[some].tolist() for c in columns[:-1])))) if len(some) else []
        out.append((number, bucket, pack(counts[mine].astype("<u8")), pack(mask[runs]), pack(numbers[runs[zero]].ravel()), pack(low[runs[zero]]), [list(x) for x in hs], None, None, None))
        at += n
    return pa.Table.from_batches([_batch(out, _schema(MET))])


def parts(buckets: int) -> int:
    """Partitions of the state and of its answers: its rows take megabytes, so most partitions are to hold one row or none.
    A bucket takes as many characters as a row, so there are at least half as many buckets as rows, mostly more."""
    return buckets


def ask(state: DataFrame, k: int, buckets: int, hot: int) -> DataFrame:
    """state with the answers to the n-grams of k words (a), the sums over all buckets (s), and the sums of split histories (x)."""

    def send(batches):
        schema = _schema(ASKED)
        for batch in batches:
            for at in range(batch.num_rows):
                s = Slice(batch.slice(at, 1).to_pylist()[0], buckets, k, hot)
                bucket, part = s.request(k)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                rows = [(b, s.number, *part(i, j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                for some in range(0, len(rows), 64):
                    yield _batch(rows[some : some + 64], schema)
                del s, rows, part
        release()

    # Slices are numbered from 0 on; what belongs to no slice has a number below 0, from its history. So one exchange deals
    # out all that the buckets have found. Its uses read all columns, in one order, so that it is made and dealt once.
    met = state.mapInArrow(send, ASKED).groupBy("bucket").applyInArrow(_meet_words if k == 1 else _meet, MET).where("slice is not null")
    sums = [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(COUNTED)]
    some = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "v", "w", "e", "f"))
    every = met.repartition(parts(buckets), "slice").groupBy("slice", "hist").agg(F.sort_array(F.collect_list(some)).alias("a"), F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"), *sums, F.sum("low").alias("low"))
    read = (F.size("a") >= -1) & (F.size("hs") >= -1) & (sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(COUNTED)), F.lit(0)) >= -1) & (F.coalesce("low", F.lit(0.0)) >= -1)
    numbers = F.array(*(F.coalesce(f"n{i}", F.lit(0)) for i in range(COUNTED)))
    total = every.where(F.when(read & (F.size("a") == 0), F.col("hist").isNull()).otherwise(False))
    total = total.agg(F.array(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(COUNTED))).alias(f"s{k}")).withColumn("one", F.lit(1))
    mine = every.where(read & (F.size("a") > 0)).select("slice", F.col("a").alias(f"a{k}"))
    out = state.join(mine, "slice", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # one row
    if k > 1:
        one = lambda hist, slice_, n, low: F.struct(hist.alias("hist"), slice_.alias("slice"), n.alias("n"), low.alias("low"))
        nothing = F.lit(None)
        asked = F.transform("hs", lambda h: one(h, F.col("slice"), nothing.cast("array<bigint>"), nothing.cast("double")))
        split = F.array(one(F.col("hist"), nothing.cast("bigint"), numbers, F.col("low")))
        both = every.where(read).select(F.explode(F.when(F.size("a") > 0, asked).otherwise(split)).alias("row")).select("row.*").where("hist is not null")
        of = Window.partitionBy("hist")  # the slices that ask for a split history, beside its sums
        told = both.select("slice", "hist", F.max("n").over(of).alias("n"), F.max("low").over(of).alias("low")).where("slice is not null")
        out = out.join(told.groupBy("slice").agg(F.collect_list(F.struct("hist", "n", "low")).alias(f"x{k}")), "slice", "left")
    return out


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words) and score of each document."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(32, 1 << (chars // BUCKET_CHARS).bit_length())
    state = coded(docs).repartition(parts(buckets), "slice")
    for k in range(1, order + 1):
        state = ask(state, k, buckets, hot)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                s = Slice(batch.slice(at, 1).to_pylist()[0], buckets, order + 1, hot, last=True)
                row, (total, kinds, *_) = s.row, s.row["s1"]
                one, tokens = s.levels[1].count, s.levels[1].of[:-1]
                p = s.probabilities(order)[s.levels[order].of[:-1]]
                ids = pa.array(unpack(row["ids"], "<i8"), mask=unpack(row["none"], "bool"))
                sums = [np.add.reduceat(x, s.first) for x in ((one > 0)[tokens].astype(np.int64), np.log10((one + 1.0) / (total + kinds + 1.0))[tokens], np.log10(p))]
                cols = [ids, pa.array(s.held), pa.array(s.size), pa.array(sums[0]), pa.array(np.full(len(s.size), total, np.int64)), *map(pa.array, sums[1:])]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in RESULT.split(", ")])
                del s, row, one, tokens, p, sums, cols
        release()

    return state.mapInArrow(run, RESULT)
