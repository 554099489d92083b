"""Quality rules by line sequence labelling.

Each line of a document gets features; a linear-chain conditional random field over the two labels
content and boilerplate is decoded by Viterbi, and the share of a document's words that stand in
content lines decides whether it stays. Beside it stand counted rules on the whole text (few words,
repeated words).

Labels grade documents, not lines, so lines are taught by their own evidence (evident()): a line that
shouts, is strewn with symbols or bars, or repeats an earlier line is boilerplate wherever it stands;
any other line is content in a good document and left open in a bad one. The field is fitted on lines
so labelled by gradient ascent on the likelihood of what is known, summed over what is open, with all lines
of at most FIT_DOCUMENTS labelled documents (chosen by a hash of their ids). Gradients are summed in
tasks, so a text of any length takes part whole. The weights are drawn towards PRIOR with the force of
PULL lines; without labels they are PRIOR. An id whose labels differ counts as bad; of rows that share an id
the least text is fitted on.

Nulls count as empty texts; those have no words, fail the base rules and have a content share of 0.
Repeated rows are judged alike; an empty table gives an empty one; columns of the input that bear the
names of those added are replaced. Labels without an id or a quality are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import Words, dropped, mix, per_slice, rolling, written

FIT_DOCUMENTS, ROUNDS, RATE, PULL = 2000, 25, 0.2, 15.0
CELLS = 20_000
"""Lines that a task works on at once when fitting (more for one longer text)."""
KEEP_SHARE = 0.5
FEATURES = ["bias", "log_words", "symbols", "upper_share", "digit_share", "pipes_a_word", "marks_a_word", "ends_sentence", "word_length", "repeated_share", "earlier_line"]
#: Weights for content, in the order of FEATURES; then transitions boilerplate and content to boilerplate and content.
PRIOR = np.array([2.0, 0.2, -6.0, -8.0, -2.0, -8.0, -8.0, 0.5, 0.0, -1.0, -3.0, 0.3, -0.3, -0.3, 0.3])
_SYMBOL, _UPPER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?:;\"')", np.uint8))


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


class Lines:
    """The lines of a column of texts: features, rows, words, and counts of each row."""

    def __init__(self, texts: pa.Array):
        self.w = w = Words(texts)
        rows = len(texts)
        self.end = np.flatnonzero(w.buf == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64) if len(self.end) else self.end
        self.row = np.searchsorted(w.at, self.start, "right") - 1
        first = np.searchsorted(w.start, self.start)
        last = np.searchsorted(w.start, self.end)
        self.words = last - first
        of_line = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))[self.end] - c[self.start]
        inside = np.zeros(len(w.buf) + 1, np.int64)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        inside = np.cumsum(inside)[:-1].astype(bool)
        whole = inside & ((w.buf & 0xC0) != 0x80)
        symbols, letters = of_line(_SYMBOL[w.buf]), of_line(whole)
        by_row = lambda x: np.bincount(self.row, weights=x, minlength=rows).astype(np.int64)
        self.word_chars, self.n_symbols = by_row(letters), by_row(symbols)

        key = w.hashes(self.start, self.end) ^ mix(self.row.astype(np.uint64) + np.uint64(1))
        full = np.flatnonzero(self.words > 0)
        _, firsts = np.unique(key[full], return_index=True)
        earlier = np.zeros(len(key), bool)
        earlier[full] = True
        earlier[full[firsts]] = False
        self.n_dup_lines = by_row(earlier)

        h = w.hashes()
        again = np.zeros(len(h) + 1, np.int64)
        if len(h) >= 3:
            n = len(h) - 2
            at = np.flatnonzero(w.row[:n] == w.row[2:])
            window = at[_repeated(rolling(h, 3)[at] ^ mix(w.row[at].astype(np.uint64) + np.uint64(1)))]
            np.add.at(again, window, 1)
            np.add.at(again, window + 3, -1)
        covered = np.cumsum(again)[:-1] > 0
        self.n_repeat_words = np.bincount(w.row, weights=covered, minlength=rows).astype(np.int64)
        c = np.concatenate([[0], np.cumsum(covered)])

        size, words = np.maximum(letters, 1), np.maximum(self.words, 1)
        tail = np.where(self.words > 0, w.end[np.maximum(last, 1) - 1] - 1, 0) if len(w.end) else np.zeros(len(self.end), np.int64)
        self.x = np.stack([
            np.ones(len(size)), np.log1p(self.words), np.minimum(10 * symbols / size, 2), of_line(_UPPER[w.buf]) / size, of_line(_DIGIT[w.buf]) / size,
            np.minimum(of_line(w.buf == 124) / words, 2), np.minimum(of_line(w.buf == 33) / words, 2), (_STOP[w.buf[tail]] & (self.words > 0)) if len(w.buf) else size * 0,
            np.minimum(letters / words, 20) / 10, (c[last] - c[first]) / words, earlier,
        ], axis=1).astype(np.float64) if len(size) else np.zeros((0, len(FEATURES)))
        self.count = np.bincount(self.row, minlength=rows)


def viterbi(score: list[float], step: list[float]) -> list[int]:
    """The best labels of a chain: score is that of content at each line; step the four transitions."""
    bb, bc, cb, cc = step
    b, c, back = 0.0, 0.0, []
    for k, s in enumerate(score):
        if k:
            from_b, from_c = (b + bb, b + bc), (c + cb, c + cc)
            back.append((from_c[0] > from_b[0], from_c[1] >= from_b[1]))
            b, c = max(from_b[0], from_c[0]), max(from_b[1], from_c[1])
        c += s
    out = [int(c >= b)]
    for x in reversed(back):
        out.append(int(x[out[-1]]))
    return out[::-1]


def evident(x: np.ndarray, good: bool) -> np.ndarray:
    """What is known of lines with these features: 0 boilerplate, 1 content, -1 open."""
    symbol, upper, pipes, marks, earlier = (x[:, FEATURES.index(c)] for c in ("symbols", "upper_share", "pipes_a_word", "marks_a_word", "earlier_line"))
    bad = (symbol > 0.5) | (upper > 0.6) | (pipes > 0.3) | (marks > 0.5) | (earlier > 0)
    return np.where(bad, 0, 1 if good else -1).astype(np.int8)


def _messages(x: np.ndarray, live: np.ndarray, known: np.ndarray, theta: np.ndarray, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected sums of the features of content lines and of the four transitions, over chains padded to one length, and log-partitions.

    clamp: labels that are known are held to.
    """
    longest, n, wide = x.shape
    s, a = np.zeros((longest, n, 2)), theta[wide:].reshape(2, 2)
    s[:, :, 1] = x @ theta[:wide]
    if clamp:
        for k in (0, 1):
            s[:, :, k] = np.where(known == 1 - k, -1e30, s[:, :, k])
    f, g = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
    f[0] = s[0]
    for k in range(1, longest):
        new = np.stack([np.logaddexp(f[k - 1, :, 0] + a[0, j], f[k - 1, :, 1] + a[1, j]) for j in (0, 1)], -1) + s[k]
        f[k] = np.where(live[k, :, None], new, f[k - 1])
    z = np.logaddexp(f[-1, :, 0], f[-1, :, 1])
    lines, pairs = np.zeros(wide), np.zeros((2, 2))
    for k in range(longest - 1, -1, -1):
        if k + 1 < longest:
            ahead = g[k + 1] + s[k + 1]
            g[k] = np.where(live[k + 1, :, None], np.stack([np.logaddexp(ahead[:, 0] + a[j, 0], ahead[:, 1] + a[j, 1]) for j in (0, 1)], -1), 0)
            pairs += (np.exp(f[k, :, :, None] + a + ahead[:, None, :] - z[:, None, None]) * live[k + 1, :, None, None]).sum(0)
        lines += (np.exp(f[k, :, 1] + g[k, :, 1] - z) * live[k]) @ x[k]
    return lines, pairs.ravel(), z


def gradient(chains: list[np.ndarray], known: list[np.ndarray], theta: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of what is known of these chains; then that likelihood and the number of lines known."""
    wide, total = len(FEATURES), np.zeros(len(FEATURES) + 6)
    order = sorted((k for k in range(len(chains)) if len(chains[k]) and (known[k] >= 0).any()), key=lambda k: len(chains[k]))
    while order:
        some = [order.pop()]  # the longest first
        longest = len(chains[some[0]])
        while order and (len(some) + 1) * longest <= CELLS:
            some.append(order.pop())
        x, live, y = np.zeros((longest, len(some), wide)), np.zeros((longest, len(some)), bool), np.full((longest, len(some)), -1, np.int8)
        for j, k in enumerate(some):
            x[: len(chains[k]), j], live[: len(chains[k]), j], y[: len(chains[k]), j] = chains[k], True, known[k]
        held, free = (_messages(x, live, y, theta, clamp) for clamp in (True, False))
        total += np.concatenate([held[0] - free[0], held[1] - free[1], [(held[2] - free[2]).sum(), (y >= 0).sum()]])
    return total


def fit(table: DataFrame) -> np.ndarray:
    """Weights (of FEATURES, then of the four transitions); table: x and known, binary, of each labelled document."""
    theta, m, v = PRIOR.copy(), np.zeros(len(PRIOR)), np.zeros(len(PRIOR))
    for t in range(1, ROUNDS + 1):

        def part(batches, theta=theta):
            total = np.zeros(len(PRIOR) + 2)
            for batch in batches:
                chains = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for x in batch.column("x").to_pylist()]
                total += gradient(chains, [np.frombuffer(x, np.int8) for x in batch.column("known").to_pylist()], theta)
            yield pa.RecordBatch.from_arrays([pa.array([k]) for k in total], names=[f"s{k}" for k in range(len(total))])

        sums = table.mapInArrow(part, ", ".join(f"s{k} double" for k in range(len(PRIOR) + 2))).agg(*(F.sum(f"s{k}") for k in range(len(PRIOR) + 2))).first()
        total = np.array([x or 0.0 for x in sums])
        if not total[-1]:
            return PRIOR
        grad = (total[: len(PRIOR)] - PULL * (theta - PRIOR)) / (total[-1] + PULL)
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad**2
        theta = theta + RATE * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-8)
    return theta


def fit_on(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The field's weights from labelled documents; labels: doc_id and quality (1: good)."""
    graded = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    some = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # FIT_DOCUMENTS rows at most

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("text"))
        x = np.split(lines.x.astype(np.float32), np.cumsum(lines.count)[:-1])
        known = [evident(part, q == 1).tobytes() for part, q in zip(x, batch.column("quality").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array([part.tobytes() for part in x], pa.binary()), pa.array(known, pa.binary())], names=["x", "known"])

    table = written(chosen.mapInArrow(per_slice(make), "x binary, known binary"))
    weights = fit(table)
    dropped(table)
    return weights


ADDED = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("n_lines", "long"), ("content_share", "double"), ("line_labels", "string"), ("kept", "boolean")]


def quality_rules(docs: DataFrame, weights: np.ndarray, keep_text: bool = True, text: str = "text") -> DataFrame:
    """All rows with the counts, base_failed, content_share, line_labels (a character for each line: C or B)
    and kept, which is false where base_failed and else says whether the content share is KEEP_SHARE or more."""
    docs = docs.drop(*(c for c, _ in ADDED))
    others = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in others])
    for c, kind in ADDED:
        schema = schema.add(c, T._parse_datatype_string(kind))
    wide, step = len(FEATURES), weights[len(FEATURES) :].tolist()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column(text))
        score = (lines.x @ weights[:wide]).tolist()
        words = lines.w.count
        marks, shares, at = [], np.zeros(len(words)), 0
        for k, n in enumerate(lines.count.tolist()):
            label = viterbi(score[at : at + n], step)
            shares[k] = (lines.words[at : at + n] * label).sum() / max(words[k], 1)
            marks.append("".join("BC"[x] for x in label))
            at += n
        failed = (words < 50) | (100 * lines.n_repeat_words > 50 * words)
        cols = [words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, lines.count, shares, marks, ~failed & (shares >= KEEP_SHARE)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, cols)], names=[*others, *(c for c, _ in ADDED)])

    return docs.mapInArrow(per_slice(make, text), schema)
