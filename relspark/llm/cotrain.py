"""Quality classifier by co-training of two views.

One logistic classifier sees a document's content (shares of symbols, capitals, digits, repeats,
lengths of words and lines), another its metadata (source, language, length). In each of ROUNDS
rounds both are fitted on the labelled documents and on the pseudo-labels that the other view gave
with CONFIDENT probability or more in the round before, at weight PSEUDO_WEIGHT. Then each view is
calibrated (Platt) on the labelled documents of a fold that no fit has seen, and the calibrated
log-odds are added, less the prior's, to score every document.

Content is read once, into a small table of features in the shared folder. A step of a fit is one pass
over it: tasks sum up gradients and curvature, GROUPS tasks sum those up, and the driver solves a
system as wide as the view. So all labelled and all confident documents count, at any size.

Nulls count as empty texts, unknown sources and languages and length 0. Documents whose id is null or
not labelled are only scored. Without labels of both kinds every score is the prior's (0.5 without any).
An id whose labels differ counts as bad. Repeated rows are scored alike and teach as often as they stand there;
texts of any length are read whole; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import per_slice, written
from relspark.llm.quality import FEATURES, Lines

ROUNDS, STEPS = 3, 4
CONFIDENT, PSEUDO_WEIGHT = 0.95, 0.3
FOLDS = 5
HASHED = 24
GROUPS = 64
KEEP = 0.5
RIDGE = 1.0
CONTENT_WIDTH, META_WIDTH = len(FEATURES) + 3, 3 + 2 * HASHED


def _content(batch: pa.RecordBatch) -> pa.RecordBatch:
    lines = Lines(batch.column("text"))
    n, words = batch.num_rows, np.maximum(lines.w.count, 1)
    weighted = lines.x * lines.words[:, None]
    x = np.zeros((n, CONTENT_WIDTH), np.float32)
    for k in range(len(FEATURES)):
        x[:, k] = np.bincount(lines.row, weights=weighted[:, k], minlength=n) / words
    x[:, 0] = 1
    x[:, len(FEATURES)] = np.log1p(lines.w.count)
    x[:, len(FEATURES) + 1] = lines.n_dup_lines / np.maximum(lines.count, 1)
    x[:, len(FEATURES) + 2] = lines.n_repeat_words / words
    ids, chars = batch.column("doc_id").cast(pa.int64()), np.nan_to_num(batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False))
    meta = np.zeros((n, META_WIDTH), np.float32)
    meta[:, 0], meta[:, 1] = 1, np.log1p(np.maximum(chars, 0))
    meta[:, 2] = meta[:, 1] ** 2 / 10
    for at, c in enumerate(("lang_hash", "source_hash")):
        meta[np.arange(n), 3 + at * HASHED + batch.column(c).to_numpy() % HASHED] = 1
    return pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], names=["doc_id", "content", "meta"])


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content and meta (binary, 32-bit floats), label (double; null: none) and held_out, written."""
    hashed = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(HASHED)).alias(f"{c}_hash")
    slim = docs.select("doc_id", "text", "n_chars", hashed("lang"), hashed("source"))
    x = slim.mapInArrow(per_slice(_content), "doc_id long, content binary, meta binary")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    return written(x.join(known, "doc_id", "left").withColumn("held_out", F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)))


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _summed(table: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a vector of this size."""

    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["g", "v"])

    def add(group: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.float64) for x in group.column("v").to_pylist())
        return pa.table({"v": pa.array([v.tobytes()], pa.binary())})

    rows = table.mapInArrow(part, "g long, v binary").groupBy("g").applyInArrow(add, "v binary").collect()  # GROUPS at most
    return sum((np.frombuffer(r.v, np.float64) for r in rows), np.zeros(size))


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log-likelihood, end to end."""
    p = _sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (y - p)), (x.T @ (x * (weight * p * (1 - p))[:, None])).ravel()])


def _solve(sums: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    n = len(w)
    step = np.linalg.solve(sums[n:].reshape(n, n) + ridge * np.eye(n), sums[:n] - ridge * w)
    return w + step * min(1, 10 / max(np.abs(step).max(), 1e-12))


class Model:
    """Weights of both views, their calibration and the prior's log-odds."""

    def __init__(self):
        self.w = [np.zeros(CONTENT_WIDTH), np.zeros(META_WIDTH)]
        self.platt = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]
        self.prior = 0.0

    def raw(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        return [_matrix(batch, c, len(w)) @ w for c, w in zip(("content", "meta"), self.w)]

    def scores(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Calibrated probabilities of content, metadata and both."""
        a, b = (p[0] + p[1] * z for p, z in zip(self.platt, self.raw(batch)))
        return [_sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)]


def fit(table: DataFrame) -> Model:
    model = Model()
    label = lambda batch: batch.column("label").to_numpy(zero_copy_only=False)
    held = lambda batch: batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    both = lambda batch: np.array([np.nansum(y == k) for y in [label(batch)] for k in (0.0, 1.0)], float)
    bad, good = _summed(table, both, 2)
    model.prior = float(np.log(max(good, 0.5) / max(bad, 0.5))) if good + bad else 0.0
    if not bad or not good:
        model.platt = [np.array([model.prior, 0.0])] * 2
        return model
    sizes = [len(w) * (len(w) + 1) for w in model.w]
    for turn in range(ROUNDS):
        teacher = [w.copy() for w in model.w]

        def of(batch, teacher=teacher, turn=turn):
            xs = [_matrix(batch, c, len(w)) for c, w in zip(("content", "meta"), teacher)]
            y, out = label(batch), []
            mine = ~np.isnan(y) & ~held(batch)
            for view in (0, 1):
                target, weight = np.where(mine, np.nan_to_num(y), 0), mine.astype(float)
                if turn:  # what the other view is sure of, where no label is known
                    p = _sigmoid(xs[1 - view] @ teacher[1 - view])
                    sure = np.isnan(y) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                    target, weight = np.where(sure, p >= 0.5, target), np.where(sure, PSEUDO_WEIGHT, weight)
                out.append(_moments(xs[view], target, weight, model.w[view]))
            return np.concatenate(out)

        for _ in range(STEPS):
            sums = _summed(table, of, sum(sizes))
            model.w = [_solve(s, w) for s, w in zip(np.split(sums, [sizes[0]]), model.w)]
    for _ in range(STEPS):

        def calibrate(batch):
            at = held(batch)
            y = np.nan_to_num(label(batch))
            return np.concatenate([_moments(np.stack([np.ones(len(z)), z], 1), y, at.astype(float), p) for z, p in zip(model.raw(batch), model.platt)])

        sums = _summed(table.where("held_out"), calibrate, 12)
        model.platt = [_solve(s, p, 1e-3) for s, p in zip(np.split(sums, 2), model.platt)]
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, meta_score, score (probabilities of good), kept (score KEEP or more), held_out (labelled and not fitted on)."""
    table = features(docs, labels)
    model = fit(table)
    shape = "doc_id long, content_score double, meta_score double, score double, kept boolean, held_out boolean"

    def run(batches):
        for batch in batches:
            s = model.scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, s), pa.array(s[2] >= KEEP), batch.column("held_out")], names=[c.split()[0] for c in shape.split(", ")])

    return table.mapInArrow(run, shape)
