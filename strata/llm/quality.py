"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the classes' log-count ratio, a linear hinge-loss model is
fitted to them by dual coordinate descent, and its margins become probabilities by a logistic
curve fitted to margins of rows the model had not seen. The n-grams are of word shapes, which
say how a text is written, not what about.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.features import SIZE, Numbers, shape_ngrams

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: most labelled rows the model is fitted to (those with the smallest hash of their id)
SAMPLE = 8000


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[x].sum() + self.bias for x in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.slope * self.margins(rows) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def held_out() -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 25, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights on indicators and bias of the L2-regularised hinge-loss model of ``scale``d indicators; ``y`` in -1, 1."""
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(y))
    values = [scale[x] for x in rows]
    norm = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (v @ w[x] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[x] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3 * cost.max():
            break
    return w * scale, bias


def _fit(rows: list[np.ndarray], y: np.ndarray, cost: float, smooth: float = 1.0) -> Model:
    p, q = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for x, good in zip(rows, y > 0):
        (p if good else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == smooth) & (q == smooth)] = 0.0  # not seen: says nothing
    share = np.array([(y == -1).mean(), (y == 1).mean()])  # both classes weigh the same
    c = cost * np.where(y > 0, share[0], share[1]) * 2
    w, b = dual_descent(rows, y, ratio, c)
    return Model(w, b)


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of margins (Newton steps with a weak prior)."""
    spread = m.std() or 1.0
    z, t = m / spread, (y > 0).astype(float)
    t = t * 0.98 + 0.01
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        r, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-3 * a, r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return a / spread, b


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 0.05) -> Model:
    """The model of rows of feature ids and labels 0 and 1; with one class or none, a constant one."""
    y = np.where(np.asarray(labels, int) > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        return Model(np.zeros(SIZE), 0.0, 1.0, 0.0 if not len(y) else 4.0 * y[0])
    m = np.zeros(len(y))
    for k in range(3):  # margins of rows that the model has not seen
        out = np.arange(len(y)) % 3 == k
        if len(set(y[~out])) == 2:
            m[out] = _fit([r for r, o in zip(rows, out) if not o], y[~out], cost).margins([r for r, o in zip(rows, out) if o])
    model = _fit(rows, y, cost)
    model.slope, model.shift = _calibrate(m, y)
    return model


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``x``: the feature ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            x = [shape_ngrams(t.as_py() or "", numbers) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(x, pa.list_(pa.int64()))], [*keep, "x"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, x array<long>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = 0.05) -> Model:
    """Fit to at most ``sample`` labelled rows that are not held out. Rows without id or label are left out;
    a document labelled more than once takes its lowest label."""
    own = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    got = features(rows, ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toPandas()
    return fit([np.asarray(x, np.int64) for x in got["x"]], got["quality"].tolist(), cost)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``docs`` -> ``SCHEMA``, a row a row; with ``columns``: those columns of the rows that are predicted 1.

    Null text counts as empty; a null id is not held out; texts are scored whole; repeated rows stay repeated and score
    alike; columns other than ``doc_id`` and ``text`` are ignored, or with ``columns`` passed on, whatever their names. An
    empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, m = Numbers(), sent.value
        for b in batches:
            s = m.scores([shape_ngrams(t.as_py() or "", numbers) for t in b.column("text")])
            if columns:
                yield b.filter(pa.array(s >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if columns:
        rows = docs.select(*columns)
        return rows.mapInArrow(run, rows.schema)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("out"), "text").mapInArrow(run, SCHEMA)
