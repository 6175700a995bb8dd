"""Toxicity severity by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(w.x - cut_k)`` with one weight vector ``w`` for all cuts, fitted by
gradient steps on sparse word features. Labels are binary, so the grades of toxic training rows
come from the labels' own vocabulary: grade 2 if more of the words that set toxic rows apart
occur than in the median toxic row, else 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.features import SIZE, word_tables, words

SCHEMA = "doc_id long, p_toxic double, p_severe double, expected_severity double, grade int, toxic boolean"
#: most labelled rows the model is fitted to (those with the smallest hash of their id)
SAMPLE = 8000


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    weight: np.ndarray
    cuts: np.ndarray

    def above(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade > k), a row a row, a column a cut."""
        z = np.array([self.weight[x] @ (1 + np.log(n)) for x, n in rows])
        return _sigmoid(z[:, None] - self.cuts[None, :])


def grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Severity grades 0, 1, 2 and the log-odds of the words (0 for rare ones)."""
    p, q = np.zeros(SIZE), np.zeros(SIZE)
    for (x, _), t in zip(rows, toxic):
        (p if t else q)[x] += 1
    np_, nq = max(1, toxic.sum()), max(1, (~toxic).sum())
    ratio = np.log((p + 0.5) / (np_ + 1)) - np.log((q + 0.5) / (nq + 1))
    ratio[p + q < 5] = 0
    apart = (ratio > 3) & (p >= 5)
    hits = np.array([apart[x].sum() for x, _ in rows])
    middle = np.median(hits[toxic]) if toxic.any() else 0
    return np.where(toxic, 1 + (hits > middle), 0), ratio


def loss(z: np.ndarray, first: float, gap: float, y: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """The mean loss of grades ``y`` at latent scores ``z``, and what it changes by with each score, the first cut, and the log of the gap to the second.

    The gap is a power, so the cuts stay in order.
    """
    g = np.exp(gap)
    a, b = _sigmoid(z - first), _sigmoid(z - first - g)  # P(y > 0), P(y > 1)
    # of P(y=0) = 1-a, P(y=1) = a-b, P(y=2) = b
    da, db = a * (1 - a), b * (1 - b)
    mid = np.maximum(a - b, 1e-12)
    ga = np.where(y == 0, a, np.where(y == 1, -da / mid, 0.0))
    gb = np.where(y == 2, -(1 - b), np.where(y == 1, db / mid, 0.0))
    cost = -np.log(np.maximum(np.where(y == 0, 1 - a, np.where(y == 1, mid, b)), 1e-300)).mean()
    return cost, (ga + gb) / len(y), -(ga + gb).mean(), -gb.mean() * g


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], steps: int = 250, l2: float = 2e-4, rate: float = 0.3) -> Model:
    """The model of (word ids, counts) rows. Without both classes nothing is toxic."""
    t = np.asarray(toxic, int) > 0
    if not len(t) or t.all() or not t.any():
        return Model(np.zeros(SIZE), np.array([50.0, 51.0]))
    y, ratio = grades(rows, t)
    scale = np.maximum(ratio - 1, 0)  # only words that toxic rows have more often count: a long clean text hides nothing
    own = [scale[x] > 0 for x, _ in rows]
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [k.sum() for k in own])
    col = np.concatenate([x[k] for (x, _), k in zip(rows, own)])
    val = np.concatenate([1 + np.log(n[k]) for (_, n), k in zip(rows, own)]) * scale[col]
    used, col = np.unique(col, return_inverse=True)
    w, gap = np.zeros(len(used)), np.log(1.0)
    base = np.log((~t).sum() / t.sum())
    first = base
    seen_w, seen_c = np.full(len(used), 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        _, dz, *dc = loss(np.bincount(at, val * w[col], len(rows)), first, gap, y)
        dw = np.bincount(col, val * dz[at], len(used)) + l2 * w
        dc = np.array(dc)
        seen_w += dw * dw
        seen_c += dc * dc
        w = np.maximum(w - rate * dw / np.sqrt(seen_w), 0)
        first -= rate * dc[0] / np.sqrt(seen_c[0])
        gap -= rate * dc[1] / np.sqrt(seen_c[1])
    weight = np.zeros(SIZE)
    weight[used] = w * scale[used]
    return Model(weight, np.array([first, first + np.exp(gap)]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled rows; rows without id or label are left out, and a document
    labelled more than once counts as toxic if one label says so."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = word_tables()
        for b in batches:
            got = [words(t.as_py() or "", numbers) for t in b.column(2)]
            x, n = (pa.array([g[i].astype(np.int32).tobytes() for g in got], pa.binary()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), x, n], ["doc_id", "toxic", "x", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id").select("doc_id", "toxic", "text")
    # ids and counts as packed 32-bit numbers, taken batch by batch; the limit is for ids that documents repeat
    got = rows.mapInArrow(run, "doc_id long, toxic int, x binary, n binary").limit(sample).toArrow()
    order = sorted(range(got.num_rows), key=got.column("doc_id").to_pylist().__getitem__)
    x, n, y = got.column("x"), got.column("n"), got.column("toxic").to_pylist()
    return fit([(np.frombuffer(x[i].as_buffer(), np.int32), np.frombuffer(n[i].as_buffer(), np.int32)) for i in order], [y[i] for i in order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` -> ``SCHEMA``, a row a row.

    ``toxic`` says that a grade above 0 is likelier than not, ``grade`` is the likeliest number of
    cuts passed: both rise with the latent score, which the words' weights add up to, so severity follows how many
    of the learned words a text holds. Null text counts as empty, texts are scored whole; repeated rows stay
    repeated and score alike; other columns are ignored; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, m = word_tables(), sent.value
        for b in batches:
            p = m.above([words(t.as_py() or "", numbers) for t in b.column(1)]) if b.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)],
                ["doc_id", "p_toxic", "p_severe", "expected_severity", "grade", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
