"""The classifiers against plain solvers, numeric gradients, labels that they never saw, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_gradient_of_the_cumulative_link():
    r = np.random.default_rng(1)
    z, y = r.normal(size=40), r.integers(0, 3, 40)
    cost, dz, df, dg = toxicity.loss(z, 0.3, -0.4, y)
    e = 1e-6
    at = lambda z=z, f=0.3, g=-0.4: toxicity.loss(z, f, g, y)[0]
    assert abs((at(f=0.3 + e) - at(f=0.3 - e)) / (2 * e) - df) < 1e-6 and abs((at(g=-0.4 + e) - at(g=-0.4 - e)) / (2 * e) - dg) < 1e-6
    for i in range(40):
        up, down = z.copy(), z.copy()
        up[i] += e
        down[i] -= e
        assert abs((at(z=up) - at(z=down)) / (2 * e) - dz[i]) < 1e-6
    p0, p1 = 1 - 1 / (1 + np.exp(-(z - 0.3))), 1 / (1 + np.exp(-(z - 0.3))) - 1 / (1 + np.exp(-(z - 0.3 - np.exp(-0.4))))
    assert abs(cost + np.mean(np.log(np.where(y == 0, p0, np.where(y == 1, p1, 1 - p0 - p1))))) < 1e-9


def test_severity_of_labels_never_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) > 0
    model = toxicity.train(docs, labels.filter(seen))
    assert model.cuts[0] < model.cuts[1] and (model.weight >= 0).all()
    own = labels.filter(~seen).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    got = toxicity.score(docs.join(own, "doc_id", "left_semi"), model).join(own, "doc_id").toPandas()
    assert got[got.label == 1].toxic.mean() > 0.8 and got[got.label == 0].toxic.mean() < 0.01
    order = got.sort_values("p_toxic")
    assert (np.diff(order.expected_severity) >= -1e-9).all() and (np.diff(order.grade) >= 0).all() and (np.diff(order.p_severe) >= -1e-9).all()
    assert (got.p_severe <= got.p_toxic).all() and np.allclose(got.expected_severity, got.p_toxic + got.p_severe)


def test_dual_descent_finds_the_least_cost():
    """The primal cost against a plain subgradient solver of the same problem."""
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 60, 12)) for _ in range(120)]
    y = np.where(np.array([(x < 20).sum() for x in rows]) + r.normal(0, 1.5, 120) > 3.5, 1.0, -1.0)
    scale = r.normal(0, 1, quality.SIZE)
    cost = np.full(120, 0.2)
    dense = np.zeros((120, 61))
    for i, x in enumerate(rows):
        dense[i, x] = scale[x]
        dense[i, 60] = 1
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()
    w, b = quality.dual_descent(rows, y, scale, cost, epochs=300)
    mine = np.append(np.divide(w[:60], scale[:60]), b)
    v, best = np.zeros(61), np.inf
    for t in range(1, 40_000):
        g = v - dense.T @ (cost * y * (y * (dense @ v) < 1))
        v = v - g / t
        best = min(best, primal(v))
    assert primal(mine) <= best * 1.002 + 1e-6


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    rows = [(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7), (3, "vile words " * 40_000, 8), (4, "x" * 100_000, 9), (4, "fine", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumns({"x": F.lit("q"), "quality": F.lit(9), "toxic": F.lit(9), "out": F.lit(True)})
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    labels = labels.limit(0) if empty else labels
    t = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    q = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(t) == len(q) == len(rows) and all(0 <= r.score <= 1 for r in q) and all(0 <= r.expected_severity <= 2 for r in t)
    assert len({r.score for r in q if r.doc_id == 2}) == 1 == len({r.p_toxic for r in t if r.doc_id == 2})
    kept = quality.score(docs, quality.train(docs, labels), columns=docs.columns)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0 == quality.score(docs.limit(0), quality.train(docs, labels)).count()
