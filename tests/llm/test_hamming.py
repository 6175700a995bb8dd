"""Links of vectors that share a direction, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import hamming


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("common", [0.0, 0.8])
def test_links_are_found_in_spite_of_a_common_direction(spark, common):
    r = np.random.default_rng(5)
    x = _unit(common * _unit(r.standard_normal((1, 64))) + np.sqrt(1 - common**2) * _unit(r.standard_normal((3000, 64))))
    u, w = x[:600], x[600:1200]
    w = _unit(w - (u * w).sum(1, keepdims=True) * u)
    x = np.concatenate([x, 0.91 * u + np.sqrt(1 - 0.91**2) * w])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hamming.near_duplicates(rows).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() / near.sum() >= 0.97


def _labels(near):
    label = np.arange(len(near))
    while (new := np.minimum(label, np.where(near, label, len(near)).min(1))).tolist() != label.tolist():
        label = new
    return label


@pytest.mark.parametrize("block", [4096, 64])
def test_a_dense_group_keeps_every_link(spark, monkeypatch, block):
    """One group of near copies, whole or dealt into many blocks; nothing that leaves a task grows with its pairs."""
    monkeypatch.setattr(hamming, "BLOCK", block)
    r = np.random.default_rng(6)
    x = np.concatenate([_unit(_unit(r.standard_normal((1, 32))) + 0.02 * r.standard_normal((500, 32))), _unit(r.standard_normal((300, 32)))])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hamming.near_duplicates(rows).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == _labels(near).tolist()
    reps = rows.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "embedding")
    assert hamming.links(reps, 32, 0.9, 0.99).count() < 60 * len(x) < near.sum()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 5), (2, [1.0, 0.0], 5), (3, [2.0, 0.1], 5), (4, [1.0, 0.0, 0.0], 5), (5, None, 5), (6, [0.0, 0.0], 5), (7, [1.0, None], 5), (None, [1.0, 0.0], 5), (8, [-1.0, 0.0], 5)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int").withColumns({"h1": F.lit("x"), "copies": F.lit(None)})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in hamming.near_duplicates(x).collect())
    assert got == [(0, 0, None, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert hamming.near_duplicates(x.limit(0)).count() == 0
