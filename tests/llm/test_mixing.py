"""The rates of the mixing operator against the targets they are fitted to."""

import numpy as np
from pyspark.sql import functions as F

from strata.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_expected_tokens_match_the_targets(spark):
    rows = queries.QUERIES["op1_domain_mixing"](spark, SF).collect()
    total = sum(r.n_tokens for r in rows)
    assert all(r.rate >= 0 for r in rows)
    for d in mixing.DOMAINS:
        has, got = (sum(r.n_tokens * r[f"p_{d}"] * w for r, w in zip(rows, ws)) for ws in ([1] * len(rows), [r.rate for r in rows]))
        assert abs(got - mixing.LIFTS[d] * has) <= 0.005 * total, (d, has, got, total)


def test_posteriors_hold_the_labels_tokens(spark):
    """Of labelled rows that the model never saw: tokens that their posteriors expect, and where most of the posterior lies."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) > 0
    model = mixing.train(docs, labels.filter(seen))
    own = labels.filter(~seen).groupBy("doc_id").agg((2 * F.min("quality") + F.max("toxic")).alias("k"))
    got = mixing.with_posteriors(docs.join(own, "doc_id"), model).select("k", "n_tokens", *[f"p_{x}" for x in mixing.DOMAINS]).toPandas()
    p, n = got[[f"p_{x}" for x in mixing.DOMAINS]].to_numpy(), got["n_tokens"].to_numpy()
    has = np.array([n[got["k"] == k].sum() for k in range(4)]) / n.sum()
    assert np.abs(n @ p / n.sum() - has).max() < 0.05, (n @ p / n.sum(), has)
    assert np.mean(p.argmax(1) == got["k"]) > 0.8


def test_rates_equal_dense_least_squares(spark):
    """Against the same problem solved on whole matrices: the same misses, weighted alike."""
    r = np.random.default_rng(3)
    p, n = r.dirichlet([2.0, 0.5, 3.0, 0.7], 600), r.integers(1, 300, 600)
    names = [f"p_{d}" for d in mixing.DOMAINS]
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, " + ", ".join(f"{c} double" for c in names)).cache()
    got = rows.withColumn("rate", mixing.rate(mixing.fit_rates(rows, mixing.LIFTS, near=1e-6))).toPandas()
    a = n[:, None] * p
    target = a.sum(0) * np.array([mixing.LIFTS[d] for d in mixing.DOMAINS])
    w = np.linalg.pinv((n[:, None] * p).T @ p)
    rates = np.ones(600)
    for _ in range(500):
        rates = np.maximum(rates - p @ (w @ (a.T @ rates - target)), 0)
    assert np.abs(a.T @ rates - target).max() < 1e-3 * target.max()
    assert np.abs((n[:, None] * got[names].to_numpy()).T @ got["rate"].to_numpy() / target - 1).max() < 1e-5
    assert np.abs(np.sort(rates) - np.sort(got["rate"])).max() < 0.05


def test_odd_tables(spark):
    rows = [(1, "a b", 1), (1, "c\nd", 2), (1, None, 3), (None, "a b", 4), (2, "", 5), (2, "w " * 60_000, 6), (2, "a b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumns({"_x": F.lit(1), "p_low": F.lit("q"), "rate": F.lit(0)})
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels)
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 2, 2, 2, 2, 60_000]
    same = {r.rate for r in got.filter("n_tokens = 2 and doc_id is null or doc_id = 2 and n_tokens = 2").collect()}
    assert len(same) == 1 and all(r.rate >= 0 for r in got.collect())
    assert mixing.mix(docs.limit(0), labels).count() == 0 == mixing.resample(docs.limit(0), labels).count()
    again = mixing.resample(docs, labels, least=1.0)
    assert again.columns == docs.columns and again.count() >= len(rows) and again.select("p_low", "rate").distinct().collect() == [("q", 0)]
