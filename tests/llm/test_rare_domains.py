"""Rates of domains that have few tokens, each against its own target."""

import numpy as np
import pytest

from strata.llm import mixing


@pytest.mark.parametrize("share", [8e-4, 1e-4])
def test_rare_domain_meets_its_target(spark, share):
    r = np.random.default_rng(2)
    p = r.dirichlet([4.0, 1.0, 4.0, 1.0], 4000)
    rare = r.random(4000) < 0.02
    p[:, 1] = np.where(rare, 50 * share * r.uniform(0.5, 1.5, 4000), 0)
    p /= p.sum(1, keepdims=True)
    n = r.integers(10, 500, 4000)
    names = [f"p_{d}" for d in mixing.DOMAINS]
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, " + ", ".join(f"{c} double" for c in names)).cache()
    steps = mixing.fit_rates(rows, mixing.LIFTS)
    got = rows.withColumn("rate", mixing.rate(steps)).toPandas()
    for d, c in zip(mixing.DOMAINS, names):
        has, now = (got.n_tokens * got[c]).sum(), (got.n_tokens * got[c] * got.rate).sum()
        assert abs(now - mixing.LIFTS[d] * has) <= 0.01 * mixing.LIFTS[d] * has, (d, now / has, len(steps))
