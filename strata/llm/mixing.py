"""Mixing to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier, counted on labelled rows and calibrated on others of them, gives each document a
posterior over domains (quality and toxicity of the label table, four in all). Document rates ``r >= 0`` are then fitted
so that the expected tokens of each domain, ``sum_d r_d n_d p_dk``, match their targets in least
squares, by projected gradient steps from ``r = 1``: a step is one distributed sum a domain, and
since it moves a rate by its posterior alone, rates stay an expression of the posterior and no
table of rates is kept between steps. Misses count relative to each domain's target, so a rare domain is fitted as
well as a common one. A step is first tried in the metric of the rows whose rates can still move (the inverse of their
Gram matrix: exact while no rate meets its bound), and taken as a plain gradient step where that gains too little.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut

DOMAINS = ("low", "low_toxic", "good", "good_toxic")
#: target tokens of a domain, in times of what it has
LIFTS = {"low": 0.6, "low_toxic": 0.3, "good": 1.1, "good_toxic": 0.5}
#: most labelled rows that are counted (those with the smallest hash of their id)
SAMPLE = 8000
BUCKETS = 16384
#: standard deviations by which a class must differ in a bucket for it to count
TELLING = 3.0
#: times that a step in the metric of the rows that can still move may lead uphill before no more are tried
REFUSED = 3
#: steps that lower the weighted square of the misses by less than this share have stalled
STALL = 2e-3
LOG = logging.getLogger(__name__)


def _table(values: np.ndarray) -> Column:
    """A constant array, folded when the plan is optimised."""
    return F.expr(f"cast(split('{','.join(f'{v:.6g}' for v in values)}', ',') as array<double>)")


@dataclass
class Model:
    """Log-odds of every bucket per domain against the first, and the biases and slopes that turn their sums into posteriors."""

    weight: np.ndarray
    bias: np.ndarray
    slope: np.ndarray


def with_features(docs: DataFrame) -> DataFrame:
    """Adds ``_n`` (words) and ``_x`` (distinct buckets of words, of their starts and of their ends). Null and empty texts have none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    out = docs.withColumn("_w", words)
    whole = F.transform(F.array_distinct("_w"), lambda w: F.pmod(F.hash(w, F.lit(2)), F.lit(BUCKETS)))
    start = F.transform("_w", lambda w: F.pmod(F.hash(F.substring(w, 1, 5)), F.lit(BUCKETS)))
    end = F.transform("_w", lambda w: F.pmod(F.hash(F.substring(w, -3, 3), F.lit(1)), F.lit(BUCKETS)))
    return out.withColumns({"_n": F.size("_w").cast("double"), "_x": F.array_distinct(F.concat(whole, start, end))}).drop("_w")


def calibrate(evidence: np.ndarray, tokens: np.ndarray, kind: np.ndarray, prior: np.ndarray, steps: int = 100, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Biases ``b`` and slopes ``A`` of ``softmax(b + A e)``, fitted to rows that the evidence ``e`` wasn't counted on.

    ``e`` is of all domains but the first, whose score is 0. A row weighs as its tokens do: where the fit ends, the expected
    tokens of every domain are those of its labels.
    """
    n, k = len(kind), len(prior)
    w = tokens / max(tokens.sum(), 1)
    x = np.column_stack([np.ones(n), evidence])
    hot = np.eye(k)[kind]
    start = np.column_stack([prior[1:] - prior[0], np.eye(k - 1)])
    keep = l2 * np.column_stack([np.zeros(k - 1), np.ones((k - 1, k - 1))])

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.column_stack([np.zeros(n), x @ theta.T])
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return -float(w @ np.log(np.maximum(p[np.arange(n), kind], 1e-300))) + float((keep * theta * theta).sum()) / 2, p

    theta = start
    cost, p = at(theta)
    for _ in range(steps):  # Newton steps, halved until the cost falls: the cost is convex
        q = p[:, 1:]
        g = ((w[:, None] * (q - hot[:, 1:])).T @ x + keep * theta).ravel()
        h = _curvature(w, q, x) + np.diag(keep.ravel() + 1e-9)
        move, shrink = np.linalg.solve(h, g).reshape(theta.shape), 1.0
        while shrink > 1e-6 and (new := at(theta - shrink * move))[0] > cost:
            shrink /= 2
        if shrink <= 1e-6:
            break
        theta, (cost, p) = theta - shrink * move, new
        if np.abs(shrink * move).max() < 1e-9:
            break
    return theta[:, 0], theta[:, 1:]


def _curvature(w: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The Hessian of the weighted log-loss by biases and slopes."""
    d, m = q.shape[1], x.shape[1]
    h = np.zeros((d, m, d, m))
    for a in range(d):
        for b in range(d):
            h[a, :, b, :] = (x * (w * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x
    return h.reshape(d * m, d * m)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counted on two thirds of at most ``sample`` labelled rows, made soft on the other third; without labels all domains are alike.

    A document labelled more than once takes its lowest quality and its highest toxicity; rows without id or label are left out.
    """
    kinds = len(DOMAINS)
    kind = (2 * F.col("quality") + F.col("toxic")).alias("k")
    own = labels.filter("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", kind, (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("held"))  # bounded, so it may be broadcast
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"))
    by = F.explode(F.concat("_x", F.array(F.lit(BUCKETS)))).alias("x")  # one more bucket, that each row is in
    count = rows.filter("not held").select("k", by).groupBy("x").agg(*[F.count_if(F.col("k") == k).alias(f"c{k}") for k in range(kinds)]).collect()  # at most BUCKETS + 1 rows
    c = np.zeros((BUCKETS + 1, kinds))
    for r in count:
        c[r["x"]] = [r[f"c{k}"] for k in range(kinds)]
    n = c[-1]
    if not n.sum():
        return Model(np.zeros((BUCKETS, kinds)), np.zeros(kinds - 1), np.zeros((kinds - 1, kinds - 1)))
    # smoothed towards the share of a bucket over all classes, so that a class of few rows isn't favoured by what it never had
    share = (c[:-1].sum(1) + 0.5) / (n.sum() + 1)
    p = np.log((c[:-1] + 2 * share[:, None]) / (n + 2))
    # buckets that no class has much more or less often than all together say nothing but noise
    due = (n + 0.5) * share[:, None]
    telling = (np.abs(c[:-1] - due) / np.sqrt(due + 0.25)).max(1) > TELLING
    weight, prior = np.where(telling[:, None], p - p[:, :1], 0.0), np.log((n + 0.5) / (n.sum() + 2))
    sums = [e.alias(f"e{k}") for k, e in enumerate(_evidence(weight), 1)]
    held = rows.filter("held").select("k", "_n", *sums).limit(sample).toPandas()  # bounded like the labels
    if not len(held) or not held["_n"].sum():
        return Model(weight, prior[1:] - prior[0], np.eye(kinds - 1))
    evidence = held[[f"e{k}" for k in range(1, kinds)]].to_numpy(float)
    return Model(weight, *calibrate(evidence, held["_n"].to_numpy(float), held["k"].to_numpy(int), prior))


def _evidence(weight: np.ndarray) -> list[Column]:
    """For every domain but the first the sum of the log-odds of a row's buckets, over the square root of their number."""
    size = F.sqrt(F.greatest(F.size("_x"), F.lit(1)))
    return [F.aggregate("_x", F.lit(0.0), _adder(_table(weight[:, k]))) / size for k in range(1, len(DOMAINS))]


def with_posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``n_tokens`` and ``p_<domain>``, soft membership as calibrated."""
    rows = with_features(docs)
    rows = rows.withColumns({f"_v{k}": e for k, e in enumerate(_evidence(model.weight))})
    scores = {f"_s{k + 1}": F.lit(float(model.bias[k])) + sum(F.lit(float(a)) * F.col(f"_v{j}") for j, a in enumerate(model.slope[k])) for k in range(len(DOMAINS) - 1)}
    rows = rows.withColumns(scores).withColumn("_s0", F.lit(0.0))
    every = [F.col(f"_s{k}") for k in range(len(DOMAINS))]
    rows = rows.withColumn("_top", F.greatest(*every))
    rows = rows.withColumns({f"_e{k}": F.exp(s - F.col("_top")) for k, s in enumerate(every)})
    total = sum((F.col(f"_e{k}") for k in range(1, len(DOMAINS))), F.col("_e0"))
    rows = rows.withColumns({"n_tokens": F.col("_n").cast("long"), **{f"p_{d}": F.col(f"_e{k}") / total for k, d in enumerate(DOMAINS)}})
    return rows.drop("_n", "_x", "_top", *[f"_{c}{k}" for c in "sev" for k in range(len(DOMAINS))])


def _adder(table: Column):
    return lambda acc, x: acc + F.get(table, x)


def rate(steps: list[np.ndarray], least: float = 0.0) -> Column:
    """The rate of a row with posterior columns after these gradient steps, each projected on rates of ``least`` and more."""
    r = "1.0D"
    for g in steps:
        r = f"greatest({float(least)}D, {r} - ({' + '.join(f'({float(g[k])!r}D) * p_{d}' for k, d in enumerate(DOMAINS))}))"
    return F.expr(r)


def fit_rates(rows: DataFrame, lifts: dict[str, float], least: float = 0.0, most: int = 60, near: float = 1e-3) -> list[np.ndarray]:
    """Projected gradient steps for ``rows(n_tokens, p_<domain>)``; targets are ``lifts`` times the tokens of a domain.

    Steps end when no domain misses its own target by more than the share ``near``, when they stall, or after
    ``most`` passes over the rows; what is missed in the last two cases is logged. No step goes uphill.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens")
    first = rows.agg(*[F.sum(n * a).alias(f"t{i}") for i, a in enumerate(p)], *[F.sum(n * p[i] * p[j]).alias(f"m{i}{j}") for i in range(len(p)) for j in range(i + 1)]).first()
    has = np.array([first[f"t{i}"] or 0.0 for i in range(len(p))])
    target = has * np.array([lifts.get(d, 1.0) for d in DOMAINS])
    gram = np.array([[first[f"m{max(i, j)}{min(i, j)}"] or 0.0 for j in range(len(p))] for i in range(len(p))])
    steps: list[np.ndarray] = []
    if not has.sum() or not gram.any():
        return steps
    own = np.where(target > 0, target, np.where(has > 0, has, 1.0))

    def taken(tried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' tokens after these steps, and the inverse Gram matrix of the rows that can still move."""
        moves = F.when(F.col("_r") > least, n)  # rows at the bound don't answer to a step
        grams = [F.sum(moves * p[i] * p[j]).alias(f"m{i}{j}") for i in range(len(p)) for j in range(i + 1)]
        got = rows.withColumn("_r", rate(tried, least)).agg(*[F.sum(F.col("_r") * n * a).alias(f"t{i}") for i, a in enumerate(p)], *grams).first()
        left = [[got[f"m{max(i, j)}{min(i, j)}"] or 0.0 for j in range(len(p))] for i in range(len(p))]
        return np.array([got[f"t{i}"] for i in range(len(p))]), _inverse(np.array(left))

    # a gradient step of the relative misses, over the gradient's Lipschitz constant: it never goes uphill
    plain = np.diag(1 / own**2) / max(np.linalg.eigvalsh(gram / np.outer(own, own)).max(), 1e-300)
    bold, now, refused, tries = _inverse(gram), has, 0, 0
    while True:
        miss = now - target
        left = np.abs(miss / own)
        cost = float(left @ left)
        if left.max() <= near or tries >= most:
            break
        gain = -1.0
        if refused < REFUSED:
            tried = [*steps, bold @ miss]
            then, metric = taken(tried)
            gain, tries = cost - float((((then - target) / own) ** 2).sum()), tries + 1
        if gain < cost / 4:
            refused += gain < 0
            sure = [*steps, plain @ miss]
            then_, metric_ = taken(sure)
            tries += 1
            if (other := cost - float((((then_ - target) / own) ** 2).sum())) > gain:
                tried, then, metric, gain = sure, then_, metric_, other
        if gain < STALL * cost:
            break
        steps, now, bold = tried, then, metric
    if left.max() > near:
        LOG.warning("rates miss target tokens after %d steps: %s", len(steps), ", ".join(f"{d} by {100 * m:.2f} %" for d, m in zip(DOMAINS, left)))
    return steps


def _inverse(gram: np.ndarray) -> np.ndarray:
    """The inverse of a Gram matrix, scaled first so that rare domains aren't cut off as noise."""
    size = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.pinv(gram / np.outer(size, size), rcond=1e-10, hermitian=True) / np.outer(size, size)


def mix(docs: DataFrame, labels: DataFrame, lifts: dict[str, float] = LIFTS, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, p_<domain>..., rate)``, a row a row.

    Null text counts as empty, has the prior as its posterior and no tokens, and gets a rate like any
    other. Without labels all domains are equally likely. Ties can't arise: a rate is a function of the posterior,
    so repeated rows have the same. Texts are taken whole; other columns are ignored. An empty table gives an empty table.
    """
    rows = cut(with_posteriors(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels, sample)).drop("text"), "posteriors")
    steps = fit_rates(rows, lifts)
    return rows.withColumn("rate", rate(steps))


def resample(docs: DataFrame, labels: DataFrame, lifts: dict[str, float] = LIFTS, least: float = 0.0, sample: int = SAMPLE, near: float = 0.02) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more with the chance of the rest.

    Rates are fitted to within ``near`` of each domain's target, less exact than whole rows are.
    The chance is a hash of id and text, so that a run can be repeated (and repeated rows fare alike). All
    columns stay, whatever their names; null texts and ids are rows like any other. An empty table gives an empty table.
    """
    # written with the posteriors as columns: as expressions they would be put into every step of the rate
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    kept = cut(with_posteriors(kept, train(docs, labels, sample)).drop("text"), "posteriors")
    steps = fit_rates(kept, lifts, least, near=near)
    chance = F.pmod(F.xxhash64("_doc.doc_id", "_doc.text"), F.lit(1 << 20)) / float(1 << 20)
    kept = kept.withColumn("_times", F.floor(rate(steps, least) + chance).cast("int")).filter("_times > 0")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
