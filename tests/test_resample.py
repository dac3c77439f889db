"""The bootstrap by cells: its binomials, its totals, and draws that do not depend on how the cells are cut."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import metrics, resample


def mass(n, p):
    k = np.arange(n + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p) for x in k]
    return np.exp(logs)


def test_binomials_follow_their_law():
    u = (np.arange(200_000) + 0.5) / 200_000
    for n, p in ((1, 0.5), (7, 0.3), (60, 0.01), (60, 0.99), (900, 0.47)):
        got = np.bincount(resample.binomial(np.full(len(u), n), np.float64(p), u), minlength=n + 1) / len(u)
        assert np.abs(got - mass(n, p)).max() < 2e-5
    assert resample.binomial(np.array([5, 5, 0]), np.array([0.0, 1.0, 0.5]), np.array([0.9, 0.1, 0.5])).tolist() == [0, 5, 0]


def test_large_binomials_keep_mean_and_spread():
    u = (np.arange(2_000) + 0.5) / 2_000
    for n, p in ((10**10, 0.25), (10**9, 1e-8), (3 * 10**7, 0.999)):
        got = resample.binomial(np.full(len(u), n), np.float64(p), u).astype(float)
        sd = math.sqrt(n * p * (1 - p))
        assert abs(got.mean() - n * p) < 0.1 * sd and abs(got.std() / sd - 1) < 0.1


def test_counts_are_multinomial():
    weights = np.array([5, 0, 1, 30, 2, 0, 0, 12, 50], np.int64)
    draws = np.arange(1, 4001)
    got = resample.split_counts(weights, np.full(len(draws), 100), 12345, 1, draws)
    assert (got.sum(axis=1) == 100).all() and (got[:, weights == 0] == 0).all()
    assert np.abs(got.mean(axis=0) - weights).max() < 0.35
    p = weights / 100
    want = 100 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(got.T) - want).max() < 2.0


def _scores(spark, n=600):
    rng = np.random.default_rng(4)
    rows = [(k, int(i), int(y), float(s)) for k in ("a", "b") for i, (y, s) in enumerate(zip(rng.random(n) < 0.15, np.round(rng.random(n), 2), strict=True))]
    rows += [("one class", 1, 0, 0.5), ("one class", 2, 0, 0.7)]
    return spark.createDataFrame(rows, "pipeline string, id long, y_true int, y_score double")


def test_draws_do_not_depend_on_the_cut(spark):
    df = _scores(spark)
    one = sorted(resample.draw_metrics(df, ["pipeline"], 0.5, 60).collect())
    cut = sorted(resample.draw_metrics(df.repartition(5), ["pipeline"], 0.5, 60, block=8).collect())
    assert len(one) == 120 and [r[:2] for r in one] == [r[:2] for r in cut]
    assert np.allclose([r[2:] for r in one], [r[2:] for r in cut], rtol=0, atol=1e-12)


def test_interval_is_near_that_of_drawn_rows(spark):
    df = _scores(spark)
    got = {r.pipeline: r for r in metrics.bootstrap_metrics(df, ["pipeline"], 0.5, 1000).collect()}
    assert got["one class"].pr_auc_median is None and set(got) == {"a", "b", "one class"}
    rows = df.where("pipeline = 'a'").toPandas()
    rng = np.random.default_rng(1)
    y, s = rows.y_true.to_numpy(), rows.y_score.to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    aucs = []
    for _ in range(1000):
        p, n = rng.choice(pos, len(pos)), rng.choice(neg, len(neg))
        aucs.append((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)
    want = np.percentile(aucs, [50, 2.5, 97.5])
    assert np.allclose([got["a"].roc_auc_median, got["a"].roc_auc_ci_low, got["a"].roc_auc_ci_high], want, atol=0.01)


def test_no_row_meets_a_draw(spark):
    """Rows shrink to cells before anything is multiplied by draws."""
    df = _scores(spark).withColumn("id", F.col("id") * 10)
    many = df.unionByName(df).unionByName(df)
    assert resample.draw_metrics(many, ["pipeline"], 0.5, 10).count() == 20
