"""Fits of many problems at once against single fits, conditions of optimality and plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sensorloom.operators import batched, models, split

COLS = [f"c_{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 6))
    x[:, 3] = x[:, 1] + rng.normal(0, 0.05, n)
    y = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * x[:, 1] + x[:, 2]))).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "raw_row_id long, target int, " + ", ".join(f"{c} double" for c in COLS)).repartition(7).cache()
    return x, y, df


def optimal(x, y, w, beta, c, l1_ratio, slack=1e-4):
    """The conditions that hold at the minimum and nowhere else."""
    x1 = np.c_[x, np.ones(len(x))]
    slope = x1.T @ (w * (1 / (1 + np.exp(-x1 @ beta)) - y))
    b, g = beta[:-1], slope[:-1] + (1 - l1_ratio) / c * beta[:-1]
    at_zero = np.abs(g) <= l1_ratio / c + slack
    off_zero = np.abs(g + np.sign(b) * l1_ratio / c) <= slack
    return abs(slope[-1]) <= slack and np.where(b == 0, at_zero, off_zero).all()


def test_every_problem_is_at_its_minimum(data):
    x, y, df = data
    rows = batched.rows_of(df.withColumn("f", F.array((F.col("raw_row_id") % 4).cast("int"))), COLS, folds="f")
    c = np.array([0.01, 0.05, 1.0, 100.0, 0.1, 0.1, np.inf])
    l1 = np.array([0.2, 1.0, 0.5, 0.0, 0.3, 0.3, 0.0])
    pos = np.array([1.0, 15.0, 3.0, 1.0, 2.0, 2.0, 1.0])
    repeat, fold = np.array([-1, -1, -1, -1, 0, 0, -1]), np.array([-1, -1, -1, -1, 1, 3, -1])
    inside = np.array([False] * 5 + [True, False])
    p = batched.Problems(c=c, l1_ratio=l1, pos=pos, repeat=repeat, fold=fold, inside=inside)
    beta = batched.fit_batch(rows, 6, p)
    for i in range(len(c)):
        w = np.where(y == 1, pos[i], 1.0)
        if repeat[i] == 0:
            here = np.arange(len(y)) % 4 == fold[i]
            w = w * (here if inside[i] else ~here)
        assert optimal(x, y, w, beta[i], c[i], l1[i], slack=1e-4 * w.sum() / len(y) + 1e-3), i
    assert (beta[0][:-1] == 0).any()  # the penalty does select


def test_same_as_a_single_fit(data):
    _, _, df = data
    one = models.fit_enet(df.withColumn("weight", F.lit(1.0)), COLS, 0.5, 0.3)
    beta = batched.fit_batch(batched.rows_of(df, COLS), 6, batched.Problems(c=np.array([0.5]), l1_ratio=0.3))[0]
    np.testing.assert_allclose(beta, [*one.coefficients.values(), one.intercept], atol=2e-3)


def test_draws_are_fits_of_poisson_weights(data):
    x, y, df = data
    got = models.coef_draws(df, COLS, 5, 0.5, 0.3, pos_weight=4.0).toPandas()
    keys = {r.raw_row_id: r.k for r in df.select("raw_row_id", F.xxhash64("raw_row_id").alias("k")).collect()}
    mean = np.where(y == 1, 4.0, 1.0).mean()
    copies = batched.poisson_weights(np.array([keys[i] for i in range(len(y))]), np.arange(5), 42)
    assert set(np.unique(copies)) >= {0.0, 1.0, 2.0}
    for d in range(5):
        b = got[got.draw == d].set_index("feature").beta
        w = copies[:, d] * np.where(y == 1, 4.0, 1.0) / mean
        assert optimal(x, y, w, b[[*COLS, "(intercept)"]].to_numpy(), 0.5, 0.3, slack=1e-2)
    assert got.draw.nunique() == 5 and len(got) == 35


def test_poisson_law():
    w = batched.poisson_weights(np.arange(20_000, dtype=np.int64) * 7919, np.arange(5), 42)
    assert np.abs(w.mean(axis=0) - 1).max() < 0.03 and np.abs(w.var(axis=0) - 1).max() < 0.06
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_out_of_fold_scores_come_from_fits_without_the_fold(data):
    x, y, df = data
    folds = split.repeated_stratified_folds(df, 3, 2)
    grid = [{"c": 0.1, "l1_ratio": 0.3}, {"c": 1.0, "l1_ratio": 0.0}]
    got = models.enet_fold_scores(folds, COLS, grid).toPandas()
    assert len(got) == 2 * 2 * len(y)
    for setting, repeat, fold in ((0, 0, 1), (1, 1, 2)):
        train = folds.where((F.col("repeat") == repeat) & (F.col("fold") != fold))
        one = models.fit_enet(split.class_balance_weights(train), COLS, grid[setting]["c"], grid[setting]["l1_ratio"])
        test = folds.where((F.col("repeat") == repeat) & (F.col("fold") == fold))
        want = {r.raw_row_id: r.probability for r in one.score(test).select("raw_row_id", "probability").collect()}
        mine = got[(got.setting == setting) & (got.repeat == repeat) & (got.fold == fold)]
        assert set(mine.id) == set(want)
        np.testing.assert_allclose(mine.y_score, [want[i] for i in mine.id], atol=2e-3)


def test_sigmoids_match_single_fits(data):
    _, y, df = data
    folds = split.repeated_stratified_folds(df, 2, 1).withColumnRenamed("fold", "_fold").drop("repeat")
    fits = [models.fit_enet(split.class_balance_weights(folds.where(F.col("_fold") != i)), COLS, 1.0, 0.0) for i in range(2)]
    got = models.fold_sigmoids(folds, fits, "target", "raw_row_id")
    for i, (a, b) in enumerate(got):
        here = fits[i].score(folds.where(F.col("_fold") == i), "base")
        n = {r[0]: r[1] for r in here.groupBy("target").count().collect()}
        hi, lo = (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)
        t = F.when(F.col("target") == 1, hi).otherwise(lo)
        pair = F.array(F.struct(F.lit(1.0).alias("y"), t.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - t).alias("w")))
        rows = VectorAssembler(inputCols=["base"], outputCol="x").transform(here.select("base", F.inline(pair)))
        m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", tol=1e-12, maxIter=500).fit(rows)
        np.testing.assert_allclose([a, b], [-m.coefficients[0], -m.intercept], rtol=2e-3)


def test_problems_in_parts_give_the_same(data, monkeypatch):
    _, _, df = data
    rows = batched.rows_of(df, COLS)
    p = batched.Problems(c=np.linspace(0.05, 2, 150), l1_ratio=0.3, draw=np.arange(150))
    whole = batched.fit_batch(rows, 6, p)
    monkeypatch.setattr(batched, "HELD", 49 * 40)
    np.testing.assert_allclose(batched.fit_batch(rows, 6, p), whole, atol=1e-6)


def test_grid_cells_share_pruning_and_prepared_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    rows = [(i, int(x[i, 0] + rng.normal() > 0), *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "raw_row_id long, target int, c_0 double, c_1 double, c_2 double")
    train, test = df.where("raw_row_id < 45"), df.where("raw_row_id >= 45")
    edges, calls = models.spearman_edges, []
    monkeypatch.setattr(models, "spearman_edges", lambda *a: calls.append(1) or edges(*a))
    specs = {"pls_enet": {"k": 2}, "hsic_enet": {"k": 2}}
    got = {(r.pipeline, r.id): r.y_score for r in models.holdout_scores(train, test, specs).collect()}
    assert len(calls) == 1 and len(got) == 30
    design, scorer = models.fit_model(train, "pls_enet", k=2)
    for r in scorer.score(design.apply(test), "y_score").collect():
        assert abs(got["pls_enet", r.raw_row_id] - r.y_score) < 1e-12
