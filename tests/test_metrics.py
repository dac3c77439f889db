"""Metrics, thresholds and bootstrap against direct NumPy calculations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import metrics, thresholds


def brute_ap(y, s):
    return float(np.mean([y[s >= t].sum() / (s >= t).sum() for t in s[y == 1]]))


def brute_auc(y, s):
    d = s[y == 1][:, None] - s[y == 0][None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(300) < 0.1).astype(int)
    s = np.round(np.clip(0.05 + 0.05 * y + rng.normal(0, 0.04, 300), 0, 0.3), 2)
    rows = [("m", i, int(a), float(b), i % 3) for i, (a, b) in enumerate(zip(y, s))]
    return y, s, spark.createDataFrame(rows, "pipeline string, id long, y_true int, y_score double, fold int").cache()


def test_auc_and_ap_with_ties(scored):
    y, s, df = scored
    r = metrics.auc_metrics(df, ["pipeline"]).first()
    assert r.pr_auc == pytest.approx(brute_ap(y, s)) and r.roc_auc == pytest.approx(brute_auc(y, s))


def test_row_order_does_not_matter(scored):
    _, _, df = scored
    a = metrics.auc_metrics(df, ["pipeline"]).first()
    b = metrics.auc_metrics(df.orderBy(F.desc("id")).repartition(5), ["pipeline"]).first()
    assert a.pr_auc == pytest.approx(b.pr_auc, abs=1e-12)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.4)], "pipeline string, y_true int, y_score double")
    r = metrics.auc_metrics(df, ["pipeline"]).first()
    assert r.pr_auc is None and r.roc_auc is None


def test_weights_equal_repeated_rows(scored):
    y, s, df = scored
    w = np.arange(len(y)) % 3
    got = metrics.auc_metrics(df.withColumn("w", F.col("id") % 3), ["pipeline"], F.col("w")).first()
    assert got.pr_auc == pytest.approx(brute_ap(np.repeat(y, w), np.repeat(s, w)))


def test_holdout_metrics_empty_class(spark):
    df = spark.createDataFrame([("m", 0, 0.2), ("m", 0, 0.9)], "pipeline string, y_true int, y_score double")
    r = metrics.holdout_metrics(metrics.confusion(df, ["pipeline"], 0.5)).first()
    assert (r.tpr, r.tnr, r.ber_percent) == (0.0, 0.5, 75.0)


def test_grid_index_matches_search(spark):
    grid = np.linspace(thresholds.GRID_LOW, thresholds.GRID_HIGH, thresholds.GRID_SIZE)
    vals = sorted({0.0, 1.0, 0.2, 0.0001, *grid[::7].tolist(), *(grid[::11] - 1e-12).tolist(), *(grid[::13] + 1e-12).tolist()})
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = df.select("v", thresholds.grid_index(F.col("v")).alias("i"), thresholds.grid_value(thresholds.grid_index(F.col("v"))).alias("t")).collect()
    for r in got:
        assert r.i == -1 and r.v < grid[0] or r.t <= r.v
        if -1 <= r.i < len(grid) - 1:
            nxt = thresholds.GRID_LOW + (r.i + 1) * (thresholds.GRID_HIGH - thresholds.GRID_LOW) / (thresholds.GRID_SIZE - 1)
            assert nxt > r.v - 1e-15


def test_cost_optimum_ties_go_low(spark):
    rates = spark.createDataFrame([("m", 0.1, 1.0, 0.5, 0.1), ("m", 0.2, 1.0, 0.5, 0.1), ("m", 0.3, 0.5, 0.9, 0.1)],
                                  "pipeline string, threshold double, tpr double, tnr double, prevalence double")
    assert thresholds.cost_optimal(rates, ["pipeline"]).first().economic == 0.1


def test_bootstrap_interval_contains_median(scored):
    y, s, df = scored
    r = metrics.bootstrap_metrics(df, ["pipeline"], 0.1, 60).first()
    for m in ("pr_auc", "roc_auc", "ber_percent"):
        assert r[f"{m}_ci_low"] <= r[f"{m}_median"] <= r[f"{m}_ci_high"]
    assert r.roc_auc_ci_low < brute_auc(y, s) < r.roc_auc_ci_high


def test_outcome_names(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.9), (0, 0.1)], "y_true int, y_score double")
    got = [r.outcome for r in metrics.outcome_labels(df, 0.5).collect()]
    assert got == ["caught_fail", "missed_fail", "false_alarm", "correct_pass"]
