"""Preparation and fits against NumPy on a few hundred rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import mart, models, prep, split
from sensorloom.operators.linalg import moments

COLS = [f"c_{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + 50
    x[:, 4] = x[:, 1] * 2 + rng.normal(0, 0.01, n)
    y = (x[:, 1] - x[:, 1].mean() + rng.normal(0, 1, n) > 1).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "raw_row_id long, target int, " + ", ".join(f"{c} double" for c in COLS)).repartition(5).cache()
    return x, y, df


def test_moments(data):
    x, _, df = data
    m = moments(df, COLS)
    np.testing.assert_allclose(m.cov, np.cov(x.T), rtol=1e-8)
    np.testing.assert_allclose(m.mean, x.mean(0))


def test_ledoit_wolf(data):
    x, _, df = data
    cov, shrink = prep.ledoit_wolf(df, moments(df, COLS))
    c = x - x.mean(0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / p, d2)
    assert shrink == pytest.approx(b2 / d2)
    np.testing.assert_allclose(cov, (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p), rtol=1e-7)


def test_pls_matches_deflation(data):
    x, y, df = data
    fitted = prep.fit_pls(df, COLS, 3)
    got = {r.raw_row_id: [r.pls_0, r.pls_1, r.pls_2] for r in prep.pls_scores(df, fitted).collect()}
    e = (x - x.mean(0)) / x.std(0, ddof=1)
    f = (y - y.mean()) / y.std(ddof=1)
    want = []
    for _ in range(3):
        w = e.T @ f
        w /= np.linalg.norm(w)
        w *= np.sign(w[np.argmax(np.abs(w))])
        t = e @ w
        load = e.T @ t / (t @ t)
        e = e - np.outer(t, load)
        f = f - t * (f @ t) / (t @ t)
        want.append(t)
    np.testing.assert_allclose(np.array([got[i] for i in range(len(y))]), np.array(want).T, atol=1e-5)


def test_spearman(data):
    x, _, df = data
    r = prep.spearman_matrix(df, COLS)
    ranks = x.argsort(0).argsort(0).astype(float)
    np.testing.assert_allclose(r, np.corrcoef(ranks.T), atol=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_prune_equals_walk(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"f{i:02d}" for i in range(25)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.12]
    place = {f: i + 1 for i, f in enumerate(rng.permutation(names))}
    adj = {f: {b for a, b in pairs if a == f} | {a for a, b in pairs if b == f} for f in names}
    leader: dict[str, str] = {}
    for f in sorted(names, key=place.get):
        if f not in leader:
            leader[f] = f
            for g in adj[f]:
                leader.setdefault(g, f)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, r double")
    prio = spark.createDataFrame([(str(f), p) for f, p in place.items()], "feature string, place int")
    got = {r.feature: (r.leader, r.kept) for r in prep.corr_prune(edges, prio).collect()}
    assert got == {f: (leader[f], leader[f] == f) for f in names}


def test_block_hsic_finds_dependence(data):
    _, _, df = data
    noisy = df.withColumn("c_9", F.rand(3))
    got = prep.dependence_top_k(noisy, [*COLS, "c_9"], 3, block=150).orderBy("rank").collect()
    assert {got[0].feature, got[1].feature} == {"c_1", "c_4"}
    assert sum(r.selected for r in got) == 3


def test_scale_of_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "c_1 double")
    out = prep.robust_scale(df, prep.fit_robust(df, ["c_1"])).collect()
    assert [r.c_1 for r in out] == [0.0, 0.0]


def test_all_null_sensor_vanishes(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "c_1 double, c_2 double")
    out = prep.median_impute(df, ["c_1", "c_2"], prep.fit_median(df, ["c_1", "c_2"]))
    assert out.columns == ["c_1"] and sorted(r.c_1 for r in out.collect()) == [1.0, 2.0, 3.0]


def _brute_z(v, window):
    out = []
    for i, x in enumerate(v):
        past = np.array([p for p in v[max(0, i - window) : i] if p is not None])
        if x is None or len(past) < 2 or past.max() == past.min():
            out.append(0.0)
        else:
            out.append((x - past.mean()) / past.std(ddof=1))
    return out


def test_rolling_z_blocks_and_leak(spark):
    rng = np.random.default_rng(2)
    v = [None if rng.random() < 0.1 else float(x) for x in rng.normal(5, 1, 200)]
    v[100:130] = [0.1] * 30

    def run(vals, block):
        df = spark.createDataFrame([(i + 1, a, 0.1) for i, a in enumerate(vals)], "n long, c_0 double, c_1 double").repartition(4)
        return [(r.c_0_rz, r.c_1_rz) for r in mart.rolling_z(df, ["c_0", "c_1"], "n", 20, block).orderBy("n").collect()]

    want = _brute_z(v, 20)
    for block in (20, 64, 1000):
        got = run(v, block)
        np.testing.assert_allclose([g[0] for g in got], want, atol=1e-9)
        assert all(g[1] == 0.0 for g in got)
    later = v[:150] + [99.0] * 50
    assert [g[0] for g in run(later, 64)][:150] == [g[0] for g in run(v, 64)][:150]


def test_rolling_z_by_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if rng.random() < 0.8 else "cold", float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tool string, value double").repartition(4)
    got = {r.id: r.value_rz for r in mart.rolling_z_by(df, "tool", ["id"], "value", 10, 16).collect()}
    for tool in ("hot", "cold"):
        mine = [r for r in rows if r[1] == tool]
        np.testing.assert_allclose([got[r[0]] for r in mine], _brute_z([r[2] for r in mine], 10), atol=1e-9)


def test_enet_separates_and_calibrates(data):
    _, y, df = data
    x = prep.robust_scale(df, prep.fit_robust(df, COLS), 5.0)

    def fit(rows):
        return models.fit_enet(split.class_balance_weights(rows), COLS, 1.0, 0.3)

    scorer, sigmoids = models.fit_calibrated(x, fit, 3)
    got = scorer.score(x).select("target", "probability").collect()
    p = np.array([r.probability for r in got])
    t = np.array([r.target for r in got])
    assert len(sigmoids) == 3 and p[t == 1].mean() > p[t == 0].mean() + 0.2
    assert abs(p.mean() - y.mean()) < 0.06


def test_failed_fit_gives_null_row(data):
    _, _, df = data
    folds = split.repeated_stratified_folds(df, 2, 1)

    def fit(rows, c):
        if c > 1:
            raise ValueError("fragile")
        return models.fit_enet(split.class_balance_weights(rows), COLS[:2], c, 0.0)

    grid = {"c": [0.5, 2.0]}
    out = models.grid_search(folds, fit, grid, tolerate=models.NUMERIC_ERRORS).collect()
    assert len(out) == 4 and {r.c for r in out if r.pr_auc is None} == {2.0}
    with pytest.raises(ValueError, match="fragile"):
        models.grid_search(folds, fit, grid)


def test_lines_that_do_not_parse_raise(spark):
    from sensorloom.sources import text

    lines = spark.createDataFrame([("1 NaN 2.5",), ("3 4 5",)], "value string")
    assert [tuple(r) for r in text.parse_sensor_lines(lines, 3).collect()] == [(1.0, None, 2.5), (3.0, 4.0, 5.0)]
    for bad, width in (("1 x 2", 3), ("1 2", 3), ("1 2 3 4", 3)):
        with pytest.raises(Exception, match="not a number|fields, not"):
            text.parse_sensor_lines(spark.createDataFrame([(bad,)], "value string"), width).collect()
    with pytest.raises(Exception, match="not a label"):
        text.parse_label_lines(spark.createDataFrame([('label "01/01/2008 00:00:00"',)], "value string")).collect()
