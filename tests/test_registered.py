"""Registered queries that SQL cannot say, against NumPy on their own tables."""

from __future__ import annotations

import numpy as np
import pytest

from sensorloom.functions.columns import sensor_columns
from sensorloom.plans import catalog, gates, preparation

SF = "/root/testdata/sf0.01"
catalog.load()


@pytest.fixture(scope="module")
def imputed(spark):
    df = preparation._imputed(spark, SF)
    return df.toPandas().sort_values("raw_row_id").reset_index(drop=True), sensor_columns(df)


def test_hotelling_t2_is_the_shrunk_distance(spark, imputed):
    rows, names = imputed
    x, train = rows[names].to_numpy(), rows[rows.split == "train"][names].to_numpy()
    mean = train.mean(0)
    c, p = train - mean, len(names)
    s = c.T @ c / len(c)
    level = np.trace(s) / p
    distance = ((s - level * np.eye(p)) ** 2).sum() / p
    error = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in c]) / p / len(c)
    share = min(error / distance, 1)
    inverse = np.linalg.inv(share * level * np.eye(p) + (1 - share) * s)
    want = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    got = {r.raw_row_id: r.hotelling_t2 for r in catalog.QUERIES["hotelling_t2"](spark, SF).collect()}
    np.testing.assert_allclose([got[i] for i in rows.raw_row_id], want, rtol=1e-6)


def test_pls_scores_are_those_of_deflation(spark, imputed):
    rows, names = imputed
    train = rows[rows.split == "train"]
    mean, sd = train[names].to_numpy().mean(0), train[names].to_numpy().std(0, ddof=1)
    x, y = (train[names].to_numpy() - mean) / sd, train.target.to_numpy() - train.target.mean()
    weights, loadings, left = [], [], x.copy()
    for _ in range(3):
        w = left.T @ y
        w /= np.linalg.norm(w)
        t = left @ w
        load = left.T @ t / (t @ t)
        left = left - np.outer(t, load)
        y = y - t * (y @ t) / (t @ t)
        weights.append(w)
        loadings.append(load)
    w, load = np.array(weights).T, np.array(loadings).T
    want = ((rows[names].to_numpy() - mean) / sd) @ w @ np.linalg.inv(load.T @ w)
    got = {r.raw_row_id: (r.pls_0, r.pls_1, r.pls_2) for r in catalog.QUERIES["pls_scores"](spark, SF).collect()}
    got = np.array([got[i] for i in rows.raw_row_id])
    np.testing.assert_allclose(got * np.sign((got * want).sum(0)), want, atol=1e-6)
    points = {r.raw_row_id: (r.x, r.y) for r in catalog.QUERIES["pls_score_scatter"](spark, SF).collect()}
    np.testing.assert_allclose([points[i] for i in rows.raw_row_id], got[:, :2], atol=1e-9)


def test_correlation_example_is_spearman(spark, imputed):
    rows, _ = imputed
    train = rows[rows.split == "train"]
    got = catalog.QUERIES["correlation_example"](spark, SF).collect()
    assert len(got) >= 9 and {r.a for r in got} == {r.b for r in got}
    for r in got:
        assert r.r == pytest.approx(train[r.a].rank().corr(train[r.b].rank()), abs=1e-6)


def test_pca_gate_limits_are_quantiles_of_the_passing_rows(spark):
    s, space = gates.gate_space(spark, SF)
    rows = gates.gates.gate_matrix(s, space).toPandas().sort_values("raw_row_id")
    x = rows[space.sensors].to_numpy()
    ref = x[(rows.split == "train") & (rows.target == 0)]
    c = x - ref.mean(0)
    values, vectors = np.linalg.eigh(np.cov(ref.T))
    v, lam = vectors[:, ::-1][:, :10], values[::-1][:10]
    t2 = ((c @ v) ** 2 / lam).sum(1)
    q = ((c - c @ v @ v.T) ** 2).sum(1)
    inside = ((rows.split == "train") & (rows.target == 0)).to_numpy()
    ooc = (t2 > np.quantile(t2[inside], 0.97)) | (q > np.quantile(q[inside], 0.995))
    got = {r.raw_row_id: r for r in catalog.QUERIES["pca_gate_fit"](spark, SF).collect()}
    np.testing.assert_allclose([got[i].t2 for i in rows.raw_row_id], t2, rtol=1e-6)
    np.testing.assert_allclose([got[i].q for i in rows.raw_row_id], q, rtol=1e-6, atol=1e-9)
    assert np.mean([got[i].ooc == o for i, o in zip(rows.raw_row_id, ooc, strict=True)]) > 0.99
