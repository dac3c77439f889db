"""The ordered primitives against a plain calculation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators.frame import (
    average_ranks,
    exact_quantile_array,
    exact_quantiles,
    global_row_number,
    row_number_within,
    running_totals,
)
from sensorloom.operators.quantile import quantile_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    # one group holds most rows, and a third of all rows have the same value
    g = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 50, n), 1))
    data = [(i, str(a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(g, v))]
    df = spark.createDataFrame(data, "id long, g string, v double, w int").repartition(7, "w").cache()
    return data, df


def test_global_row_number(rows):
    data, df = rows
    got = {r.id: r.n for r in global_row_number(df, ["v", "id"], "n").collect()}
    want = {d[0]: i + 1 for i, d in enumerate(sorted(data, key=lambda d: (d[2], d[0])))}
    assert got == want


def test_row_number_within(rows):
    data, df = rows
    got = {r.id: (r.n, r.n_of) for r in row_number_within(df, ["g"], [F.desc("id")], "n").collect()}
    want = {}
    for g in {d[1] for d in data}:
        ids = sorted((d[0] for d in data if d[1] == g), reverse=True)
        want |= {i: (k + 1, len(ids)) for k, i in enumerate(ids)}
    assert got == want


def test_running_totals(rows):
    data, df = rows
    got = {r.id: r.t for r in running_totals(df, ["g"], ["v", "id"], {"t": "w"}).collect()}
    want = {}
    for g in {d[1] for d in data}:
        t = 0
        for d in sorted((d for d in data if d[1] == g), key=lambda d: (d[2], d[0])):
            t += d[3]
            want[d[0]] = t
    assert got == want


def test_exact_quantiles(rows):
    data, df = rows
    probs = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p995": 0.995, "p100": 1.0}
    got = {r.g: [r[n] for n in probs] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, q in got.items():
        vals = [d[2] for d in data if d[1] == g]
        np.testing.assert_allclose(q, np.quantile(vals, list(probs.values())), atol=1e-9)
    total = exact_quantile_array(df, [], "v", [0.3, 0.9], "q").first().q
    np.testing.assert_allclose(total, np.quantile([d[2] for d in data], [0.3, 0.9]), atol=1e-9)


def test_exact_quantiles_need_every_bit(spark):
    """Values that differ in their last bits only, of both signs, with ties and no-values."""
    rng = np.random.default_rng(3)
    near = np.repeat(np.nextafter(1.0, 2.0) + np.arange(500) * 2.0**-52, rng.integers(1, 4, 500))
    v = np.concatenate([near, -near, [0.0, -0.0, 1e-300, -1e300, 1e300]])
    rng.shuffle(v)
    rows = [(float(x), None if i % 3 else float(-x), float("nan")) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    probs = [0.0, 0.003, 0.25, 0.5, 0.75, 0.97, 1.0]
    t = {j: (n, np.array(q)) for _, j, n, q in quantile_table(df, ["a", "b", "c"], probs)}
    assert {j: n for j, (n, _) in t.items()} == {0: len(v), 1: sum(r[1] is not None for r in rows)}
    for j in (0, 1):
        x = np.array([r[j] for r in rows if r[j] is not None])
        s = np.sort(x)
        got = t[j][1]
        at = np.array(probs) * (len(s) - 1)
        low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        assert ((low <= got) & (got <= high)).all() and got[0] == s[0] and got[-1] == s[-1]


def test_exact_quantiles_by_two_keys(spark):
    rows = [("a", 1, 1.0), ("a", 1, 2.0), ("a", None, 7.0), (None, 1, None), ("b", 2, 5.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(3)
    got = {(r.g, r.h): r.m for r in exact_quantiles(df, ["g", "h"], "v", {"m": 0.5}).collect()}
    assert got == {("a", 1): 1.5, ("a", None): 7.0, (None, 1): None, ("b", 2): 5.0}
    assert exact_quantile_array(df.where("v > 100"), [], "v", [0.5], "q").first().q is None


def test_average_ranks(rows):
    data, df = rows
    got = {r.id: r.k for r in average_ranks(df, ["g"], "v", "k").collect()}
    for g in {d[1] for d in data}:
        vals = np.array([d[2] for d in data if d[1] == g])
        for d in data:
            if d[1] == g:
                assert got[d[0]] == (vals < d[2]).sum() + ((vals == d[2]).sum() + 1) / 2
