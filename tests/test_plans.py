"""Plans that must hold at any size: what may not move, join or be sorted whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import attribution, drift, ordering, prep
from sensorloom.operators.frame import running_totals

SENSORS = [f"c_{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 7 == 0, *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=6)]) for i in range(300)]
    return spark.createDataFrame(data, "raw_row_id long, flag boolean, " + ", ".join(f"{c} double" for c in SENSORS)).repartition(4).cache()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contributors_never_leave_their_row(spark, rows):
    coefs = spark.createDataFrame([(c, float(i - 2)) for i, c in enumerate(SENSORS)], "feature string, coefficient double")
    shifts = spark.createDataFrame([(c, float(i)) for i, c in enumerate(SENSORS[:4])], "sensor string, shift double")
    groups = spark.createDataFrame([(c, "G1") for c in SENSORS[:2]], "sensor string, group string")
    robust = spark.createDataFrame([(c, i > 2) for i, c in enumerate(SENSORS[1:])], "sensor string, robust boolean")
    spc = drift.fit_spc(rows, SENSORS)
    told = rows.withColumn("contributors", attribution.contributors(coefs, lambda c: F.coalesce(F.col(c), F.lit(0.0)), 3))
    told = attribution.annotate_robust(attribution.enrich_contributors(told, shifts, groups, spc, SENSORS), robust)
    logits = attribution.dense(lambda x: np.tile(x[:, :2], 2), "array<double>")(attribution.vector(["raw_row_id", "raw_row_id"]))
    cal = spark.createDataFrame([(0, -4.0, 1.0), (1, -3.0, 1.0)], "fold int, a double, b double")
    complete = rows.select("raw_row_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SENSORS])
    frames = [
        told,
        attribution.key_findings(told, ["raw_row_id"]),
        attribution.listed(told, "contributors", ["raw_row_id"]),
        drift.drift_spikes(rows, SENSORS, spc, shifts, ["raw_row_id"], limit=0.5),
        attribution.calibrated_interval(rows, logits, cal, ["raw_row_id"]),
        attribution.posterior_backproject_rows(complete, SENSORS[:2], np.ones((9, 2)), np.ones((6, 2)), SENSORS, ["raw_row_id"], 3),
    ]
    for df in frames:
        text = plan(df).split("InMemoryRelation")[0]  # what stands above the cached rows
        assert "Exchange" not in text and "Join" not in text
        df.collect()
    r = told.where("raw_row_id = 5").first()
    assert len(r.contributors) == 3 and {"spc_z", "drift_shift", "drift_flag", "group", "robust"} <= set(r.contributors[0].asDict())


def test_null_cells_never_move_for_ranks(spark, rows):
    ranked = prep.rank_columns(rows, SENSORS)
    assert "Exchange" not in plan(ranked).split("InMemoryRelation")[0] and "Join" not in plan(ranked)
    got = {r.raw_row_id: r for r in ranked.collect()}
    raw = {r.raw_row_id: r for r in rows.collect()}
    for c in SENSORS:
        v = np.array([r[c] for r in raw.values() if r[c] is not None])
        for i, r in raw.items():
            assert got[i][c] == (None if r[c] is None else (v < r[c]).sum() + ((v == r[c]).sum() + 1) / 2)


def test_ranks_beyond_the_dictionary_limit_are_the_same(spark, rows, monkeypatch):
    want = {tuple(r) for r in prep.rank_columns(rows, SENSORS).collect()}
    monkeypatch.setattr(prep, "DICTIONARY_ROWS", 10)
    assert {tuple(r) for r in prep.rank_columns(rows, SENSORS).collect()} == want


def test_running_sums_sort_pieces_only(spark, rows):
    """The window is by piece of a group, never by the group alone."""
    text = plan(running_totals(rows.select("flag", "raw_row_id"), ["flag"], ["raw_row_id"], {"n": "raw_row_id"}))
    windows = [line for line in text.splitlines() if "Window [" in line and "raw_row_id" in line]
    assert windows and all("_piece" in line for line in windows)


def test_rolling_rates_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    flags = (rng.random(700) < 0.2).astype(int)
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(flags)], "id long, flag int").repartition(9)
    got = {r.id: (r.rolling_rate, r.cumulative_rate) for r in ordering.ooc_rates(df, ["id"], "flag").collect()}
    w = max(20, 700 // 10)
    for i in range(700):
        want = flags[max(0, i - w + 1) : i + 1].mean(), flags[: i + 1].mean()
        np.testing.assert_allclose(got[i], want, atol=1e-12)
