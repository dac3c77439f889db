"""Gates, attribution records and sources on tiny payloads."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import attribution, gates
from sensorloom.sources import text


@pytest.fixture(scope="module")
def holdout(spark):
    rows = [(10, -9.0, True, False, 0, True), (11, -1.0, False, False, 0, False), (12, -8.0, True, True, 1, True), (13, -2.0, False, False, 1, False)]
    return spark.createDataFrame(rows, "id int, density double, density_ooc boolean, q_ooc boolean, y_true int, ooc boolean")


def test_passing_ooc(holdout):
    assert [r.id for r in gates.passing_ooc_rows(holdout, "id").collect()] == [10]
    assert {r.id: r.ooc for r in gates.gate_flag_map(holdout, "id").collect()} == {10: True, 11: False, 12: True, 13: False}


def test_empty_inputs(holdout):
    none = holdout.where("id < 0")
    assert gates.passing_ooc_rows(none, "id").collect() == []
    with pytest.raises(ValueError):
        gates.passing_reference(none.withColumn("target", F.col("y_true")))


def test_quadrants(spark):
    df = spark.createDataFrame([(1.0, -1.0), (3.0, -1.0), (1.0, -9.0), (3.0, -9.0)], "t2 double, density double")
    r = gates.gate_disagreement(df, F.col("t2") > 2.0, F.col("density") < -5.0).first()
    assert (r.n_total, r.pca_only, r.bgm_only, r.both, r.neither) == (4, 1, 1, 1, 1)


def test_noise_and_contributions(spark):
    df = spark.createDataFrame([("quiet", 1.0, 1.0, 0.01), ("mid", 1.0, 1.0, 1.0), ("noisy", 5.0, 5.0, 100.0)], "sensor string, pca_resid double, sbfa_resid double, psi double")
    assert [r.sensor for r in gates.noise_ranking(df.select("sensor", "psi")).orderBy("rank").collect()] == ["noisy", "mid", "quiet"]
    c = {r.sensor: r for r in gates.contribution_compare(df).collect()}
    assert c["noisy"].pca_contribution == 1.0 and c["quiet"].sbfa_contribution == 1.0
    assert c["noisy"].sbfa_contribution < c["mid"].sbfa_contribution


def test_flags_add_up(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("t2"), (F.col("id") % 11).cast("double").alias("q"))
    for logic in ("or", "and"):
        r = gates.flag_breakdown(gates.gate_flags(df, {"t2": 4.0, "q": 8.0}, logic=logic)).first()
        assert r.n_flagged_either == r.n_flagged_t2 + r.n_flagged_q - r.n_flagged_both
        assert r.n_flagged_ooc + r.n_in_control == r.n_total == 200
    with pytest.raises(ValueError):
        gates.gate_flags(df, {"t2": 1.0}, logic="xor")


def test_pca_gate_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    names = [f"c_{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in names))
    g = gates.fit_pca_gate(df, names, 2)
    s = {r.id: (r.t2, r.q) for r in gates.t2_q_score(df, names, g.mean, g.loadings, g.eigen).collect()}
    c = x - x.mean(0)
    val, vec = np.linalg.eigh(np.cov(x.T))
    v, lam = vec[:, ::-1][:, :2], val[::-1][:2]
    t2 = ((c @ v) ** 2 / lam).sum(1)
    q = ((c - c @ v @ v.T) ** 2).sum(1)
    np.testing.assert_allclose([s[i] for i in range(200)], np.c_[t2, q], atol=1e-6)
    assert g.t2_ucl == pytest.approx(np.quantile(t2, 0.97)) and g.q_ucl == pytest.approx(np.quantile(q, 0.995))


def test_factor_gate_recovers_loadings_span(spark):
    rng = np.random.default_rng(7)
    w = rng.normal(size=(6, 2))
    x = rng.normal(size=(800, 2)) @ w.T + rng.normal(0, 0.1, (800, 6))
    names = [f"c_{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in names))
    g = gates.fit_factor_gate(df, names, k=2, modes=2, seeds=1)
    got = g.members[0][0]
    proj = got @ np.linalg.pinv(got)
    np.testing.assert_allclose(proj @ w, w, atol=0.1)
    flagged = gates.gate_flags(gates.factor_gate_score(df, g), {"q": g.q_ucl}, {"density": g.density_lcl})
    share = flagged.agg(F.avg(F.col("density_ooc").cast("double"))).first()[0]
    assert 0.02 <= share <= 0.04


def test_mixtures_of_all_members_settle_at_their_own_optimum(spark):
    """Against a plain NumPy EM from the same start, member by member."""
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 1, (300, 3)), rng.normal(4, 0.5, (200, 3)), rng.normal([-4, 4, 0], 0.7, (100, 3))]
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(6)
    projections = [rng.normal(size=(2, 3)), np.eye(3)[:2]]
    first = [gates._first_modes(x @ p.T, 4, np.cov((x @ p.T).T), np.random.default_rng(s)) for s, p in enumerate(projections)]
    got = gates.fit_mixtures(df.cache(), len(x), projections, first)
    assert abs(gates.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-9
    for p, mix, start in zip(projections, got, first, strict=True):
        z, m, value = x @ p.T, start, -np.inf
        while True:
            log = m.log_parts(z)
            total = np.logaddexp.reduce(log, axis=0)
            r = np.exp(log - total).T
            n = r.sum(0)
            mean = (r.T @ z) / n[:, None]
            cov = np.stack([((z - mean[k]) * r[:, k : k + 1]).T @ (z - mean[k]) / n[k] for k in range(4)]) + gates.EXTRA_VARIANCE * np.eye(2)
            done = abs(total.mean() - value) <= gates.SETTLED
            value = total.mean()
            alpha = 0.25 + n
            weights = alpha / alpha.sum() if done else np.exp(gates.digamma(alpha) - gates.digamma(np.array([alpha.sum()])))
            m = gates.Mixture(weights, mean, cov)
            if done:
                break
        np.testing.assert_allclose(mix.weights, m.weights, atol=1e-6)
        np.testing.assert_allclose(mix.means, m.means, atol=1e-5)
        assert mix.log_density(z).mean() > start.log_density(z).mean()


def test_full_coverage_is_global(spark):
    rows = [("m", i, int(i % 9 == 0), (i * 37 % 100) / 100) for i in range(200)]
    scores = spark.createDataFrame(rows, "pipeline string, id int, y_true int, y_score double")
    sev = scores.select("id", (F.col("id") % 10 / 10).alias("severity"))
    out = {r.coverage: r for r in gates.risk_coverage(scores, sev).collect()}
    from sensorloom.operators.metrics import auc_metrics

    assert out[1.0].roc_auc == pytest.approx(auc_metrics(scores, ["pipeline"]).first().roc_auc)
    assert out[0.8].n_kept == 160


def brute_linkage(d, most):
    """Merge the two groups of least mean distance until `most` are left."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > most:
        pairs = [(np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        _, x, y = min(pairs)
        groups[x] += groups.pop(y)
    return {frozenset(g) for g in groups}


def test_average_linkage_is_greedy_merging():
    rng = np.random.default_rng(6)
    for n, most in ((2, 1), (5, 3), (30, 8), (40, 1), (12, 12)):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        got = attribution.linkage_groups(d, most)
        assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == brute_linkage(d, most)
        assert got[0] == 1 and len(set(got.tolist())) == most


def test_correlated_sensors_share_a_group_with_their_twins(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    x = np.c_[base, base + rng.normal(0, 0.1, (300, 3))]
    names = [f"c_{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names))
    got = {r.sensor: r.group for r in attribution.sensor_groups(df, names, 3).collect()}
    assert [got[f"c_{i}"] for i in range(3)] == [got[f"c_{i + 3}"] for i in range(3)] == ["G1", "G2", "G3"]
    assert all(got[f"{c}_rz"] == got[c] for c in names)


def _facts(spark, outcome=(1, 1)):
    o = spark.createDataFrame([(1, *outcome, 0.82, 0.3, 0.6, 0.95)], "id int, y_true int, y_pred int, probability double, threshold double, p_low double, p_high double")
    c = spark.createDataFrame([(1, 1, "c_1", 0.5, 0.3, 2.5, 2.1, True, True), (1, 2, "c_2", -0.2, None, None, None, False, None)],
                              "id int, rank int, feature string, contribution double, coefficient double, spc_z double, drift_shift double, drift_flag boolean, robust boolean")
    c = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*c.columns[1:]))).alias("contributors"))
    g = gates.wafer_gate_facts({"bayes": spark.createDataFrame([(1, True, False, True)], "id int, density_ooc boolean, q_ooc boolean, ooc boolean")}, "id")
    return attribution.wafer_facts(o, c, g, "pls_bayes", "extrapolation", "id", "PLS, draws", "unit test")


def test_fact_record_round_trip(spark):
    f = _facts(spark)
    rec = json.loads(attribution.explanation_records(f, "id").first().record)
    assert rec["outcome"] == "caught_fail" and rec["uncertainty"] == "high" and rec["borderline"] is False
    assert rec["top_contributors"][0]["direction"] == "positive" and rec["top_contributors"][1]["direction"] == "lowers_fail_risk"
    assert "spc_z" not in rec["top_contributors"][1]
    assert (rec["model_name"], rec["feature_space"], rec["method"]) == ("PLS, draws", "sensor (PLS back-projected)", "unit test")
    assert rec["process_gates"]["bayes"] == {"out_of_control": True, "tripped": ["BGM density below limit"]}


def test_every_definition_is_reached(spark):
    seen = set()
    for o in ((1, 1), (1, 0), (0, 1), (0, 0)):
        keys = attribution.definitions_for_facts(_facts(spark, o), "id")
        row = keys.first().definition_keys
        assert len(row) == len(set(row))
        seen |= set(row)
        assert len(attribution.definition_texts(keys, "id").first().definitions) == len(row)
    assert seen == set(attribution.DEFINITIONS) - {"hotelling_t2"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "labels.txt").write_text('-1 "19/07/2008 11:55:00"\n\n1 "19/07/2008 12:32:00"\nlonely\n-1 "20/07/2008 01:00:00"\n')
    (tmp_path / "sensors.txt").write_text("1.5 NaN 3\n  4 5e-1 NaN\n7 8 9\n")
    labels = text.parse_label_lines(text.read_lines(spark, str(tmp_path / "labels.txt")))
    sensors = text.parse_sensor_lines(text.read_lines(spark, str(tmp_path / "sensors.txt")), 3)
    got = text.zip_by_row(labels, sensors, "line_pos").orderBy("raw_row_id").collect()
    assert [(r.raw_row_id, r.target, r.c_0, r.c_1, r.c_2) for r in got] == [(0, 0, 1.5, None, 3.0), (1, 1, 4.0, 0.5, None), (2, 0, 7.0, 8.0, 9.0)]
    with pytest.raises(ValueError):
        text.zip_by_row(labels.where("target = 0"), sensors, "line_pos")
    cells = text.parse_sensor_cells(text.read_lines(spark, str(tmp_path / "sensors.txt")))
    assert cells.where("value is null").count() == 2
