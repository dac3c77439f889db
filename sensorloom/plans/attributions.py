"""Attribution and fact records over the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import attribution, models, ordering, prep, split
from ..operators.linalg import dense, loadings_table, vector
from ..sources import fixtures as fx
from . import drifts, gates as g
from . import sql
from .catalog import query
from .sql import CELLS, ERA, WAFER, with_

GIVEN, W = g.GIVEN, g.W
BASE = (WAFER, CELLS)
# coefficients per sensor and per component, and draws: given parameters
COEF = {s: round(0.3 * (-1) ** i * (i + 1), 6) for i, s in enumerate(GIVEN)}
COMP = [0.8, -0.5]
DRAWS = np.array([[round(0.4 + 0.1 * ((d * 7) % 11) - 0.3, 6), round(-0.2 + 0.05 * ((d * 5) % 9), 6)] for d in range(20)])

COEFS = sql.values([(s, float(b)) for s, b in COEF.items()], "coefs", "feature, coefficient")
COMPS = sql.values([(1, COMP[0]), (2, COMP[1])], "comps", "k, beta")
DRAW = sql.values([(d, k + 1, float(DRAWS[d, k])) for d in range(20) for k in range(2)], "draws", "draw, k, beta")


def _coefs(spark):
    return spark.createDataFrame(list(COEF.items()), "feature string, coefficient double")


def _draws(spark):
    return spark.createDataFrame([(d, k + 1, float(DRAWS[d, k])) for d in range(20) for k in range(2)], "draw int, k int, beta double")


CONTRIB = "contrib as (select raw_row_id, sensor as feature, x * coefficient as contribution, coefficient from xs join coefs on feature = sensor)"
TOP = "top_ as (select *, row_number() over (partition by raw_row_id order by abs(contribution) desc, feature)::int as rank from contrib)"


def _contrib(spark, sf):
    return attribution.linear_contributions(g._x(spark, sf), _coefs(spark), ["raw_row_id"])


@query("linear_contributions", with_(*BASE, g.X, COEFS, CONTRIB, TOP, final=f"select raw_row_id, rank, feature, {sql.r6('contribution')} as contribution, coefficient from top_ where rank <= 5"))
def _(spark, sf):
    return _contrib(spark, sf).withColumn("contribution", r6("contribution"))


LOCAL = (
    "tot as (select k, sum(abs(w)) as s from load group by 1)",
    "bp as (select raw_row_id, sensor as feature, sum(t * beta * w / s) as contribution from t join comps using (k) join load using (k) join tot using (k) group by 1, 2)",
)


def _scored(spark, sf):
    from ..operators.linalg import dense, vector

    z = dense(lambda x: x @ W, "array<double>")(vector(GIVEN))
    return g._x(spark, sf).select("raw_row_id", "target", z.alias("z")).select("raw_row_id", "target", F.col("z")[0].alias("pls_0"), F.col("z")[1].alias("pls_1"))


@query("backproject_local", with_(*BASE, *g.PCA, COMPS, *LOCAL, final=f"select * from (select raw_row_id, feature, {sql.r6('contribution')} as contribution, row_number() over (partition by raw_row_id order by abs(contribution) desc, feature)::int as rank from bp) where rank <= 5"))
def _(spark, sf):
    out = attribution.backproject_local(_scored(spark, sf), ["pls_0", "pls_1"], COMP, W, GIVEN, ["raw_row_id"])
    return out.withColumn("contribution", r6("contribution"))


# component importance from the data: spread of the component scores
IMP = "imp as (select k, stddev_pop(t) as importance from t group by k)"


def _importance(spark, sf):
    s = _scored(spark, sf).agg(F.stddev_pop("pls_0").alias("a"), F.stddev_pop("pls_1").alias("b"))
    return s.select(F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("a").alias("importance")), F.struct(F.lit(2).alias("k"), F.col("b").alias("importance")))))


@query("backproject_global", with_(*BASE, *g.PCA, IMP, final=f"select sensor as feature, {sql.r6('sum(abs(w) * importance)')} as importance from load join imp using (k) group by 1"))
def _(spark, sf):
    return attribution.backproject_global(loadings_table(spark, W, GIVEN), _importance(spark, sf)).withColumn("importance", r6("importance"))


@query("backproject_global_signed", with_(*BASE, *g.PCA, IMP, "c as (select sensor as feature, sum(w * importance) as coefficient from load join imp using (k) group by 1)",
    final=f"select feature, {sql.r6('coefficient')} as coefficient from (select * from (select * from c where coefficient > 0 order by coefficient desc, feature limit 2) union all select * from (select * from c where coefficient < 0 order by coefficient, feature limit 2))"))
def _(spark, sf):
    c = attribution.backproject_global(loadings_table(spark, W, GIVEN), _importance(spark, sf), signed=True)
    return ordering.signed_top(c, "coefficient", "feature", 2).withColumn("coefficient", r6("coefficient"))


# one draw per block of rows: the draws themselves come from the data
DATA_DRAWS = "dd as (select (raw_row_id % 25)::int as draw, k, avg(t) as beta from t group by 1, 2)"


def _data_draws(spark, sf):
    s = _scored(spark, sf).groupBy((F.col("raw_row_id") % 25).cast("int").alias("draw")).agg(F.avg("pls_0").alias("a"), F.avg("pls_1").alias("b"))
    return s.select("draw", F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("a").alias("beta")), F.struct(F.lit(2).alias("k"), F.col("b").alias("beta")))))


INTERVAL = f"{sql.r6('avg(b)')} as mean, {sql.r6('quantile_cont(b, 0.025)')} as hdi_low, {sql.r6('quantile_cont(b, 0.975)')} as hdi_high, quantile_cont(b, 0.025) > 0 or quantile_cont(b, 0.975) < 0 as robust, {sql.r6('abs(avg(b))')} as abs_mean"


def _round_interval(df):
    return df.withColumns({c: r6(c) for c in ("mean", "hdi_low", "hdi_high", "abs_mean")})


@query("posterior_backproject", with_(*BASE, *g.PCA, DATA_DRAWS, "sd as (select draw, sensor as feature, sum(beta * w) as b from dd join load using (k) group by 1, 2)", final=f"select feature, {INTERVAL} from sd group by feature order by abs(avg(b)) desc, feature limit {attribution.GLOBAL_TOP}"))
def _(spark, sf):
    return _round_interval(attribution.posterior_backproject(_data_draws(spark, sf), loadings_table(spark, W, GIVEN)))


@query("posterior_backproject_rows", with_(*BASE, *g.PCA, DRAW, "tot as (select k, sum(abs(w)) as s from load group by 1)",
    "sd as (select raw_row_id, draw, sensor as feature, sum(t * beta * w / s) as b from t join draws using (k) join load using (k) join tot using (k) group by 1, 2, 3)",
    f"iv as (select raw_row_id, feature, {INTERVAL}, row_number() over (partition by raw_row_id order by abs(avg(b)) desc, feature)::int as rank from sd group by 1, 2)", final="select * from iv where rank <= 3"))
def _(spark, sf):
    out = attribution.posterior_backproject_rows(_scored(spark, sf), ["pls_0", "pls_1"], DRAWS, W, GIVEN, ["raw_row_id"], 3)
    return _round_interval(out)


@query("coef_summary", with_(*BASE, *g.PCA, DATA_DRAWS, f"b as (select 'pls_' || (k - 1) as feature, beta as b from dd)", final=f"select feature, {sql.r6('stddev_pop(b)')} as sd, {INTERVAL} from b group by feature"))
def _(spark, sf):
    d = _data_draws(spark, sf).select("draw", F.concat(F.lit("pls_"), F.col("k") - 1).alias("feature"), "beta")
    return _round_interval(attribution.coef_summary(d)).withColumn("sd", r6("sd"))


@query("robust_sensor_map", with_(*BASE, *g.PCA, DATA_DRAWS, "cs as (select k, avg(beta) as mean, quantile_cont(beta, 0.025) > 0 or quantile_cont(beta, 0.975) < 0 as robust from dd group by k)",
    final="select sensor, arg_max(robust, abs(w) * abs(mean)) as robust from load join cs using (k) group by sensor"))
def _(spark, sf):
    d = _data_draws(spark, sf).select("draw", F.col("k").cast("string").alias("feature"), "beta")
    comps = attribution.coef_summary(d).select(F.col("feature").cast("int").alias("k"), "mean", "robust")
    return attribution.robust_sensor_map(loadings_table(spark, W, GIVEN), comps)


CALIB = [(0, -4.0, 1.5), (1, -3.5, 1.2), (2, -5.0, 2.0)]


@query("calibrated_interval", with_(*BASE, *g.PCA, DRAW, sql.values(CALIB, "cal", "fold, a, b"),
    "lg as (select raw_row_id, draw, sum(t * beta) as logit from t join draws using (k) group by 1, 2)",
    "pp as (select raw_row_id, 1 / (1 + exp(a / (1 + exp(-greatest(least(logit, 30), -30))) + b)) as p from lg, cal)",
    final=f"select raw_row_id, {sql.r6('quantile_cont(p, 0.025)')} as p_low, {sql.r6('quantile_cont(p, 0.975)')} as p_high from pp group by 1"))
def _(spark, sf):
    return _round2(_interval(spark, sf)).select("raw_row_id", "p_low", "p_high")


def _round2(df):
    return df.withColumns({"p_low": r6("p_low"), "p_high": r6("p_high")})


def _interval(spark, sf):
    """Every fold has the same draws here."""
    logits = dense(lambda x: np.tile(x @ DRAWS.T, len(CALIB)), "array<double>")(vector(["pls_0", "pls_1"]))
    cal = spark.createDataFrame(CALIB, "fold int, a double, b double")
    return attribution.calibrated_interval(_scored(spark, sf), logits, cal, ["raw_row_id", "target"])


@query("draws_score", with_(*BASE, *g.PCA, DRAW, "lg as (select raw_row_id, draw, sum(t * beta) + 0.1 as logit from t join draws using (k) group by 1, 2)",
    final=f"select raw_row_id, {sql.r6('avg(1 / (1 + exp(-greatest(least(logit, 30), -30))))')} as probability from lg group by 1"))
def _(spark, sf):
    d = _draws(spark).select("draw", F.concat(F.lit("pls_"), F.col("k") - 1).alias("feature"), "beta")
    d = d.unionByName(d.select("draw").distinct().select("draw", F.lit("(intercept)").alias("feature"), F.lit(0.1).alias("beta")))
    out = models.draws_score(_scored(spark, sf), ["pls_0", "pls_1"], d)
    return out.select("raw_row_id", r6("probability").alias("probability"))


@query("top_k_abs", with_(*BASE, "cr as (select sensor as feature, corr(value, raw_row_id) as coefficient from cells where sensor <> 'c_5' group by 1)", final=f"select feature, {sql.r6('coefficient')} as coefficient from cr order by abs(coefficient) desc, feature limit 15"))
def _(spark, sf):
    c = _data_coefs(spark, sf)
    return ordering.top_k_abs(c, "coefficient", "feature", 15).withColumn("coefficient", r6("coefficient"))


def _data_coefs(spark, sf):
    return g._data_loadings(spark, sf).where("k = 1").select(F.col("sensor").alias("feature"), F.col("w").alias("coefficient"))


@query("signed_top", with_(*BASE, "cr as (select sensor as feature, corr(value, raw_row_id) as coefficient from cells where sensor <> 'c_5' group by 1)",
    final=f"select feature, {sql.r6('coefficient')} as coefficient from (select * from (select * from cr where coefficient > 0 order by coefficient desc, feature limit 8) union all select * from (select * from cr where coefficient < 0 order by coefficient, feature limit 8))"))
def _(spark, sf):
    return ordering.signed_top(_data_coefs(spark, sf), "coefficient", "feature").withColumn("coefficient", r6("coefficient"))


@query("global_importance", with_(*BASE, "cr as (select sensor as feature, corr(value, raw_row_id) as coefficient from cells where sensor <> 'c_5' group by 1)", final=f"select feature, {sql.r6('coefficient')} as coefficient, {sql.r6('abs(coefficient)')} as abs_coefficient from cr order by abs(coefficient) desc, feature limit 15"))
def _(spark, sf):
    out = attribution.global_importance(_data_coefs(spark, sf))
    return out.withColumns({"coefficient": r6("coefficient"), "abs_coefficient": r6("abs_coefficient")})


# --- groups ------------------------------------------------------------------------------------

# Greedy merging by the definition: the two groups with the least mean distance, until eight are left.
GROUPS = (
    "amed as (select sensor, median(value) as median from cells join era using (raw_row_id) where split = 'train' group by sensor)",
    "fc as materialized (select raw_row_id, sensor, coalesce(value, median) as v from cells join amed using (sensor) join era using (raw_row_id) where split = 'train')",
    "pr as materialized (select a.sensor as a, b.sensor as b, corr(a.v, b.v) as r from fc a join fc b on a.raw_row_id = b.raw_row_id group by 1, 2)",
    "dist as materialized (select a, b, 1 - abs(case when r is null or isnan(r) then 0 else r end) as d from pr where a <> b)",
    f"""merged(step, sensor, g) as (
        select 0, sensor, sensor from amed
        union all
        select step + 1, sensor, case when g = m.b then m.a else g end
        from merged, (select x.g as a, y.g as b from merged x join merged y on x.g < y.g join dist on dist.a = x.sensor and dist.b = y.sensor
                      group by x.g, y.g order by avg(d), x.g, y.g limit 1) m
        where step < {len(fx.SENSORS) - attribution.GROUPS})""",
    f"lab as (select sensor, g, min(substr(sensor, 3)::int) over (partition by g) as first from merged where step = {len(fx.SENSORS) - attribution.GROUPS})",
    "numbered as (select sensor, 'G' || dense_rank() over (order by first) as g from lab)",
    "groups as (select sensor, g from numbered union all select sensor || '_rz', g from numbered)",
)


def _groups(spark, sf):
    s = split.temporal_split(fx.wafers(spark, sf)).drop("measurement_ts")
    s = s.where("split = 'train'")
    return attribution.sensor_groups(prep.median_impute(s, fx.SENSORS, prep.fit_median(s, fx.SENSORS)), fx.SENSORS)


@query("sensor_groups", "with recursive " + with_(WAFER, CELLS, ERA, *GROUPS, final='select sensor, g as "group" from groups')[5:])
def _(spark, sf):
    return _groups(spark, sf)


# --- records -----------------------------------------------------------------------------------

THR = 0.3
SHIFTS = drifts.DR[2:]
REC = (WAFER, CELLS, *SHIFTS, ERA, drifts.REF, drifts.SPC, *g.PCA, *[c for c in g.FACTOR if c not in (g.LOAD, g.X)], g.DENSITY, g.FFLAGS, COEFS, CONTRIB, TOP, DRAW, sql.values(CALIB, "cal", "fold, a, b"),
    "rob as (select sensor, w > 0 as robust from load where k = 1)",
    "lg as (select raw_row_id, draw, sum(t * beta) as logit from t join draws using (k) group by 1, 2)",
    "pp as (select raw_row_id, quantile_cont(p, 0.025) as p_low, quantile_cont(p, 0.975) as p_high, avg(p) as probability from (select raw_row_id, 1 / (1 + exp(a / (1 + exp(-greatest(least(logit, 30), -30))) + b)) as p from lg, cal) group by 1)",
    "en as (select o.*, s.z as spc_z, case when sh.sd > 0 then sh.shift end as drift_shift, coalesce(case when sh.sd > 0 then abs(sh.shift) > 0.05 end, false) as drift_flag, robust from top_ o left join spc s on s.raw_row_id = o.raw_row_id and s.sensor = o.feature left join sh on sh.sensor = o.feature left join rob on rob.sensor = o.feature where rank <= 5)",
)


def _enriched(spark, sf):
    """Rows with their enriched contributors: raw sensors for the z, their scaled form for the contributions."""
    rows = fx.wafers(spark, sf).withColumn("contributors", attribution.contributors(_coefs(spark), lambda c: 4 * F.coalesce(c, F.lit(0.0))))
    dr = drifts._drift(spark, sf).where(F.col("sensor").isin(*GIVEN))
    groups = spark.createDataFrame([(s, f"G{i % 3}") for i, s in enumerate(GIVEN[:4])], "sensor string, group string")
    _, ref = drifts._reference(spark, sf)
    e = attribution.enrich_contributors(rows, dr, groups, drifts.drift.fit_spc(ref, GIVEN), GIVEN, limit=0.05)
    robust = loadings_table(spark, W, GIVEN).where("k = 1").select("sensor", (F.col("w") > 0).alias("robust"))
    return attribution.annotate_robust(e, robust).select("raw_row_id", "contributors")


def _entries(spark, sf):
    return attribution.listed(_enriched(spark, sf), "contributors", ["raw_row_id"])


@query("enrich_contributors", with_(*REC, final=f"select raw_row_id, rank, feature, {sql.r6('spc_z')} as spc_z, {sql.r6('drift_shift')} as drift_shift, drift_flag, " + "coalesce(case feature " + " ".join(f"when '{s}' then 'G{i % 3}'" for i, s in enumerate(GIVEN[:4])) + " end, '—') as \"group\" from en"))
def _(spark, sf):
    return _entries(spark, sf).select("raw_row_id", "rank", "feature", r6("spc_z").alias("spc_z"), r6("drift_shift").alias("drift_shift"), "drift_flag", "group")


@query("annotate_robust", with_(*REC, final="select raw_row_id, feature, robust from en"))
def _(spark, sf):
    return _entries(spark, sf).select("raw_row_id", "feature", "robust")


@query("key_findings", with_(*REC, final=f"""select raw_row_id, arg_min(feature, rank) as top_driver, case when arg_min(contribution, rank) > 0 then 'toward Fail' else 'toward Pass' end as top_direction,
    {sql.r6('max(spc_z) filter (rank = 1)')} as top_spc_z, arg_min(drift_flag, rank) as top_drifting, count(*) as n_contributors, count(*) filter (drift_flag) as n_drifting, count(*) filter (robust) as n_robust from en group by 1"""))
def _(spark, sf):
    return attribution.key_findings(_enriched(spark, sf), ["raw_row_id"]).withColumn("top_spc_z", r6("top_spc_z"))


def _facts(spark, sf):
    p = _interval(spark, sf).withColumnRenamed("target", "y_true")
    out = p.withColumns({"y_pred": (F.col("probability") >= THR).cast("int"), "threshold": F.lit(THR)})
    from ..operators import gates as gate_ops

    gate_facts = gate_ops.wafer_gate_facts({"bayes": g._fflags(spark, sf)}, "raw_row_id")
    return attribution.wafer_facts(
        out, _enriched(spark, sf), gate_facts, "pls_bayes", "extrapolation", "raw_row_id", "PLS components, draws of coefficients", "coefficient x scaled value"
    )


@query("wafer_facts", with_(*REC,
    "cnt as (select raw_row_id, count(*) filter (drift_flag) as nd, count(*) filter (coefficient > 0) as nr, count(*) filter (coefficient <= 0) as nl, string_agg(feature || ':' || case when coefficient > 0 then 'positive' else 'negative' end, ',' order by rank) as top from en group by 1)",
    final=f"""select p.raw_row_id, case when wafer.target = 1 then 'Fail' else 'Pass' end as actual, case when probability >= 0.3 then 'Fail' else 'Pass' end as predicted,
      case when wafer.target = 1 and probability >= 0.3 then 'caught_fail' when wafer.target = 1 then 'missed_fail' when probability >= 0.3 then 'false_alarm' else 'correct_pass' end as outcome,
      round_even(probability, 4) as p_round, round_even(probability, 4) between 0.15 and 0.6 as borderline, nd::int as n_drifting, nr::int as n_raising, nl::int as n_lowering, top,
      case when p_high - p_low < 0.1 then 'low' when p_high - p_low <= 0.3 then 'moderate' else 'high' end as uncertainty, f.ooc as bayes_ooc
      from pp p join wafer using (raw_row_id) join cnt using (raw_row_id) join fflags f using (raw_row_id)"""))
def _(spark, sf):
    f = _facts(spark, sf)
    c = F.col("facts.top_contributors")
    top = F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["feature"], e["direction"])), ",")
    return f.select("raw_row_id", "facts.actual", "facts.predicted", "facts.outcome", F.col("facts.fail_probability").alias("p_round"), "facts.borderline",
                    F.col("facts.n_drifting_contributors").alias("n_drifting"), F.col("facts.n_raising_contributors").alias("n_raising"),
                    F.col("facts.n_lowering_contributors").alias("n_lowering"), top.alias("top"), "facts.uncertainty",
                    F.col("facts.process_gates.bayes.out_of_control").alias("bayes_ooc"))


@query("explanation_records")
def _(spark, sf):
    return attribution.explanation_records(_facts(spark, sf), "raw_row_id")


@query("definitions_for_facts", with_(*REC, final="""select p.raw_row_id, 'fail_probability,threshold,fail_probability_credible_interval,uncertainty,borderline,driver_direction,outcome_'
     || case when target = 1 and probability >= 0.3 then 'caught_fail' when target = 1 then 'missed_fail' when probability >= 0.3 then 'false_alarm' else 'correct_pass' end
     || case when exists (select 1 from en where en.raw_row_id = p.raw_row_id and spc_z is not null) then ',spc_z' else '' end
     || case when exists (select 1 from en where en.raw_row_id = p.raw_row_id and drift_flag) then ',drifting' else '' end
     || ',drift_shift,attribution_robust,process_gate,bgm_density,q_spe' as keys from pp p join wafer using (raw_row_id)"""))
def _(spark, sf):
    d = attribution.definitions_for_facts(_facts(spark, sf), "raw_row_id")
    return d.select("raw_row_id", F.array_join("definition_keys", ",").alias("keys"))
