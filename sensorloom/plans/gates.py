"""Process gates over the test tables: with given parameters (checked by SQL) and fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import sensor_columns
from ..functions.scalar import r6
from ..operators import gates, metrics, ordering, split
from ..operators.linalg import loadings_matrix, loadings_table
from ..sources import fixtures as fx
from . import preparation as prep_plans
from . import sql
from .catalog import query
from .sql import CELLS, ERA, WAFER, with_

# Given parameters by rule, for all sensors of the shape.
GIVEN = list(fx.SENSORS)
W = np.array([[round(((i * 7 + 3 * k) % 13 - 6) / 40 + (i + 1) * 0.0007, 6) for k in (0, 2)] for i in range(len(GIVEN))])
LAMBDA = np.array([0.9, 0.5])
PSI = np.array([round(0.05 + 0.05 * (i * 5 % 8), 6) for i in range(len(GIVEN))])
MIX = gates.Mixture(np.array([0.6, 0.4]), np.array([[0.0, 0.1], [0.5, -0.3]]), np.array([[[0.5, 0.1], [0.1, 0.4]], [[0.8, -0.2], [-0.2, 0.6]]]))
LIMITS = {"t2": 5.3, "q": 366.0}
DENSITY_LCL, FACTOR_Q = -42.0, 360.0

LOAD = sql.values([(s, k + 1, float(W[i, k])) for i, s in enumerate(GIVEN) for k in range(2)], "load", "sensor, k, w")
EIG = sql.values([(k + 1, float(v)) for k, v in enumerate(LAMBDA)], "eig", "k, lam")
NOISE = sql.values([(s, float(v)) for s, v in zip(GIVEN, PSI)], "noise", "sensor, psi")
X = "xs as (select raw_row_id, measurement_ts, target, sensor, 4 * coalesce(value, 0) as x from cells where sensor in (" + ", ".join(f"'{s}'" for s in GIVEN) + "))"
PCA = (
    LOAD, EIG, X,
    "t as (select raw_row_id, k, sum(x * w) as t from xs join load using (sensor) group by 1, 2)",
    "recon as (select raw_row_id, sensor, sum(t * w) as xr from t join load using (k) group by 1, 2)",
    "resid as (select raw_row_id, sensor, x - xr as resid from xs join recon using (raw_row_id, sensor))",
    "stat as (select raw_row_id, (select sum(t * t / lam) from t join eig using (k) where t.raw_row_id = r.raw_row_id) as t2, sum(resid * resid) as q from resid r group by raw_row_id)",
)
FACTOR = (
    LOAD, NOISE, X,
    "a as (select p.k as i, q.k as j, sum(p.w * q.w / psi) + case when p.k = q.k then 1 else 0 end as a from load p join load q using (sensor) join noise using (sensor) group by 1, 2)",
    "d as (select max(a) filter (i = 1 and j = 1) as a11, max(a) filter (i = 1 and j = 2) as a12, max(a) filter (i = 2 and j = 2) as a22 from a)",
    "b as (select raw_row_id, sum(w * x / psi) filter (k = 1) as b1, sum(w * x / psi) filter (k = 2) as b2 from xs join load using (sensor) join noise using (sensor) group by 1)",
    "z as (select raw_row_id, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) as z1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) as z2 from b, d)",
    "fr as (select raw_row_id, sensor, x - (z1 * w1 + z2 * w2) as resid from xs join z using (raw_row_id) join (select sensor, max(w) filter (k = 1) as w1, max(w) filter (k = 2) as w2 from load group by 1) using (sensor))",
    "fq as (select raw_row_id, sum(resid * resid) as q from fr group by 1)",
)


def _comp(c: int) -> str:
    (m1, m2), s = MIX.means[c].tolist(), MIX.covs[c].round(12)
    det = float(s[0, 0] * s[1, 1] - s[0, 1] ** 2)
    quad = f"(({s[1, 1]} * pow(z1 - {m1}, 2) - 2 * {s[0, 1]} * (z1 - {m1}) * (z2 - ({m2})) + {s[0, 0]} * pow(z2 - ({m2}), 2)) / {det!r})"
    return f"{MIX.weights[c]} * exp(-0.5 * {quad}) / (2 * pi() * sqrt({det!r}))"


DENSITY = f"dens as (select raw_row_id, ln({_comp(0)} + {_comp(1)}) as density from z)"
BASE = (WAFER, CELLS)


def _x(spark, sf):
    w = fx.wafers(spark, sf)
    return w.select("raw_row_id", "measurement_ts", "target", *[(4 * F.coalesce(c, F.lit(0.0))).alias(c) for c in GIVEN])


def _pca(spark, sf):
    w = loadings_matrix(loadings_table(spark, W, GIVEN), GIVEN)
    return gates.t2_q_score(_x(spark, sf), GIVEN, np.zeros(len(GIVEN)), w, LAMBDA).drop(*GIVEN)


def _factor(spark, sf):
    scored = gates.factor_score(_x(spark, sf), GIVEN, W, PSI)
    return gates.mixture_log_density(scored, "z", MIX).drop(*GIVEN)


@query("t2_q_score", with_(*BASE, *PCA, final=f"select raw_row_id, {sql.r6('t2')} as t2, {sql.r6('q')} as q from stat"))
def _(spark, sf):
    return _pca(spark, sf).select("raw_row_id", r6("t2").alias("t2"), r6("q").alias("q"))


@query("residuals", with_(*BASE, *PCA, final=f"select raw_row_id, sensor, {sql.r6('resid')} as resid from resid"))
def _(spark, sf):
    return gates.residuals(_x(spark, sf), GIVEN, np.zeros(len(GIVEN)), W, ["raw_row_id"]).withColumn("resid", r6("resid"))


@query("factor_score", with_(*BASE, *FACTOR, final=f"select raw_row_id, {sql.r6('z1')} as z1, {sql.r6('z2')} as z2, {sql.r6('q')} as q from z join fq using (raw_row_id)"))
def _(spark, sf):
    f = gates.factor_score(_x(spark, sf), GIVEN, W, PSI)
    return f.select("raw_row_id", r6(F.col("z")[0]).alias("z1"), r6(F.col("z")[1]).alias("z2"), r6("q").alias("q"))


@query("mixture_log_density", with_(*BASE, *FACTOR, DENSITY, final=f"select raw_row_id, {sql.r6('density')} as density from dens"))
def _(spark, sf):
    return _factor(spark, sf).select("raw_row_id", r6("density").alias("density"))


@query("control_limits", with_(*BASE, *PCA, final=f"select {sql.r6('quantile_cont(t2, 0.97)')} as t2_ucl, {sql.r6('quantile_cont(q, 0.995)')} as q_ucl from stat join wafer using (raw_row_id) where target = 0"))
def _(spark, sf):
    out = gates.control_limits(gates.passing_reference(_pca(spark, sf)), {"t2": gates.T2_ALPHA, "q": gates.Q_ALPHA})
    return out.select(r6("t2_ucl").alias("t2_ucl"), r6("q_ucl").alias("q_ucl"))


FLAGS = f"flags as (select raw_row_id, measurement_ts, target, t2, q, t2 > {LIMITS['t2']} as t2_ooc, q > {LIMITS['q']} as q_ooc from stat join wafer using (raw_row_id))"
FFLAGS = f"fflags as (select raw_row_id, measurement_ts, target, density, q, density < {DENSITY_LCL} as density_ooc, q > {FACTOR_Q} as q_ooc, density < {DENSITY_LCL} or q > {FACTOR_Q} as ooc from dens join fq using (raw_row_id) join wafer using (raw_row_id))"


def _flags(spark, sf, logic="or"):
    return gates.gate_flags(_pca(spark, sf), LIMITS, logic=logic)


def _fflags(spark, sf):
    return gates.gate_flags(_factor(spark, sf), {"q": FACTOR_Q}, {"density": DENSITY_LCL})


@query("gate_flags", with_(*BASE, *PCA, FLAGS, final="select raw_row_id, t2_ooc, q_ooc, t2_ooc and q_ooc as both_ooc, t2_ooc or q_ooc as either_ooc, t2_ooc or q_ooc as ooc from flags"))
def _(spark, sf):
    return _flags(spark, sf).select("raw_row_id", "t2_ooc", "q_ooc", "both_ooc", "either_ooc", "ooc")


@query("flag_breakdown", with_(*BASE, *PCA, FLAGS, final="""select count(*) as n_total, count(*) filter (t2_ooc) as n_flagged_t2, count(*) filter (q_ooc) as n_flagged_q, count(*) filter (t2_ooc and q_ooc) as n_flagged_both,
   count(*) filter (t2_ooc or q_ooc) as n_flagged_either, count(*) filter (t2_ooc and q_ooc) as n_flagged_ooc, count(*) filter (not (t2_ooc and q_ooc)) as n_in_control from flags"""))
def _(spark, sf):
    return gates.flag_breakdown(_flags(spark, sf, "and"))


@query("passing_reference", with_(*BASE, ERA, final="select raw_row_id from era where split = 'train' and target = 0"))
def _(spark, sf):
    return gates.passing_reference(split.temporal_split(_x(spark, sf))).select("raw_row_id")


SEV = (
    "ref as (select stat.* from stat join era using (raw_row_id) where split = 'train' and target = 0)",
    "sev as (select s.raw_row_id, greatest((select avg((r.t2 <= s.t2)::int) from ref r), (select avg((r.q <= s.q)::int) from ref r)) as severity from stat s join era using (raw_row_id) where split = 'test')",
)


def _pca_split(spark, sf):
    return split.temporal_split(_pca(spark, sf))


def _severity(spark, sf):
    s = _pca_split(spark, sf)
    return gates.ooc_severity(gates.passing_reference(s), s.where("split = 'test'"), ["raw_row_id"], ["t2", "q"])


@query("ooc_severity", with_(*BASE, ERA, *PCA, *SEV, final=f"select raw_row_id, {sql.r6('severity')} as severity from sev"))
def _(spark, sf):
    return _severity(spark, sf).withColumn("severity", r6("severity"))


@query("ooc_severity_density", with_(*BASE, ERA, *FACTOR, DENSITY,
    "fs as (select raw_row_id, density, q, split, era.target from dens join fq using (raw_row_id) join era using (raw_row_id))",
    "ref as (select * from fs where split = 'train' and target = 0)",
    final=f"select s.raw_row_id, {sql.r6('greatest((select avg((r.density >= s.density)::int) from ref r), (select avg((r.q <= s.q)::int) from ref r))')} as severity from fs s where split = 'test'"))
def _(spark, sf):
    s = split.temporal_split(_factor(spark, sf).drop("z"))
    sev = gates.ooc_severity(gates.passing_reference(s), s.where("split = 'test'"), ["raw_row_id"], ["q"], ["density"])
    return sev.withColumn("severity", r6("severity"))


# scores of three models over the same rows as the gate
GSCORES = "gscores as (select pipeline, raw_row_id as id, target as y_true, cast((raw_row_id * m) % 97 + target * 30 as double) / cast(650 as double) as y_score from wafer, (values ('alpha', 37), ('beta', 41), ('gamma', 43)) p(pipeline, m))"


def _gscores(spark, sf):
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("pipeline"), F.lit(m).alias("m")) for n, m in (("alpha", 37), ("beta", 41), ("gamma", 43))]))
    return fx.wafers(spark, sf).select("raw_row_id", "target", models.alias("p")).selectExpr(
        "p.pipeline as pipeline", "raw_row_id as id", "target as y_true", "cast((raw_row_id * p.m) % 97 + target * 30 as double) / 650D as y_score"
    )


def _auc_sql(src: str, tag: str, keys: str) -> tuple[str, str]:
    k = [x.strip() for x in keys.split(",")]
    on = " and ".join(f"a.{x} = b.{x}" for x in k)
    sel = ", ".join(f"a.{x}" for x in k)
    return (
        f"auc_{tag} as (select {sel}, avg(case when a.y_score > b.y_score then 1.0 when a.y_score = b.y_score then 0.5 else 0.0 end) as roc_auc from {src} a join {src} b on {on} and a.y_true = 1 and b.y_true = 0 group by {sel})",
        f"ap_{tag} as (select {keys}, avg(pr) as pr_auc from (select {sel}, a.id, sum(b.y_true)::double / count(*) as pr from {src} a join {src} b on {on} and a.y_true = 1 and b.y_score >= a.y_score group by {sel}, a.id) group by {keys})",
    )


CONDITIONAL = (
    *BASE, *PCA, FLAGS, GSCORES,
    "js as (select g.*, t2_ooc or q_ooc as ooc from gscores g join flags f on f.raw_row_id = g.id)", "ins as (select * from js where not ooc)",
    *_auc_sql("js", "g", "pipeline"), *_auc_sql("ins", "c", "pipeline"),
    "n as (select pipeline, count(*) as n_total, count(*) filter (not ooc) as n_in_control, sum(y_true)::bigint as n_fails_total, coalesce(sum(y_true) filter (not ooc), 0)::bigint as n_fails_in_control, sum(1 - y_true) filter (not ooc) as negs from js group by 1)",
)
CONDITIONAL_ROW = f"""select n.pipeline, n_total, n_in_control, n_fails_total, n_fails_in_control, {sql.r6('n_in_control / n_total::double')} as coverage, n_total - n_in_control as n_flagged_ooc, n_fails_total - n_fails_in_control as n_fails_flagged_ooc,
      {sql.r6('ap_g.pr_auc')} as global_pr_auc, {sql.r6('auc_g.roc_auc')} as global_roc_auc, {sql.r6('case when n_fails_in_control >= 5 and negs > 0 then ap_c.pr_auc end')} as conditional_pr_auc, {sql.r6('case when n_fails_in_control >= 5 and negs > 0 then auc_c.roc_auc end')} as conditional_roc_auc"""
CONDITIONAL_FROM = "from n join ap_g using (pipeline) join auc_g using (pipeline) left join ap_c using (pipeline) left join auc_c using (pipeline)"


@query("gate_conditional", with_(*CONDITIONAL, final=f"{CONDITIONAL_ROW} {CONDITIONAL_FROM}"))
def _(spark, sf):
    flags = _flags(spark, sf).select(F.col("raw_row_id").alias("id"), "ooc")
    out = gates.gate_conditional(_gscores(spark, sf), flags)
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double"})


@query("gate_conditional_interval", with_(*CONDITIONAL, "flagged as (select *, y_score >= 0.5 as hit from ins)", *sql.bootstrap("flagged", 1000),
    f"bands as (select pipeline, {sql.intervals(('pr_auc',))} from per_draw group by pipeline)",
    final=f"""{CONDITIONAL_ROW}, case when n_fails_in_control >= 5 and negs > 0 then pr_auc_ci_low end as conditional_pr_auc_ci_low,
      case when n_fails_in_control >= 5 and negs > 0 then pr_auc_ci_high end as conditional_pr_auc_ci_high {CONDITIONAL_FROM} left join bands using (pipeline)"""))
def _(spark, sf):
    flags = _flags(spark, sf).select(F.col("raw_row_id").alias("id"), "ooc")
    out = gates.gate_conditional(_gscores(spark, sf), flags, n_boot=1000)
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double"})


KEPT = (
    "covs(coverage) as (values (cast(1.0 as double)), (0.99), (0.95), (0.9), (0.85), (0.8))",
    "ranked as (select raw_row_id as id, row_number() over (order by severity, raw_row_id) as rn, count(*) over () as n from sev_all)",
    "kept as (select id, coverage from ranked, covs where rn <= round_even(coverage * n, 0))",
)
SEV_ALL = (
    "ref as (select stat.* from stat join era using (raw_row_id) where split = 'train' and target = 0)",
    "sev_all as (select s.raw_row_id, greatest((select avg((r.t2 <= s.t2)::int) from ref r), (select avg((r.q <= s.q)::int) from ref r)) as severity from stat s)",
)


def _severity_all(spark, sf):
    s = _pca_split(spark, sf)
    sev = gates.ooc_severity(gates.passing_reference(s), s, ["raw_row_id"], ["t2", "q"])
    return sev.withColumnRenamed("raw_row_id", "id")


@query("keep_least_suspicious", with_(*BASE, ERA, *PCA, *SEV_ALL, *KEPT, final="select id, coverage from kept"))
def _(spark, sf):
    return gates.keep_least_suspicious(_severity_all(spark, sf))


@query("risk_coverage", with_(*BASE, ERA, *PCA, *SEV_ALL, *KEPT, GSCORES, "ks as (select g.*, coverage from gscores g join kept using (id))", *_auc_sql("ks", "k", "pipeline, coverage"),
    "n as (select pipeline, coverage, count(*) as n_kept, sum(y_true)::bigint as n_fails_kept from ks group by 1, 2)",
    final=f"select pipeline, coverage, n_kept, n_fails_kept, {sql.r6('case when n_fails_kept >= 5 then pr_auc end')} as pr_auc, {sql.r6('case when n_fails_kept >= 5 then roc_auc end')} as roc_auc from n left join ap_k using (pipeline, coverage) left join auc_k using (pipeline, coverage)"))
def _(spark, sf):
    out = gates.risk_coverage(_gscores(spark, sf), _severity_all(spark, sf))
    return out.withColumns({"pr_auc": r6("pr_auc"), "roc_auc": r6("roc_auc")})


@query("coverage_drift", with_(*BASE, ERA, *PCA, FLAGS, *[c for c in FACTOR if c not in (LOAD, X)], DENSITY, FFLAGS,
    """cov as (select 'pca' as gate, split, avg((not (t2_ooc or q_ooc))::int) as c from flags join era using (raw_row_id) group by 2
       union all select 'bayes', split, avg((not ooc)::int) from fflags join era using (raw_row_id) group by 2)""",
    final=f"select gate, {sql.r6('''100 * max(c) filter (split = 'train')''')} as interpolation_pct, {sql.r6('''100 * max(c) filter (split = 'test')''')} as extrapolation_pct, {sql.r6('''100 * (max(c) filter (split = 'test') - max(c) filter (split = 'train'))''')} as delta_pct from cov group by gate"))
def _(spark, sf):
    rows = None
    for name, flagged in (("pca", _flags(spark, sf)), ("bayes", _fflags(spark, sf))):
        s = split.temporal_split(flagged.select("raw_row_id", "measurement_ts", "ooc"))
        track = F.when(F.col("split") == "train", "interpolation").otherwise("extrapolation")
        cov = s.groupBy(F.lit(name).alias("gate"), track.alias("track")).agg(F.avg((~F.col("ooc")).cast("double")).alias("coverage"))
        rows = cov if rows is None else rows.unionByName(cov)
    out = gates.coverage_drift(rows)
    return out.select("gate", *[r6(c).alias(c) for c in out.columns[1:]])


FACTOR_BASE = (*BASE, ERA, *FACTOR, DENSITY)


@query("below_limit_share", with_(*FACTOR_BASE, final=f"select split as population, count(*) filter (density < {DENSITY_LCL}) as n_below, count(density) as n, {sql.r6(f'100 * avg((density < {DENSITY_LCL})::int)')} as pct_below from dens join era using (raw_row_id) group by 1"))
def _(spark, sf):
    s = split.temporal_split(_factor(spark, sf).drop("z")).withColumnRenamed("split", "population")
    return gates.below_limit_share(s, "density", DENSITY_LCL).withColumn("pct_below", r6("pct_below"))


BOTH = (*BASE, *PCA, *[c for c in FACTOR if c not in (LOAD, X)], DENSITY)


@query("gate_disagreement", with_(*BOTH, f"j as (select t2 > {LIMITS['t2']} as p, density < {DENSITY_LCL} as b from stat join dens using (raw_row_id) join wafer using (raw_row_id) where target = 0)",
    final="select count(*) as n_total, count(*) filter (p and not b) as pca_only, count(*) filter (not p and b) as bgm_only, count(*) filter (p and b) as both, count(*) filter (not p and not b) as neither from j"))
def _(spark, sf):
    j = _pca(spark, sf).where("target = 0").select("raw_row_id", "t2").join(_factor(spark, sf).select("raw_row_id", "density"), "raw_row_id")
    return gates.gate_disagreement(j, F.col("t2") > LIMITS["t2"], F.col("density") < DENSITY_LCL)


PSI_FIT = "psi as (select sensor, var_pop(value) as psi from cells group by sensor)"


def _psi(spark, sf):
    from ..operators.frame import sensor_stats

    return sensor_stats(fx.wafers(spark, sf), fx.SENSORS, {"psi": F.var_pop})


@query("noise_ranking", with_(*BASE, PSI_FIT, final=f"select sensor, {sql.r6('psi')} as psi, row_number() over (order by psi desc, sensor)::int as rank, {sql.r6('max(psi) over () / min(psi) filter (psi > 0) over ()', 4)} as spread from psi"))
def _(spark, sf):
    return gates.noise_ranking(_psi(spark, sf)).withColumns({"psi": r6("psi"), "spread": r6("spread", 4)})


EXAMPLE = ("ex as (select raw_row_id from fq order by q desc, raw_row_id limit 1)",
    "er as (select r.sensor, r.resid as pca_resid, f.resid as sbfa_resid, psi from resid r join fr f using (raw_row_id, sensor) join noise using (sensor) join ex using (raw_row_id))")


def _example(spark, sf):
    x = _x(spark, sf)
    top = gates.example_row(gates.factor_score(x, GIVEN, W, PSI), "q", "raw_row_id").select("raw_row_id", *GIVEN)
    p = gates.residuals(top, GIVEN, np.zeros(len(GIVEN)), W, ["raw_row_id"]).withColumnRenamed("resid", "pca_resid")
    f = gates.factor_residuals(top, GIVEN, W, PSI, ["raw_row_id"]).withColumnRenamed("resid", "sbfa_resid")
    psi = spark.createDataFrame([(s, float(v)) for s, v in zip(GIVEN, PSI)], "sensor string, psi double")
    return p.join(f, ["raw_row_id", "sensor"]).join(psi, "sensor")


@query("example_row", with_(*BOTH, *EXAMPLE, final=f"select raw_row_id, sensor, {sql.r6('pca_resid')} as pca_resid, {sql.r6('sbfa_resid')} as sbfa_resid from er, ex"))
def _(spark, sf):
    return _example(spark, sf).select("raw_row_id", "sensor", r6("pca_resid").alias("pca_resid"), r6("sbfa_resid").alias("sbfa_resid"))


CONTRIB = "cc as (select sensor, pca_resid * pca_resid / max(pca_resid * pca_resid) over () as a, sbfa_resid * sbfa_resid / psi / max(sbfa_resid * sbfa_resid / psi) over () as b from er)"


@query("contribution_compare", with_(*BOTH, *EXAMPLE, CONTRIB, final=f"select sensor, {sql.r6('a')} as pca_contribution, {sql.r6('b')} as sbfa_contribution from cc"))
def _(spark, sf):
    out = gates.contribution_compare(_example(spark, sf))
    return out.select("sensor", r6("pca_contribution").alias("pca_contribution"), r6("sbfa_contribution").alias("sbfa_contribution"))


@query("rank_union_top_k", with_(*BOTH, *EXAMPLE, CONTRIB,
    "rr as (select *, row_number() over (order by a desc, sensor) as r1, row_number() over (order by b desc, sensor) as r2 from cc)",
    final="select sensor, (row_number() over (order by b, sensor desc) - 1)::int as place from rr where r1 <= 3 or r2 <= 3"))
def _(spark, sf):
    cc = gates.contribution_compare(_example(spark, sf))
    return ordering.rank_union_top_k(cc, "pca_contribution", "sbfa_contribution", "sensor", 3).select("sensor", "place")


# posterior mode per row gives mixture weights that come from the data
@query("active_modes", with_(*BASE, *FACTOR, f"m as (select case when {_comp(0)} >= {_comp(1)} then 1 else 2 end as mode from z)",
    final=f"select mode, {sql.r6('count(*) / sum(count(*)) over ()::double')} as weight, row_number() over (order by count(*) desc, mode)::int as rank, count(*) filter (count(*) / (select count(*) from m)::double >= 0.05) over () as n_active from m group by mode".replace(
        "count(*) filter (count(*) / (select count(*) from m)::double >= 0.05) over ()", "(select count(*) from (select mode from m group by mode having count(*) >= 0.05 * (select count(*) from m)))")))
def _(spark, sf):
    from ..operators.linalg import dense

    z = gates.factor_score(_x(spark, sf), GIVEN, W, PSI).select("z")
    parts = [gates.Mixture(MIX.weights[c : c + 1], MIX.means[c : c + 1], MIX.covs[c : c + 1]) for c in range(2)]
    mode = dense(lambda v: 1.0 + (parts[1].log_density(v) > parts[0].log_density(v)), "double")
    counts = z.select(mode(F.col("z")).cast("int").alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    weights = counts.crossJoin(F.broadcast(total)).select("mode", (F.col("n") / F.col("t")).alias("weight"))
    return gates.active_modes(weights).withColumn("weight", r6("weight"))


@query("gate_distribution", with_(*FACTOR_BASE, final=f"select split as population, {sql.r6('quantile_cont(density, 0.25)')} as q1, {sql.r6('median(density)')} as median, {sql.r6('quantile_cont(density, 0.75)')} as q3, {sql.r6('avg(density)')} as mean, count(density) as n from dens join era using (raw_row_id) group by 1"))
def _(spark, sf):
    s = split.temporal_split(_factor(spark, sf).drop("z")).withColumnRenamed("split", "population")
    out = gates.gate_distribution(s, "density")
    return out.withColumns({c: r6(c) for c in ("q1", "median", "q3", "mean")})


ELLIPSE = f"""p as (select avg(c_1) as mx, avg(c_2) as my, var_pop(c_1) as xx, covar_pop(c_1, c_2) as xy, var_pop(c_2) as yy from (select {', '.join(f'4 * coalesce({c}, 0) as {c}' for c in ('c_1', 'c_2'))} from wafer)),
axes as (select *, sqrt((xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy)) as major, sqrt((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy)) as minor,
   atan2(2 * xy, xx - yy) / 2 as tilt, sqrt(-2 * ln({gates.T2_ALPHA}::double)) as r from p),
turn as (select i::int as point, 2 * pi() * i / 59 as t, * from axes, generate_series(0, 59) g(i))"""


@query("control_ellipse", with_(*BASE, ELLIPSE, final=f"""select point, {sql.r6('mx + r * major * cos(t) * cos(tilt) - r * minor * sin(t) * sin(tilt)')} as x,
    {sql.r6('my + r * major * cos(t) * sin(tilt) + r * minor * sin(t) * cos(tilt)')} as y from turn"""))
def _(spark, sf):
    x = _x(spark, sf)
    params = x.agg(F.avg("c_1").alias("mean_x"), F.avg("c_2").alias("mean_y"), F.var_pop("c_1").alias("xx"), F.covar_pop("c_1", "c_2").alias("xy"), F.var_pop("c_2").alias("yy"))
    e = gates.control_ellipse(params, gates.chi2_radius(gates.T2_ALPHA))
    return e.select("point", r6("x").alias("x"), r6("y").alias("y"))


@query("quadrant_points", with_(*BASE, *PCA, FLAGS, final="select raw_row_id, case when target = 1 and (t2_ooc or q_ooc) then 'caught_fail' when target = 1 then 'missed_fail' when t2_ooc or q_ooc then 'flagged_pass' else 'pass' end as quadrant from flags"))
def _(spark, sf):
    return _flags(spark, sf).select("raw_row_id", gates.quadrant(F.col("target"), F.col("ooc")).alias("quadrant"))


@query("gate_diagnostics", with_(*BASE, *PCA, FLAGS, final=f"""select 'pca' as gate, raw_row_id, measurement_ts, 't2' as stat, {sql.r6('t2')} as value, t2_ooc as flag from flags union all select 'pca', raw_row_id, measurement_ts, 'q', {sql.r6('q')}, q_ooc from flags"""))
def _(spark, sf):
    d = gates.gate_diagnostics(_flags(spark, sf), ["t2", "q"], ["raw_row_id", "measurement_ts"], gate="pca")
    return d.withColumn("value", r6("value"))


@query("wafer_gate_facts", with_(*BOTH, FLAGS, FFLAGS, final="""select p.raw_row_id, p.t2_ooc or p.q_ooc as pca_ooc, array_to_string(list_filter([case when p.t2_ooc then 'Hotelling T2 above limit' end, case when p.q_ooc then 'Q/SPE above limit' end], lambda x: x is not null), '|') as pca_tripped,
    b.ooc as bayes_ooc, array_to_string(list_filter([case when b.q_ooc then 'Q/SPE above limit' end, case when b.density_ooc then 'BGM density below limit' end], lambda x: x is not null), '|') as bayes_tripped from flags p join fflags b using (raw_row_id)"""))
def _(spark, sf):
    f = gates.wafer_gate_facts({"pca": _flags(spark, sf), "bayes": _fflags(spark, sf)}, "raw_row_id")
    return f.select("raw_row_id", F.col("pca.out_of_control").alias("pca_ooc"), F.concat_ws("|", "pca.tripped").alias("pca_tripped"),
                    F.col("bayes.out_of_control").alias("bayes_ooc"), F.concat_ws("|", "bayes.tripped").alias("bayes_tripped"))


@query("gate_flag_map", with_(*BASE, *FACTOR, DENSITY, FFLAGS, final="select raw_row_id, ooc from fflags"))
def _(spark, sf):
    return gates.gate_flag_map(_fflags(spark, sf), "raw_row_id")


@query("passing_ooc_rows", with_(*BASE, *FACTOR, DENSITY, FFLAGS, final=f"select raw_row_id, {sql.r6('density')} as density, row_number() over (order by density nulls last, raw_row_id) as place from fflags where ooc and target = 0"))
def _(spark, sf):
    out = gates.passing_ooc_rows(_fflags(spark, sf), "raw_row_id", label="target")
    return out.select("raw_row_id", r6("density").alias("density"), "place")


# the gate knows the later rows only; the others count as in control
@query("triage_filter", with_(*BASE, ERA, *FACTOR, DENSITY, FFLAGS, GSCORES,
    final="""select g.pipeline, g.id from gscores g left join (select raw_row_id, ooc from fflags join era using (raw_row_id) where split = 'test') f on f.raw_row_id = g.id
      where y_true = 0 and y_score >= 0.1 and not coalesce(ooc, false)"""))
def _(spark, sf):
    o = metrics.outcome_labels(_gscores(spark, sf), 0.1)
    later = split.temporal_split(_fflags(spark, sf).drop("z")).where("split = 'test'")
    flags = later.select(F.col("raw_row_id").alias("id"), "ooc")
    return gates.triage_filter(o, flags, "false_alarm", "in_control").select("pipeline", "id")


@query("top_loading_sensors", with_(*BASE, "ld as (select sensor, 1 as k, corr(value, raw_row_id) as w from cells where value is not null and sensor <> 'c_5' group by 1 union all select sensor, 2, corr(value, target) from cells where sensor <> 'c_5' group by 1)",
    "rk as (select *, row_number() over (partition by k order by abs(w) desc, sensor) as r from ld)", final="select k, string_agg(sensor, ', ' order by r) as top_sensors from rk where r <= 3 group by k"))
def _(spark, sf):
    return ordering.top_loading_sensors(_data_loadings(spark, sf))


def _data_loadings(spark, sf):
    from ..operators.frame import sensor_stats

    names = [s for s in fx.SENSORS if s != "c_5"]
    c = sensor_stats(fx.wafers(spark, sf), names, {"w1": lambda s: F.corr(s, "raw_row_id"), "w2": lambda s: F.corr(s, "target")}, ids=["raw_row_id", "target"])
    return c.select("sensor", F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("w1").alias("w")), F.struct(F.lit(2).alias("k"), F.col("w2").alias("w")))))


@query("strongest_sensors", with_(*BASE, "ld as (select sensor, greatest(abs(corr(value, raw_row_id)), abs(corr(value, target))) as m from cells where sensor <> 'c_5' group by 1)", final=f"select sensor, {sql.r6('m')} as max_abs_loading from ld order by m desc, sensor limit 25"))
def _(spark, sf):
    return ordering.strongest_sensors(_data_loadings(spark, sf)).withColumn("max_abs_loading", r6("max_abs_loading"))


# --- fitted gates ------------------------------------------------------------------------------

def gate_space(spark, sf):
    s = prep_plans._split(spark, sf)
    space = gates.fit_gate_space(s.where("split = 'train'"), sensor_columns(s))
    return s, space


@query("gate_matrix", with_(*BASE, ERA, prep_plans.TRAIN_CELLS, prep_plans.MEDIANS, prep_plans.FILLED, *prep_plans.RANKED, prep_plans.PRIORITY,
    "med2 as (select sensor, median(value) as center, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from tf group by sensor)",
    "dropped as materialized (select case when pa.place < pb.place then b else a end as sensor from rho join prio pa on pa.feature = a join prio pb on pb.feature = b where abs(r) > 0.99)",
    final=f"select raw_row_id, sensor, {sql.r6('greatest(least((value - center) / case when q3 = q1 then 1 else q3 - q1 end, 5), -5)')} as value from filled join med2 using (sensor) where sensor not in (select sensor from dropped)"))
def _(spark, sf):
    from ..operators.frame import melt

    s, space = gate_space(spark, sf)
    return melt(gates.gate_matrix(s, space), ["raw_row_id"], space.sensors).withColumn("value", r6("value"))


@query("pca_gate_fit")
def _(spark, sf):
    s, space = gate_space(spark, sf)
    m = gates.gate_matrix(s, space)
    g = gates.fit_pca_gate(gates.passing_reference(m), space.sensors)
    scored = gates.t2_q_score(m, g.sensors, g.mean, g.loadings, g.eigen)
    return gates.gate_flags(scored, {"t2": g.t2_ucl, "q": g.q_ucl}).select("raw_row_id", "split", "t2", "q", "t2_ooc", "q_ooc", "ooc")


@query("factor_gate_fit")
def _(spark, sf):
    s, space = gate_space(spark, sf)
    m = gates.gate_matrix(s, space)
    g = gates.fit_factor_gate(gates.passing_reference(m), space.sensors)
    scored = gates.factor_gate_score(m, g)
    return gates.gate_flags(scored, {"q": g.q_ucl}, {"density": g.density_lcl}).select("raw_row_id", "split", "density", "q", "ooc")
