"""Drift over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import drift, ordering, split
from ..sources import fixtures as fx
from . import gates as g
from . import sql
from .catalog import query
from .sql import CELLS, ERA, WAFER, with_

ALL_MED = "amed as (select sensor, median(value) as median from cells group by sensor)"
ERAS = """eras as (select raw_row_id, measurement_ts, row_number() over (order by measurement_ts, raw_row_id) as rn, count(*) over () as n from wafer)"""
EC = "ec as (select e.raw_row_id, e.measurement_ts, e.rn, e.n, e.rn <= round_even(e.n * 0.8, 0) as is_train, c.sensor, coalesce(c.value, a.median) as value from cells c join amed a using (sensor) join eras e using (raw_row_id))"
SHIFT = "sh as (select sensor, avg(value) filter (is_train) as m, stddev_pop(value) filter (is_train) as sd, (avg(value) filter (not is_train) - avg(value) filter (is_train)) / nullif(stddev_pop(value) filter (is_train), 0) as shift from ec group by sensor)"
DR = (WAFER, CELLS, ALL_MED, ERAS, EC, SHIFT)


def _drift(spark, sf):
    return drift.era_drift(fx.wafers(spark, sf), fx.SENSORS)


@query("era_drift", with_(*DR, final=f"select sensor, {sql.r6('shift')} as shift from sh where sd > 0"))
def _(spark, sf):
    return _drift(spark, sf).withColumn("shift", r6("shift"))


@query("era_drift_summary", with_(*DR, final=f"select count(*) as n_evaluated, count(*) filter (abs(shift) > 2) as n_drifted, {sql.r6('100 * avg((abs(shift) > 2)::int)')} as pct_drifted, {sql.r6('median(abs(shift))')} as median_abs_shift from sh where sd > 0"))
def _(spark, sf):
    s = drift.era_drift_summary(_drift(spark, sf))
    return s.withColumns({"pct_drifted": r6("pct_drifted"), "median_abs_shift": r6("median_abs_shift")})


@query("drift_heatmap", with_(*DR, "best as (select * from sh where sd > 0 order by abs(shift) desc, sensor limit 30)",
    "bins as (select raw_row_id, measurement_ts, rn, n, ntile(40) over (order by rn)::int as bin from eras)",
    "ends as (select bin, strftime(arg_max(measurement_ts, rn), '%Y-%m-%d') as bin_end, max(rn) as last_, max(n) as n from bins group by bin)",
    final=f"""select sensor, bin, {sql.r6('greatest(least((avg(value) - m) / sd, 4), -4)')} as z, bin_end, bin = (select min(bin) from ends where last_ > round_even(n * 0.8, 0)) as is_boundary
       from ec join best b using (sensor) join bins using (raw_row_id) join ends using (bin) group by sensor, bin, m, sd, bin_end"""))
def _(spark, sf):
    return drift.drift_heatmap(fx.wafers(spark, sf), fx.SENSORS).withColumn("z", r6("z"))


SPLITS = "tel as (select event_type, value, event_id >= (select count(*) * 0.7 from events) as h from events)"
ECDF = "ecdf as (select event_type, value, count(*) filter (not h) as a, count(*) filter (h) as b from tel group by 1, 2)"
CUM = "cum as (select *, sum(a) over w / (sum(a) over (partition by event_type))::double as fa, sum(b) over w / (sum(b) over (partition by event_type))::double as fb, sum(a) over (partition by event_type) as na, sum(b) over (partition by event_type) as nb from ecdf window w as (partition by event_type order by value rows unbounded preceding))"
KS = "ks as (select event_type, max(na)::bigint as n_reference, max(nb)::bigint as n_holdout, max(abs(fa - fb)) as d from cum group by 1)"


def _tel(spark, sf):
    e = fx.table(spark, sf, "events")
    n = e.count()
    return e.select("event_type", "value", (F.col("event_id") >= F.lit(n * 0.7)).alias("h"))


@query("ks_two_sample", with_(SPLITS, ECDF, CUM, KS, final=f"""select event_type, n_reference, n_holdout, {sql.r6('d')} as ks_distance,
    {sql.r6('case when sqrt(n_reference::double * n_holdout / (n_reference + n_holdout)) * d < 0.2 then 1 else greatest(least(2 * (select sum((case when j % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * j * j * n_reference::double * n_holdout / (n_reference + n_holdout) * d * d)) from generate_series(1, 100) s(j)), 1), 0) end')} as ks_pvalue from ks"""))
def _(spark, sf):
    out = drift.ks_two_sample(_tel(spark, sf), ["event_type"], "value", F.col("h"))
    return out.withColumns({"ks_distance": r6("ks_distance"), "ks_pvalue": r6("ks_pvalue")})


@query("separability_auc", with_(SPLITS, ECDF,
    "r as (select event_type, sum(b * (ca - a / cast(2 as double))) / (max(na)::double * max(nb)) as auc from (select *, sum(a) over (partition by event_type order by value rows unbounded preceding) as ca, sum(a) over (partition by event_type) as na, sum(b) over (partition by event_type) as nb from ecdf) group by 1)",
    final=f"select event_type, {sql.r6('greatest(auc, 1 - auc)')} as separability_auc from r"))
def _(spark, sf):
    return drift.separability_auc(_tel(spark, sf), ["event_type"], "value", F.col("h")).withColumn("separability_auc", r6("separability_auc"))


FZ = "fz as (select raw_row_id, k, case when k = 1 then z1 else z2 end as score, split = 'test' as h from z join era using (raw_row_id), (values (1), (2)) v(k))"


@query("factor_drift_ranking", with_(WAFER, CELLS, ERA, *g.FACTOR, FZ,
    "ec2 as (select k, score, count(*) filter (not h) as a, count(*) filter (h) as b from fz group by 1, 2)",
    "cm as (select k, sum(a) over w / (sum(a) over (partition by k))::double as fa, sum(b) over w / (sum(b) over (partition by k))::double as fb from ec2 window w as (partition by k order by score rows unbounded preceding))",
    "kd as (select k, max(abs(fa - fb)) as d from cm group by 1)",
    "ts as (select k, string_agg(sensor, ', ' order by abs(w) desc, sensor) as top_sensors from (select *, row_number() over (partition by k order by abs(w) desc, sensor) as r from load) where r <= 3 group by k)",
    final=f"select k, {sql.r6('d')} as ks_distance, {sql.r6('(select avg(score) filter (h) - avg(score) filter (not h) from fz where fz.k = kd.k)')} as mean_shift, top_sensors, row_number() over (order by d desc, k)::int as rank from kd join ts using (k)"))
def _(spark, sf):
    z = split.temporal_split(g._factor(spark, sf).select("raw_row_id", "measurement_ts", "z"))
    long = z.select((F.col("split") == "test").alias("h"), F.posexplode("z").alias("_i", "score")).withColumn("k", F.col("_i") + 1)
    top = ordering.top_loading_sensors(g.loadings_table(spark, g.W, g.GIVEN))
    out = drift.factor_drift_ranking(long, F.col("h"), top)
    return out.select("k", r6("ks_distance").alias("ks_distance"), r6("mean_shift").alias("mean_shift"), "top_sensors", "rank")


REF = "ref as (select sensor, count(value) as n, median(value) as median, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, stddev_pop(value) as sd, min(value) as low, max(value) as high from cells join era using (raw_row_id) where split = 'train' and era.target = 0 group by sensor)"
SPC = "spc as (select raw_row_id, sensor, case when n >= 5 then (value - median) / nullif(case when q3 > q1 then (q3 - q1) / cast(1.349 as double) else sd end, 0) end as z from cells join ref using (sensor))"


def _reference(spark, sf):
    s = split.temporal_split(fx.wafers(spark, sf))
    from ..operators.gates import passing_reference

    return s, passing_reference(s)


def spc_z(spark, sf, rows=None):
    s, ref = _reference(spark, sf)
    return drift.spc_robust_z(s if rows is None else rows, fx.SENSORS, drift.fit_spc(ref, fx.SENSORS), ["raw_row_id"])


@query("spc_robust_z", with_(WAFER, CELLS, ERA, REF, SPC, final=f"select raw_row_id, sensor, {sql.r6('z')} as spc_z from spc"))
def _(spark, sf):
    return spc_z(spark, sf).withColumn("spc_z", r6("spc_z"))


@query("spc_reference", with_(WAFER, CELLS, ERA, REF, final="select raw_row_id, sensor, " + ", ".join(f"{sql.r6(c)} as {c}" for c in ("value", "low", "q1", "median", "q3", "high")) + " from cells join ref using (sensor) join era using (raw_row_id) where split = 'test'"))
def _(spark, sf):
    s, ref = _reference(spark, sf)
    out = drift.spc_reference(s.where("split = 'test'"), ref, fx.SENSORS, ["raw_row_id"])
    return out.withColumns({c: r6(c) for c in ("value", "low", "q1", "median", "q3", "high")})


@query("drift_spikes", with_(*DR, ERA, REF, SPC,
    "hit as (select raw_row_id, sensor, z, shift from spc join sh using (sensor) join era using (raw_row_id) where split = 'test' and sd > 0 and abs(shift) > 0.3 and z is not null)",
    final=f"select * from (select raw_row_id, sensor, {sql.r6('z')} as robust_z, {sql.r6('shift')} as drift_shift, row_number() over (partition by raw_row_id order by abs(z) desc, sensor)::int as rank, count(*) filter (abs(z) > 2) over (partition by raw_row_id) as n_beyond_2 from hit) where rank <= 15"))
def _(spark, sf):
    s, ref = _reference(spark, sf)
    out = drift.drift_spikes(s.where("split = 'test'"), fx.SENSORS, drift.fit_spc(ref, fx.SENSORS), _drift(spark, sf), ["raw_row_id"], limit=0.3)
    return out.withColumns({"robust_z": r6("robust_z"), "drift_shift": r6("drift_shift")})
