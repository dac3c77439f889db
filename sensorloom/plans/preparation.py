"""Feature preparation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sensor_columns
from ..functions.scalar import r6
from ..operators import models, ordering, prep, profile, reporting, split
from ..session import spool
from ..sources import fixtures as fx
from . import sql
from .catalog import query
from .sql import CELLS, ERA, KEPT, PROFILE, WAFER, with_

def kept(spark, sf):
    """Sensors that the keep rule leaves, in their order."""
    rule = profile.keep_drop_rule(profile.column_profile(fx.wafers(spark, sf)))
    stay = {r[0] for r in rule.where("keep_in_mart").select("column_name").collect()}
    return [c for c in fx.SENSORS if c in stay]


def _split(spark, sf):
    """Split table of the kept sensors, written once: the fits below read it many times."""
    return spool(split.temporal_split(fx.wafers(spark, sf).select("raw_row_id", "measurement_ts", "target", *kept(spark, sf))))


TRAIN_CELLS = f"{PROFILE},\n{KEPT},\nfitcells as (select c.* from cells c join era e using (raw_row_id) where e.split = 'train' and sensor in (select sensor from kept))"
MEDIANS = "med as (select sensor, median(value) as median, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from fitcells group by sensor)"
FILLED = "filled as (select c.raw_row_id, c.measurement_ts, c.target, c.sensor, coalesce(c.value, m.median) as value from cells c join med m using (sensor))"


def _imputed(spark, sf):
    s = _split(spark, sf)
    names = sensor_columns(s)
    return prep.median_impute(s, names, prep.fit_median(s.where("split = 'train'"), names))


@query("median_impute", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, final=f"select raw_row_id, sensor, {sql.r6('value')} as value from filled"))
def _(spark, sf):
    from ..operators.frame import melt

    x = _imputed(spark, sf)
    return melt(x, ["raw_row_id"], sensor_columns(x)).withColumn("value", r6("value"))


@query("median_fit_rows", """select c as sensor, round(median(v), 6) as median from (unpivot (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on * into name c value v) group by c""")
def _(spark, sf):
    return prep.fit_median(fx.wide_numbers(spark, sf), fx.WIDE_NUMBERS).withColumn("median", r6("median"))


@query("drop_constant", with_(WAFER, CELLS, final="select sensor from cells group by sensor having min(value) <> max(value)"))
def _(spark, sf):
    return prep.varying_sensors(fx.wafers(spark, sf), fx.SENSORS)


@query("rank_transform", with_(WAFER, CELLS, final="""select raw_row_id, sensor, case when value is not null then
     (rank() over (partition by sensor order by value) + (count(*) over (partition by sensor, value) - 1) / cast(2 as double)) end as rank from cells where value is not null
     union all select raw_row_id, sensor, null from cells where value is null"""))
def _(spark, sf):
    return prep.rank_transform(fx.wafers(spark, sf), fx.SENSORS).select("raw_row_id", "sensor", "rank")


TRAIN_FILLED = "tf as materialized (select f.raw_row_id, f.sensor, f.value, f.target from filled f join era e using (raw_row_id) where e.split = 'train')"
MED2 = "med2 as (select sensor, median(value) as center, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from tf group by sensor)"
RANKED = (
    TRAIN_FILLED,
    "rk as materialized (select raw_row_id, sensor, target, rank() over (partition by sensor order by value) + (count(*) over (partition by sensor, value) - 1) / cast(2 as double) as r from tf)",
    "rho as materialized (select a.sensor as a, b.sensor as b, corr(a.r, b.r) as r from rk a join rk b on a.raw_row_id = b.raw_row_id and a.sensor < b.sensor group by 1, 2)",
)


def _train(spark, sf):
    return _imputed(spark, sf).where("split = 'train'")


@query("spearman_edges", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, *RANKED, final=f"select a, b, {sql.r6('r')} as r from rho where abs(r) > 0.12"))
def _(spark, sf):
    t = _train(spark, sf)
    return prep.spearman_edges(t, sensor_columns(t), 0.12).withColumn("r", r6("r"))


PRIORITY = "prio as materialized (select sensor as feature, row_number() over (order by round(abs(coalesce(corr(value, target), 0)), 12) desc, sensor) as place from tf group by sensor)"


@query("target_priority", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, *RANKED, PRIORITY, final="select feature, place::int as place from prio"))
def _(spark, sf):
    t = _train(spark, sf)
    return prep.target_priority(t, sensor_columns(t))


def _pruned(spark, sf, threshold=0.12):
    t = _train(spark, sf)
    names = sensor_columns(t)
    return prep.corr_prune(prep.spearman_edges(t, names, threshold), prep.target_priority(t, names))


# a recursive walk over the places decides one feature at a time, as the definition does
@query("corr_prune", "with recursive " + with_(
    WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, *RANKED, PRIORITY,
    "edge as (select a, b from rho where abs(r) > 0.12 union all select b, a from rho where abs(r) > 0.12)",
    """walk(place, kept) as (
        select 0::bigint, []::varchar[]
        union all
        select w.place + 1, case when exists (select 1 from edge e where e.a = p.feature and list_contains(w.kept, e.b)) then w.kept else list_append(w.kept, p.feature) end
        from walk w join prio p on p.place = w.place + 1)""",
    "final_ as (select unnest(kept) as feature from walk where place = (select max(place) from prio))",
    final="""select p.feature, case when f.feature is not null then p.feature else (select arg_min(q.feature, q.place) from edge e join final_ k on k.feature = e.b join prio q on q.feature = e.b where e.a = p.feature) end as leader, f.feature is not null as kept
        from prio p left join final_ f using (feature)""",
)[len("with "):])
def _(spark, sf):
    return _pruned(spark, sf)


@query("correlation_example")
def _(spark, sf):
    return prep.correlation_example(_train(spark, sf), _pruned(spark, sf)).withColumn("r", r6("r"))


@query("robust_scale", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, TRAIN_FILLED, MED2, final=f"select raw_row_id, sensor, {sql.r6('(value - center) / case when q3 = q1 then 1 else q3 - q1 end')} as value from filled join med2 using (sensor)"))
def _(spark, sf):
    from ..operators.frame import melt

    x = _imputed(spark, sf)
    names = sensor_columns(x)
    fitted = prep.fit_robust(x.where("split = 'train'"), names)
    return melt(prep.robust_scale(x, fitted), ["raw_row_id"], names).withColumn("value", r6("value"))


@query("scale_clip", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, TRAIN_FILLED, MED2, final=f"select raw_row_id, sensor, {sql.r6('greatest(least((value - center) / case when q3 = q1 then 1 else q3 - q1 end, 1.5), -1.5)')} as value from filled join med2 using (sensor)"))
def _(spark, sf):
    from ..operators.frame import melt

    x = _imputed(spark, sf)
    names = sensor_columns(x)
    fitted = prep.fit_robust(x.where("split = 'train'"), names)
    return melt(prep.robust_scale(x, fitted, 1.5), ["raw_row_id"], names).withColumn("value", r6("value"))


HUBS = 5


@query("hub_pairs", with_(WAFER, CELLS, ERA, TRAIN_CELLS, MEDIANS, FILLED, TRAIN_FILLED, PRIORITY, f"hubs as (select * from prio where place <= {HUBS})",
    final=f"""select x.raw_row_id, 'interact_' || a.feature || '__' || b.feature as sensor, {sql.r6('x.value * y.value')} as value
    from hubs a join hubs b on a.place < b.place join filled x on x.sensor = a.feature join filled y on y.sensor = b.feature and y.raw_row_id = x.raw_row_id"""))
def _(spark, sf):
    from ..operators.frame import melt

    x = _imputed(spark, sf)
    ranked = prep.target_priority(x.where("split = 'train'"), sensor_columns(x))
    hubs = [r[0] for r in ranked.where(F.col("place") <= HUBS).orderBy("place").select("feature").collect()]
    out = prep.hub_pairs(x, hubs)
    return melt(out, ["raw_row_id"], [c for c in out.columns if c.startswith("interact_")]).withColumn("value", r6("value"))


T2_NAMES = ["c_1", "c_2", "c_3"]


def _t2_input(spark, sf):
    return fx.wafers(spark, sf).select("raw_row_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in T2_NAMES])


def _t2_sql():
    """3 x 3 inverse by cofactors over population covariances."""
    m = "m as (select " + ", ".join(f"avg({a}) as m_{a}" for a in T2_NAMES) + ", " + ", ".join(f"covar_pop({a}, {b}) as s_{i}{j}" for i, a in enumerate(T2_NAMES) for j, b in enumerate(T2_NAMES)) + " from x)"

    def cof(i, j):
        r = [k for k in range(3) if k != i]
        c = [k for k in range(3) if k != j]
        sign = "-" if (i + j) % 2 else ""
        return f"{sign}(s_{r[0]}{c[0]} * s_{r[1]}{c[1]} - s_{r[0]}{c[1]} * s_{r[1]}{c[0]})"

    det = " + ".join(f"s_0{j} * {cof(0, j)}" for j in range(3))
    quad = " + ".join(f"({a} - m_{a}) * ({b} - m_{b}) * {cof(i, j)}" for i, a in enumerate(T2_NAMES) for j, b in enumerate(T2_NAMES))
    return with_(WAFER, "x as (select raw_row_id, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in T2_NAMES) + " from wafer)", m,
                 final=f"select raw_row_id, {sql.r6(f'({quad}) / ({det})')} as hotelling_t2 from x, m")


@query("hotelling_t2_empirical", _t2_sql())
def _(spark, sf):
    x = _t2_input(spark, sf)
    return prep.hotelling_t2(x, prep.fit_hotelling(x, T2_NAMES, shrink=False)).select("raw_row_id", r6("hotelling_t2").alias("hotelling_t2"))


@query("hotelling_t2")
def _(spark, sf):
    x = _imputed(spark, sf)
    return prep.hotelling_t2(x, prep.fit_hotelling(x.where("split = 'train'"), sensor_columns(x))).select("raw_row_id", "hotelling_t2")


@query("rf_top_k")
def _(spark, sf):
    t = split.class_balance_weights(_train(spark, sf))
    return prep.rf_top_k(t, sensor_columns(t), 30, weight="weight", trees=models.TREES)


@query("dependence_top_k")
def _(spark, sf):
    t = _train(spark, sf)
    return prep.dependence_top_k(t, sensor_columns(t), 20)


def _pls(spark, sf):
    x = _imputed(spark, sf)
    return prep.pls_scores(x, prep.fit_pls(x.where("split = 'train'"), sensor_columns(x), 3))


@query("pls_scores")
def _(spark, sf):
    return _pls(spark, sf).select("raw_row_id", "pls_0", "pls_1", "pls_2")


@query("pls_score_scatter")
def _(spark, sf):
    return prep.pls_score_scatter(_pls(spark, sf))


# --- selections and funnels --------------------------------------------------------------------

VARS = "vr as (select sensor as feature, row_number() over (order by var_samp(value) desc nulls last, sensor) as rank from cells group by sensor)"
MISS = "ms as (select sensor as feature, row_number() over (order by avg(value) desc nulls last, sensor) as rank from cells group by sensor)"


def _two_rankings(spark, sf):
    from ..operators.frame import sensor_stats
    from pyspark.sql import Window

    w = fx.wafers(spark, sf)
    first = profile.variance_ranking(w).select(F.col("sensor").alias("feature"), "rank").where("rank <= 30")
    mean = sensor_stats(w, fx.SENSORS, {"m": F.avg})
    second = mean.select(F.col("sensor").alias("feature"), F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "sensor")).alias("rank")).where("rank <= 30")
    return first, second


@query("selection_agreement", with_(WAFER, CELLS, VARS, MISS, final="""select v.feature, v.rank::int as rank, (select feature from vr where rank = 1) as top_first, (select feature from ms where rank = 1) as top_second
    from vr v where v.rank <= 30 and v.feature in (select feature from ms where rank <= 30)"""))
def _(spark, sf):
    return reporting.selection_agreement(*_two_rankings(spark, sf))


@query("selection_rank", with_(WAFER, CELLS, VARS, final="select feature || case when rank % 2 = 0 then '_rz' else '' end as feature, (31 - rank)::int as strength, case when rank % 2 = 0 then 'rolling_z' else 'raw' end as view from vr where rank <= 30"))
def _(spark, sf):
    first, _ = _two_rankings(spark, sf)
    named = F.when(F.col("rank") % 2 == 0, F.concat("feature", F.lit("_rz"))).otherwise(F.col("feature"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("rank", named.alias("f")))).alias("l"))  # 30 names
    return ordering.selection_rank(listed.select(F.transform("l", lambda s: s["f"]).alias("features")))


@query("stage_counts", with_(WAFER, CELLS, final="""select 0 as stage_no, 'staged' as stage, count(distinct sensor) as n_features, 0::bigint as dropped from cells
    union all select 1, 'kept', count(*), 64 - count(*) from (select sensor from cells group by sensor having avg((value is null)::int) < 0.1 and var_pop(value) > 0)
    union all select 2, 'with_rolling', 2 * count(*), count(*) - 2 * count(*) from (select sensor from cells group by sensor having avg((value is null)::int) < 0.1 and var_pop(value) > 0)"""))
def _(spark, sf):
    return reporting.stage_counts(_stages(spark, sf))


def _stages(spark, sf):
    p = profile.keep_drop_rule(profile.column_profile(fx.wafers(spark, sf))).select("column_name", "keep_in_mart")
    kept = p.where("keep_in_mart")
    twins = F.explode(F.array("column_name", F.concat("column_name", F.lit("_rz"))))
    return (
        p.select(F.lit(0).alias("stage_no"), F.lit("staged").alias("stage"), F.col("column_name").alias("feature"))
        .union(kept.select(F.lit(1), F.lit("kept"), "column_name"))
        .union(kept.select(F.lit(2), F.lit("with_rolling"), twins))
    )


@query("survivor_range", with_(WAFER, CELLS, "k as (select sensor from cells group by sensor having avg((value is null)::int) < 0.1 and var_pop(value) > 0)", final="select least(64, count(*)) as min_features, 2 * count(*) as max_features from k"))
def _(spark, sf):
    return reporting.survivor_range(reporting.stage_counts(_stages(spark, sf)))
