"""Splits, folds, weights and bootstrap over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import metrics, profile, split
from ..sources import fixtures as fx
from . import sql
from .catalog import query
from .sql import ERA, WAFER, with_


@query("temporal_split", with_(WAFER, ERA, final="select raw_row_id, split from era"))
def _(spark, sf):
    return split.temporal_split(fx.wafers(spark, sf).select("raw_row_id", "measurement_ts")).select("raw_row_id", "split")


HASHED = """hashed as (select raw_row_id, target, row_number() over (partition by target order by md5('42:' || raw_row_id), raw_row_id) as rn,
   count(*) over (partition by target) as n from wafer)"""


@query("stratified_split", with_(WAFER, HASHED, final="select raw_row_id, target, case when rn <= round_even(0.2 * n, 0) then 'test' else 'train' end as split from hashed"))
def _(spark, sf):
    return split.stratified_split(fx.wafers(spark, sf).select("raw_row_id", "target"))


@query("stratified_split_events", """select event_id, target, case when rn <= round_even(0.2 * n, 0) then 'test' else 'train' end as split from (
   select event_id, target, row_number() over (partition by target order by md5('7:' || event_id), event_id) as rn, count(*) over (partition by target) as n
   from (select event_id, case when event_type = 'error' then 1 else 0 end as target from events))""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("target"))
    return split.stratified_split(e, seed=7, id_col="event_id")


@query("repeated_stratified_folds", with_(WAFER, final="""select raw_row_id, target, repeat, ((row_number() over (partition by repeat, target
    order by md5('42:' || repeat || ':' || raw_row_id), raw_row_id) - 1) % 5)::int as fold from wafer, (values (0), (1)) r(repeat)"""))
def _(spark, sf):
    return split.repeated_stratified_folds(fx.wafers(spark, sf).select("raw_row_id", "target"))


@query("time_decay_weights", with_(sql.TELEMETRY, "raw_ as (select id, exp(-2 * date_diff('microsecond', ts, max(ts) over ())::double / date_diff('microsecond', min(ts) over (), max(ts) over ())) as w from telemetry)",
    final=f"select id, {sql.r6('w / avg(w) over ()')} as weight from raw_"))
def _(spark, sf):
    out = split.time_decay_weights(fx.telemetry(spark, sf).select("id", "ts"), 2.0, "ts")
    return out.select("id", r6("weight").alias("weight"))


@query("class_balance_weights", with_(sql.TELEMETRY, final=f"select id, {sql.r6('count(*) over () / (2 * (count(*) over (partition by target))::double)')} as weight from telemetry"))
def _(spark, sf):
    out = split.class_balance_weights(fx.telemetry(spark, sf).select("id", "target"))
    return out.select("id", r6("weight").alias("weight"))


@query("positive_weights", with_(sql.TELEMETRY, "raw_ as (select id, case when target = 1 then 13.0 else 1.0 end as w from telemetry)", final=f"select id, {sql.r6('w / avg(w) over ()')} as weight from raw_"))
def _(spark, sf):
    out = split.positive_weights(fx.telemetry(spark, sf).select("id", "target"), 13.0)
    return out.select("id", r6("weight").alias("weight"))


@query("split_summary", with_(WAFER, ERA, final=f"""select split, count(*) as n_rows, {sql.r6('avg(target)')} as fail_rate, strftime(min(measurement_ts), '%Y-%m-%dT%H:%M:%S') as ts_min,
    strftime(max(measurement_ts), '%Y-%m-%dT%H:%M:%S') as ts_max from era group by split"""))
def _(spark, sf):
    w = fx.wafers(spark, sf).select("raw_row_id", "measurement_ts", "target")
    return profile.split_summary(split.temporal_split(w)).withColumn("fail_rate", r6("fail_rate"))


N_BOOT = 1000



@query("stratified_bootstrap", with_(sql.SCORES, "flagged as (select *, y_score >= 0.1 as hit from scores)", *sql.bootstrap("flagged", N_BOOT),
    final=f"select pipeline, {sql.intervals(('pr_auc', 'roc_auc', 'ber_percent'))} from per_draw group by pipeline"))
def _(spark, sf):
    out = metrics.bootstrap_metrics(fx.label_scores(spark, sf), ["pipeline"], 0.1, N_BOOT)
    return out.select("pipeline", *[r6(c).alias(c) for c in out.columns[1:]])
