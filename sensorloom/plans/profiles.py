"""Profile, mart, windows and exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CALENDAR
from ..functions.scalar import r6
from ..operators import mart, ordering, profile
from ..operators.frame import exact_quantiles
from ..sources import fixtures as fx
from . import sql
from .catalog import query
from .sql import CELLS, KEPT, PROFILE, WAFER, with_

# The first reason that applies, in this order.
REASONS = (("high_missing", "10 * n_null >= n_rows"), ("zero_variance", "coalesce(raw_variance, 0) = 0"), ("ok", "true"))
RULE = (
    "reasons(place, reason) as (values " + ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(REASONS)) + "),\n"
    "judged as (select p.column_name, arg_min(reason, place) as drop_reason from profile p, reasons where "
    + " or ".join(f"(place = {i} and {test})" for i, (_, test) in enumerate(REASONS))
    + " group by p.column_name),\n"
    "ruled as (select column_name, n_rows, n_null, missing_rate, n_distinct, coalesce(raw_variance, 0) as variance, n_null > 0 as has_missing, "
    "drop_reason = 'ok' as keep_in_mart, drop_reason, 'features' as source_relation from profile join judged using (column_name))"
)

# The kept sensors of the test shape follow from its null rule: every sensor with a 25 % gap and the
# constant one are dropped. The oracle computes them itself in `kept`.
KEPT_NAMES = [c for i, c in enumerate(fx.SENSORS) if i % 16 != 0 and i != 5]


@query("column_profile", with_(WAFER, CELLS, PROFILE, final=f"select column_name, n_rows, n_null, {sql.r6('missing_rate')} as missing_rate, n_distinct, {sql.r6('raw_variance')} as raw_variance from profile"))
def _(spark, sf):
    p = profile.column_profile(fx.wafers(spark, sf))
    return p.select("column_name", "n_rows", "n_null", r6("missing_rate").alias("missing_rate"), "n_distinct", r6("raw_variance").alias("raw_variance"))


WIDE = """cells as (select sensor, value from (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem)
   unpivot include nulls (value for sensor in (l_quantity, l_extendedprice, l_discount, l_tax)))"""


@query("column_profile_rows", with_(WIDE, PROFILE, final=f"select column_name, n_rows, n_null, {sql.r6('missing_rate')} as missing_rate, n_distinct, {sql.r6('raw_variance', 3)} as raw_variance from profile"))
def _(spark, sf):
    p = profile.column_profile(fx.wide_numbers(spark, sf), fx.WIDE_NUMBERS)
    return p.select("column_name", "n_rows", "n_null", r6("missing_rate").alias("missing_rate"), "n_distinct", r6("raw_variance", 3).alias("raw_variance"))


def _ruled(spark, sf):
    return profile.keep_drop_rule(profile.column_profile(fx.wafers(spark, sf))).drop("profiled_at")


@query("keep_drop_rule", with_(WAFER, CELLS, PROFILE, RULE, final=f"select * replace ({sql.r6('missing_rate')} as missing_rate, {sql.r6('variance')} as variance) from ruled"))
def _(spark, sf):
    return _ruled(spark, sf).withColumns({"missing_rate": r6("missing_rate"), "variance": r6("variance")})


@query("kept_with_missing", with_(WAFER, CELLS, PROFILE, RULE, final="select column_name from ruled where keep_in_mart and has_missing"))
def _(spark, sf):
    return profile.kept_with_missing(_ruled(spark, sf))


@query("project_kept", with_(WAFER, CELLS, PROFILE, KEPT, final="select raw_row_id, " + ", ".join(f"{sql.r6(c)} as {c}" for c in sorted(KEPT_NAMES)) + " from wafer where (select count(*) from kept) = " + str(len(KEPT_NAMES))))
def _(spark, sf):
    w = fx.wafers(spark, sf)
    kept = profile.kept_sensors(_ruled(spark, sf))
    return mart.project_kept(w, kept, ["raw_row_id"]).select("raw_row_id", *[r6(c).alias(c) for c in sorted(kept)])


PATTERN = """pattern as (
  select sensor, count(*) filter (value is null) as n_null,
     md5(count(*) filter (value is null) || ':'
       || coalesce(sum(('0x' || substr(md5(raw_row_id::varchar), 1, 15))::bigint) filter (value is null), 0) || ':'
       || coalesce(sum(('0x' || substr(md5(raw_row_id::varchar), 17, 15))::bigint) filter (value is null), 0)) as pattern_hash
  from cells group by sensor)"""


@query("null_pattern_hash", with_(WAFER, CELLS, PATTERN, final="select sensor, n_null, pattern_hash from pattern"))
def _(spark, sf):
    return profile.null_pattern_hash(fx.wafers(spark, sf), fx.SENSORS)


@query("null_pattern_classes", with_(WAFER, CELLS, """strings as (select sensor, string_agg(case when value is null then '1' else '0' end, '' order by measurement_ts, raw_row_id) as s from cells group by sensor)""", final="select min(sensor) as sensor, count(*) as n_sensors from strings group by s"))
def _(spark, sf):
    hashes = profile.null_pattern_hash(fx.wafers(spark, sf), fx.SENSORS)
    return profile.null_pattern_classes(hashes).drop("pattern_hash")


@query("missing_flags", with_(WAFER, final="select raw_row_id, " + ", ".join(f"case when {c} is null then 1 else 0 end as {c}__missing" for c in fx.SENSORS) + " from wafer"))
def _(spark, sf):
    return mart.missing_flags(fx.wafers(spark, sf), fx.SENSORS).select("raw_row_id", *[f"{c}__missing" for c in fx.SENSORS])


@query("n_missing_sensors", with_(WAFER, CELLS, PROFILE, KEPT, final="select raw_row_id, (count(*) - count(value))::int as n_missing_sensors from cells where sensor in (select sensor from kept) group by raw_row_id"))
def _(spark, sf):
    w = fx.wafers(spark, sf)
    return mart.n_missing_sensors(w, profile.kept_sensors(_ruled(spark, sf))).select("raw_row_id", "n_missing_sensors")


REPS = """reps as (select min(sensor) as sensor from (
    select sensor, string_agg(case when value is null then '1' else '0' end, '' order by measurement_ts, raw_row_id) as s
    from cells where sensor in (select sensor from kept where has_missing) group by sensor) group by s)"""


def _flag_names():
    """Representatives per null pattern under the shape's null rule (sensors i and i+1 of an even
    i share their rows unless one of them is complete)."""
    seen: dict[tuple, str] = {}
    for c in KEPT_NAMES:
        i = int(c[2:])
        m = fx.missing_modulus(i)
        if m:
            key = (m, (i // 2 * 26) % 100)
            seen[key] = min(seen.get(key, c), c)
    return sorted(seen.values())


def _past_z(rows: str, group: str) -> str:
    """Each value against the values of the 50 rows before it (`rows`: group, n, value), joined row by row."""
    return f"""past as (
      select a.{group}, a.n, any_value(a.value) as value, avg(b.value) as past_mean, stddev_samp(b.value) as past_sd
      from {rows} a left join {rows} b on b.{group} = a.{group} and b.n between a.n - 50 and a.n - 1 group by 1, 2),
    past_z as (select {group}, n, case when past_sd > 0 and value is not null then (value - past_mean) / past_sd else 0 end as z from past)"""


def _mart_sql(final_cols: str) -> str:
    rz = ", ".join(f"max(z) filter (sensor = '{c}') as {c}_rz" for c in KEPT_NAMES)
    cal = ", ".join(
        f"{f}(2 * pi() * {e} / cast({p} as double)) as {stem}_{f}"
        for e, stem, p in (("month(measurement_ts)", "month", 12), ("dayofweek(measurement_ts)", "dow", 7), ("hour(measurement_ts)", "hour", 24))
        for f in ("sin", "cos")
    )
    flags = ", ".join(f"({c} is null)::int as {c}__missing" for c in _flag_names())
    n_missing = " + ".join(f"({c} is null)::int" for c in KEPT_NAMES)
    return with_(
        WAFER,
        CELLS,
        "numbers as (select raw_row_id, row_number() over (order by measurement_ts, raw_row_id) as n from wafer)",
        "placed as (select n, sensor, value from cells join numbers using (raw_row_id))",
        _past_z("placed", "sensor"),
        f"wide_z as (select n, {rz} from past_z group by n)",
        f"""mart as (select n as observation_id, measurement_ts, target, (dayofweek(measurement_ts) in (0, 6))::int as is_weekend, {cal},
           {', '.join(KEPT_NAMES)}, {', '.join(f'{c}_rz' for c in KEPT_NAMES)}, {flags}, ({n_missing})::int as n_missing_sensors
           from wafer join numbers using (raw_row_id) join wide_z using (n))""",
        final=f"select {final_cols} from mart",
    )


FLOATS = [*CALENDAR[1:], *KEPT_NAMES, *[f"{c}_rz" for c in KEPT_NAMES]]
KEYS = ["observation_id", "measurement_ts", "target", "is_weekend", *[f"{c}__missing" for c in _flag_names()], "n_missing_sensors"]


@query("feature_mart", _mart_sql(", ".join([*KEYS, *[f"{sql.r6(c)} as {c}" for c in FLOATS]])))
def feature_mart(spark, sf):
    m = mart.build_mart(fx.wafers(spark, sf))
    floats = [c for c, t in m.dtypes if t == "double"]
    return m.withColumns({c: r6(c) for c in floats})


@query("rolling_z", with_(sql.TELEMETRY, "ordered as (select *, row_number() over (partition by tool order by ts, id) as n from telemetry)", _past_z("ordered", "tool"),
    final=f"select id, tool, {sql.r6('z')} as value_rz from ordered join past_z using (tool, n)"))
def _(spark, sf):
    z = mart.rolling_z_by(fx.telemetry(spark, sf), "tool", ["ts", "id"], "value")
    return z.select("id", "tool", r6("value_rz").alias("value_rz"))


@query("observation_id", with_(sql.TELEMETRY, final="select id, row_number() over (order by ts, id) as observation_id from telemetry"))
def _(spark, sf):
    t = fx.telemetry(spark, sf).withColumnsRenamed({"ts": "measurement_ts", "id": "raw_row_id"})
    return mart.observation_ids(t.select("raw_row_id", "measurement_ts")).select(F.col("raw_row_id").alias("id"), "observation_id")


@query("first_per_group", "select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts, event_id) as rn from events) where rn = 1")
def _(spark, sf):
    return ordering.first_per_group(fx.table(spark, sf, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "ts")


@query("rolling_ooc_rate", with_("""flags as (select event_id as id, ts, case when value > 150 then 1 else 0 end as ooc,
    row_number() over (order by ts, event_id) as rn, greatest(20, count(*) over () // 10) as w from events)""",
    """cum as (select *, sum(ooc) over (order by rn) as c from flags)""",
    final=f"""select a.id, {sql.r6('(a.c - coalesce(b.c, 0))::double / least(a.rn, a.w)')} as rolling_rate, {sql.r6('a.c::double / a.rn')} as cumulative_rate
       from cum a left join cum b on b.rn = a.rn - a.w"""))
def _(spark, sf):
    flags = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", (F.col("value") > 150).cast("int").alias("ooc"))
    out = ordering.ooc_rates(flags, ["ts", "id"], "ooc")
    return out.select("id", r6("rolling_rate").alias("rolling_rate"), r6("cumulative_rate").alias("cumulative_rate"))


@query("cumulative_ooc_rate", with_(sql.TELEMETRY, final=f"select id, tool, {sql.r6('avg(target) over (partition by tool order by ts, id rows unbounded preceding)')} as cumulative_rate from telemetry"))
def _(spark, sf):
    out = ordering.cumulative_rate(fx.telemetry(spark, sf), ["tool"], ["ts", "id"], "target")
    return out.select("id", "tool", r6("cumulative_rate").alias("cumulative_rate"))


@query("equal_count_bins", "select event_id, ntile(40) over (order by ts, event_id)::int as bin from events")
def _(spark, sf):
    return ordering.equal_count_bins(fx.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 40).select("event_id", "bin")


# --- exploratory aggregates ------------------------------------------------------------------


@query("snapshot_stats", with_(WAFER, CELLS, "rates as (select sensor, avg(case when value is null then 1.0 else 0.0 end) as rate from cells group by sensor)",
    final=f"""select count(*) as n_obs, count(*) filter (target = 0) as n_pass, count(*) filter (target = 1) as n_fail, {sql.r6('avg(target)')} as fail_rate,
      strftime(min(measurement_ts), '%Y-%m-%d') as date_min, strftime(max(measurement_ts), '%Y-%m-%d') as date_max, 64 as n_sensors,
      (select {sql.r6('100 * avg(rate)')} from rates) as missing_cell_pct, (select {sql.r6('100 * avg(case when rate > 0.5 then 1.0 else 0.0 end)')} from rates) as high_miss_sensor_pct from wafer"""))
def _(spark, sf):
    s = profile.snapshot_stats(fx.wafers(spark, sf))
    return s.withColumns({c: r6(c) for c in ("fail_rate", "missing_cell_pct", "high_miss_sensor_pct")})


@query("class_counts", with_(WAFER, final="select case when target = 1 then 'fail' else 'pass' end as class, count(*) as n from wafer group by 1"))
def _(spark, sf):
    return profile.class_counts(fx.wafers(spark, sf))


@query("weekly_fail_rate", with_(
    """rows_ as (select o_orderdate as ts, case when o_orderstatus = 'F' then 1 else 0 end as target from orders)""",
    """weeks as (select (date_trunc('week', ts) + interval 6 day)::date as week_end, avg(target) as fail_rate, count(*) as n from rows_ group by 1)""",
    """cal as (select unnest(generate_series((select min(week_end) from weeks)::timestamp, (select max(week_end) from weeks)::timestamp, interval 7 day))::date as week_end)""",
    final=f"select cal.week_end, {sql.r6('fail_rate')} as fail_rate, coalesce(n, 0) as n, (select {sql.r6('avg(target)')} from rows_) as baseline from cal left join weeks using (week_end)"))
def _(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("measurement_ts"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target")
    )
    out = profile.weekly_fail_rate(rows)
    return out.withColumns({"fail_rate": r6("fail_rate"), "baseline": r6("baseline")})


RATES = "rates as (select sensor, avg(case when value is null then 1.0 else 0.0 end) as missing_rate from cells group by sensor)"


@query("missing_rate", with_(WAFER, CELLS, RATES, final=f"select sensor, {sql.r6('missing_rate')} as missing_rate from rates"))
def _(spark, sf):
    return profile.missing_rate(fx.wafers(spark, sf)).withColumn("missing_rate", r6("missing_rate"))


@query("missing_matrix", with_(WAFER, CELLS, final="""select row_number() over (partition by sensor order by measurement_ts, raw_row_id) - 1 as row_index, sensor, case when value is null then 1 else 0 end as is_missing
    from cells where cast(substr(sensor, 3) as int) % 10 = 0"""))
def _(spark, sf):
    return profile.missing_matrix(fx.wafers(spark, sf))


@query("missing_rate_hist", with_(WAFER, CELLS, RATES,
    "pct as (select missing_rate * 100 as pct, round_even(missing_rate * 100, 1) as r from rates where missing_rate > 0)",
    "mode as (select r, count(*) as c from pct group by r order by c desc, r limit 1)",
    "kept as (select pct from pct, mode where not (pct.r = mode.r and (mode.c >= 100 or mode.c >= 0.15 * (select count(*) from rates))))",
    "span as (select min(pct) as lo, max(pct) as hi from kept)",
    final=f"select case when hi > lo then least(floor((pct - lo) / ((hi - lo) / 20)), 19)::int else 0 end as bin, count(*) as n, {sql.r6('min(pct)')} as min_pct, {sql.r6('max(pct)')} as max_pct from kept, span group by 1"))
def _(spark, sf):
    out = profile.missing_rate_hist(profile.missing_rate(fx.wafers(spark, sf)))
    return out.withColumns({"min_pct": r6("min_pct"), "max_pct": r6("max_pct")})


@query("variance_ranking", with_(WAFER, CELLS, final=f"select sensor, {sql.r6('var_samp(value)')} as variance, row_number() over (order by var_samp(value) desc nulls last, sensor)::int as rank from cells group by sensor"))
def _(spark, sf):
    return profile.variance_ranking(fx.wafers(spark, sf)).withColumn("variance", r6("variance")).drop("mean")


@query("sensor_histogram", with_(WAFER, "span as (select min(c_13) as lo, max(c_13) as hi from wafer)",
    final="select target, least(floor((c_13 - lo) / ((hi - lo) / 40)), 39)::int as bin, count(*) as n from wafer, span where c_13 is not null group by 1, 2"))
def _(spark, sf):
    return profile.sensor_histogram(fx.wafers(spark, sf), "c_13", 40)


CORR = (
    "ranked as (select sensor, row_number() over (order by var_samp(value) desc nulls last, sensor) as rk from cells group by sensor having var_samp(value) > 0)",
    "top_ as (select c.raw_row_id, c.sensor, c.value, r.rk from cells c join ranked r using (sensor) where rk <= 36)",
    """pairs as (select a.sensor as a, b.sensor as b, count(*) filter (a.value is not null and b.value is not null) as n, corr(a.value, b.value) as raw_r
       from top_ a join top_ b on a.raw_row_id = b.raw_row_id and a.rk < b.rk group by 1, 2)""",
    "rated as (select a, b, n, case when n < 100 or raw_r is null then 0 else raw_r end as r from pairs)",
)


@query("sensor_correlation", with_(WAFER, CELLS, *CORR, final=f"select a, b, n, {sql.r6('r')} as r from rated"))
def _(spark, sf):
    return profile.sensor_correlation(fx.wafers(spark, sf)).withColumn("r", r6("r"))


@query("sensor_correlation_order", with_(WAFER, CELLS, *CORR, "ends as (select a as sensor, abs(r) as r from rated union all select b, abs(r) from rated)",
    final=f"select sensor, {sql.r6('(sum(r) + 1) / (count(*) + 1)')} as mean_abs_r, {sql.r6('max(r)')} as max_abs_r from ends group by sensor"))
def _(spark, sf):
    out = profile.correlation_order(profile.sensor_correlation(fx.wafers(spark, sf)))
    return out.withColumns({"mean_abs_r": r6("mean_abs_r"), "max_abs_r": r6("max_abs_r")})


@query("sensor_correlation_summary", with_(WAFER, CELLS, *CORR, final=f"select count(*) as n_pairs, count(*) filter (abs(r) >= 0.9) as n_high, {sql.r6('max(abs(r))')} as max_abs_r, max_by(a || '~' || b, abs(r)) as max_pair from rated"))
def _(spark, sf):
    out = profile.correlation_summary(profile.sensor_correlation(fx.wafers(spark, sf)))
    return out.withColumn("max_abs_r", r6("max_abs_r"))


@query("quantiles", f"""select event_type, {sql.r6('quantile_cont(value, 0.25)')} as q25, {sql.r6('median(value)')} as q50, {sql.r6('quantile_cont(value, 0.97)')} as q97 from events group by 1""")
def _(spark, sf):
    q = exact_quantiles(fx.table(spark, sf, "events"), ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q97": 0.97})
    return q.select("event_type", *[r6(c).alias(c) for c in ("q25", "q50", "q97")])


@query("union_all", with_(WAFER, final="select 'c_1' as sensor, c_1 as value from wafer union all select 'c_2', c_2 from wafer"))
def _(spark, sf):
    from ..operators.frame import melt

    return melt(fx.wafers(spark, sf).select("c_1", "c_2"), [], ["c_1", "c_2"])
