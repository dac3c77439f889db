"""Sources, projections, checks and scalar functions over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as cols
from ..functions.scalar import clip, logistic, r6, try_timestamp
from ..operators import checks, mart
from ..session import spool_root
from ..sources import fixtures as fx
from ..sources import tables, text
from . import sql
from .catalog import query
from .sql import WAFER, with_

LINES = """lines as (
  select o_orderkey, unnest(case when o_orderkey % 10 = 0 then [line, '   ', '-1'] else [line] end) as value
  from (select o_orderkey, (case when o_orderstatus = 'F' then '1' else '-1' end) || ' "'
               || strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') || '"' as line from orders))"""

NUMBERS = """numbers as (
  select l_orderkey, l_linenumber, l_quantity as c_0,
         case when l_linenumber = 3 then null else l_extendedprice end as c_1,
         case when l_suppkey % 11 = 0 then null else l_discount end as c_2
  from lineitem)"""


@query(
    "parse_label_lines",
    with_(LINES, final="""select o_orderkey, case when regexp_extract(value, '^\\s*(\\S+)\\s', 1) = '-1' then 0 else 1 end as target,
      replace(trim(regexp_extract(value, '^\\s*\\S+\\s+(.*)$', 1)), '"', '') as "timestamp"
    from lines where regexp_matches(value, '^\\s*\\S+\\s+\\S')"""),
)
def _(spark, sf):
    return text.parse_label_lines(fx.label_lines(spark, sf))


@query("parse_sensor_lines", with_(NUMBERS, final=f"select l_orderkey, l_linenumber, {sql.r6('c_0')} as c_0, {sql.r6('c_1')} as c_1, {sql.r6('c_2')} as c_2 from numbers"))
def _(spark, sf):
    parsed = text.parse_sensor_lines(fx.sensor_lines(spark, sf), 3)
    return parsed.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in ("c_0", "c_1", "c_2")])


@query("zip_by_row", """select row_number() over (order by event_id) - 1 as raw_row_id, event_type as kind, ts as stamp from events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    a = e.select(F.col("event_id").alias("pos"), F.col("event_type").alias("kind"))
    b = e.select(F.col("event_id").alias("pos"), F.col("ts").alias("stamp"))
    return text.zip_by_row(a, b, "pos")


def _seed(spark, sf):
    lines = text.parse_label_lines(fx.label_lines(spark, sf))
    return lines.select(F.col("o_orderkey").alias("raw_row_id"), "target", "timestamp")


@query("write_seed", with_(LINES, final="""select o_orderkey as raw_row_id, case when value like '-1 %' then 0 else 1 end as target,
    replace(substr(value, strpos(value, ' ') + 1), '"', '') as "timestamp" from lines where value like '%"%'"""))
def _(spark, sf):
    path = f"{spool_root(spark)}/seed-{uuid.uuid4().hex}"
    text.write_seed(_seed(spark, sf), path)
    return tables.scan_table(spark, path)


@query("scan_table", "select event_id, ts, user_id, event_type, value, props from events")
def _(spark, sf):
    return tables.scan_table(spark, f"{sf}/events.parquet")


@query("materialise", with_(WAFER, final="select target, count(*) as n from wafer group by target"))
def _(spark, sf):
    view = tables.materialise(fx.wafers(spark, sf), "staging_wafers", "view")
    stored = tables.materialise(view, "stored_wafers", "table", f"{spool_root(spark)}/wafers-{uuid.uuid4().hex}")
    return stored.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("export_results", """select '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","missing":null}' as record from events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("missing"))
    path = f"{spool_root(spark)}/records-{uuid.uuid4().hex}"
    text.export_results(text.as_json_records(e), path, "text")
    return spark.read.text(path).withColumnRenamed("value", "record")


@query("sensor_columns", with_(WAFER, final="select count(*) as n_rows, " + ", ".join(f"count({c}) as {c}" for c in fx.SENSORS) + " from wafer"))
def _(spark, sf):
    w = fx.wafers(spark, sf)
    return w.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in cols.sensor_columns(w)])


@query("columns_except", "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(cols.columns_except(o, ["o_totalprice", "o_orderdate"]))


@query("select_except", "select * exclude (o_totalprice) from orders")
def _(spark, sf):
    return cols.select_except(fx.table(spark, sf, "orders"), ["o_totalprice"])


@query("numeric_feature_columns", "select l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(cols.numeric_feature_columns(li, ("l_orderkey",)))


@query(
    "branch_columns",
    with_(
        WAFER,
        final="select 'sensor' as branch, 64 as n_columns, count(*) as n_rows from wafer union all select 'n_missing', 1, count(*) from wafer "
        f"union all select 'calendar', 7, count(*) from wafer union all select 'missing_flag', {len(fx.SENSORS)}, count(*) from wafer",
    ),
)
def _(spark, sf):
    w = mart.cyclical_encoding(mart.calendar_features(fx.wafers(spark, sf)))
    w = mart.n_missing_sensors(mart.missing_flags(w, fx.SENSORS), fx.SENSORS)
    branches = cols.branch_columns(w)
    rows = F.array(*[F.struct(F.lit(b).alias("branch"), F.lit(len(c)).alias("n_columns")) for b, c in branches.items()])
    return w.select(F.inline(rows)).groupBy("branch", "n_columns").agg(F.count(F.lit(1)).alias("n_rows"))


@query("require_columns", with_(WAFER, final=f"select raw_row_id, {', '.join(fx.SENSORS)} from wafer"))
def _(spark, sf):
    w = fx.wafers(spark, sf)
    names = cols.require_columns(cols.sensor_columns(w), "sensor columns")
    return w.select("raw_row_id", *names)


@query("preview_slice", with_(WAFER, final="select raw_row_id, target, c_0, c_1, c_2, c_3 from wafer where target = 1 order by raw_row_id limit 12"))
def _(spark, sf):
    return mart_preview(fx.wafers(spark, sf), n_cols=4, label=1, k=12)


def mart_preview(df, n_cols: int, label: int | None, k: int):
    """First k rows by id of one class, first n sensors: a top-k, not a collect."""
    rows = df if label is None else df.where(F.col("target") == label)
    return rows.select("raw_row_id", "target", *cols.sensor_columns(df)[:n_cols]).orderBy("raw_row_id").limit(k)


# --- scalar functions ------------------------------------------------------------------------


@query("parse_timestamp", with_(LINES, final="""select o_orderkey, case when value like '-1 %' then 0 else 1 end as target,
    strptime(replace(substr(value, strpos(value, ' ') + 1), '"', ''), '%d/%m/%Y %H:%M:%S') as measurement_ts from lines where value like '%"%'"""))
def _(spark, sf):
    seed = text.parse_label_lines(fx.label_lines(spark, sf))
    return mart.parse_timestamp(seed)


@query("try_timestamp", with_(LINES, final="""select o_orderkey, try_strptime(case when o_orderkey % 3 = 0 then 'x' || replace(substr(value, strpos(value, ' ') + 1), '"', '')
     else replace(substr(value, strpos(value, ' ') + 1), '"', '') end, '%d/%m/%Y %H:%M:%S') as measurement_ts from lines where value like '%"%'"""))
def _(spark, sf):
    seed = text.parse_label_lines(fx.label_lines(spark, sf))
    bad = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "timestamp")).otherwise(F.col("timestamp"))
    return seed.select("o_orderkey", try_timestamp(bad).alias("measurement_ts"))


CALENDAR = """cal as (select id, ts, month(ts) as month, dayofweek(ts) as day_of_week, hour(ts) as hour,
   case when dayofweek(ts) in (0, 6) then 1 else 0 end as is_weekend from telemetry)"""


def _telemetry_calendar(spark, sf):
    return mart.calendar_features(fx.telemetry(spark, sf).select("id", F.col("ts").alias("measurement_ts")))


@query("calendar_features", with_(sql.TELEMETRY, CALENDAR, final="select id, ts as measurement_ts, month::int as month, day_of_week::int as day_of_week, hour::int as hour, is_weekend from cal"))
def _(spark, sf):
    return _telemetry_calendar(spark, sf)


@query(
    "cyclical_encoding",
    with_(
        sql.TELEMETRY,
        CALENDAR,
        final="select id, "
        + ", ".join(
            f"{sql.r6(f'{f}(2 * pi() * {c} / cast({p} as double))')} as {stem}_{f}"
            for c, stem, p in (("month", "month", 12), ("day_of_week", "dow", 7), ("hour", "hour", 24))
            for f in ("sin", "cos")
        )
        + " from cal",
    ),
)
def _(spark, sf):
    names = cols.CALENDAR[1:]
    return mart.cyclical_encoding(_telemetry_calendar(spark, sf)).select("id", *[r6(c).alias(c) for c in names])


@query(
    "string_functions",
    """select event_id, replace(event_type, 'r', '') as replaced, trim('  ' || event_type || ' ') as trimmed,
       string_split(props, ': ')[1] as head, starts_with(event_type, 'e') as prefix, suffix(event_type, 'k') as suffix,
       md5(event_type) as digest, regexp_matches(event_type, '^c.*k$') as matched from events""",
)
def _(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id",
        F.replace("event_type", F.lit("r"), F.lit("")).alias("replaced"),
        F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"),
        F.split("props", ": ")[0].alias("head"),
        F.startswith("event_type", F.lit("e")).alias("prefix"),
        F.endswith("event_type", F.lit("k")).alias("suffix"),
        F.md5("event_type").alias("digest"),
        F.col("event_type").rlike("^c.*k$").alias("matched"),
    )


@query(
    "math_functions",
    f"""select event_id, {sql.r6('abs(value - 50)')} as absolute, {sql.r6('exp(-value / 100)')} as expo, {sql.r6('sqrt(value)')} as root,
       {sql.r6('case when value > 0 then log10(value) end')} as log10, {sql.r6('greatest(least(value - 50, 30), -30)')} as clipped,
       {sql.r6('1 / (1 + exp(-greatest(least(value - 50, 30), -30)))')} as logistic,
       round_even(value, 1) + cast(0 as double) as banker from events""",
)
def _(spark, sf):
    v = F.col("value")
    return fx.table(spark, sf, "events").select(
        "event_id",
        r6(F.abs(v - 50)).alias("absolute"),
        r6(F.exp(-v / 100)).alias("expo"),
        r6(F.sqrt(v)).alias("root"),
        r6(F.when(v > 0, F.log10(v))).alias("log10"),
        r6(clip(v - 50, -30.0, 30.0)).alias("clipped"),
        r6(logistic(v - 50)).alias("logistic"),
        (F.bround(v, 1) + F.lit(0.0)).alias("banker"),
    )


# --- data-quality checks ---------------------------------------------------------------------


@query("assert_not_null", with_(WAFER, final="""select 'raw_row_id' as column_name, count(*) - count(raw_row_id) as n_bad from wafer
   union all select 'target', count(*) - count(target) from wafer union all select 'c_2', count(*) - count(c_2) from wafer"""))
def _(spark, sf):
    return checks.not_null(fx.wafers(spark, sf), ["raw_row_id", "target", "c_2"])


@query("assert_unique", with_(WAFER, final="""select 'measurement_ts' as column_name, cast(measurement_ts as varchar) as value, count(*) as n from wafer group by 2 having count(*) > 1
   union all select 'raw_row_id', cast(raw_row_id as varchar), count(*) from wafer group by 2 having count(*) > 1"""))
def _(spark, sf):
    w = fx.wafers(spark, sf)
    return checks.unique(w, "raw_row_id").unionByName(checks.unique(w, "measurement_ts"))


@query("assert_accepted_values", "select event_type as value, count(*) as n from events where event_type not in ('click', 'error') group by 1")
def _(spark, sf):
    return checks.accepted_values(fx.table(spark, sf, "events"), "event_type", ["click", "error"])


# The wafers are as many as expected at one scale only; the events are not.
@query("assert_row_count", with_(WAFER, final="""select count(*) as n_rows, 500 as expected from wafer having count(*) <> 500
   union all select count(*), 1234567 from events having count(*) <> 1234567"""))
def _(spark, sf):
    return checks.row_count(fx.wafers(spark, sf), 500).unionByName(checks.row_count(fx.table(spark, sf, "events"), 1_234_567))
