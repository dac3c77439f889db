"""Column profile, keep/drop rule, null patterns and the exploratory aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ID, TARGET, TS, require_columns, sensor_columns
from ..functions.scalar import ratio
from .frame import global_row_number, melt, sensor_stats
from .quantile import quantile_table

MAX_MISSING = 0.10


def column_profile(
    df: DataFrame,
    sensors: Sequence[str] | None = None,
    where: Column | None = None,
    approx_distinct: bool = False,
) -> DataFrame:
    """Per sensor: n_rows, n_null, missing_rate, n_distinct, raw_variance (population).

    One pass over the long form. Exact distinct counting merges equal `(sensor, value)` pairs
    before and after the shuffle, so no task holds a whole sensor. `approx_distinct` uses a
    sketch, which shuffles nothing row-sized. `where` limits the rows the profile may see (for
    example to the training rows).
    """
    sensors = require_columns(sensors or sensor_columns(df), "sensor columns")
    if where is not None:
        df = df.where(where)
    counts = sensor_stats(
        df,
        sensors,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "n_null": lambda c: F.count(F.lit(1)) - F.count(c),
            "n_distinct": F.approx_count_distinct if approx_distinct else F.count_distinct,
            "raw_variance": F.var_pop,
        },
    )
    return counts.select(
        F.col("sensor").alias("column_name"),
        "n_rows",
        "n_null",
        ratio(F.col("n_null"), F.col("n_rows")).alias("missing_rate"),
        "n_distinct",
        "raw_variance",
    )


def keep_drop_rule(profile: DataFrame, source: str = "features", limit: float = MAX_MISSING) -> DataFrame:
    """Keep a sensor that is missing in under 10 % of rows and varies; name the reason if not."""
    flat = F.col("raw_variance").isNull() | (F.col("raw_variance") == 0)
    sparse = F.col("missing_rate") >= limit
    return profile.select(
        "column_name",
        "n_rows",
        "n_null",
        "missing_rate",
        "n_distinct",
        F.when(flat, F.lit(0.0)).otherwise(F.col("raw_variance")).alias("variance"),
        (F.col("n_null") > 0).alias("has_missing"),
        (~sparse & ~flat).alias("keep_in_mart"),
        F.when(sparse, "high_missing").when(flat, "zero_variance").otherwise("ok").alias("drop_reason"),
        F.current_timestamp().alias("profiled_at"),
        F.lit(source).alias("source_relation"),
    )


def kept_sensors(profile: DataFrame) -> list[str]:
    """Names of kept sensors, sorted; as many rows as the table has columns."""
    rows = profile.where("keep_in_mart").select("column_name").orderBy("column_name").collect()
    return require_columns([r[0] for r in rows], "kept sensors")


def kept_with_missing(profile: DataFrame) -> DataFrame:
    return profile.where("keep_in_mart and has_missing").select("column_name")


def null_pattern_hash(df: DataFrame, sensors: Sequence[str], id_col: str = ID) -> DataFrame:
    """Fingerprint of the set of rows where a sensor is null.

    Two sensors with the same null rows get the same fingerprint. It is a sum over the null rows
    of two 60-bit draws from the row id, so it needs no row order and merges map-side, where a
    string of one character per row could not be built in one task.
    """
    digest = F.md5(F.col(id_col).cast("string"))
    draws = df.select(
        *sensors,
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)").alias("_d1"),
        F.conv(F.substring(digest, 17, 15), 16, 10).cast("decimal(20,0)").alias("_d2"),
    )

    def total(c: str, d: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(d))), F.lit(0).cast("decimal(30,0)"))

    sums = sensor_stats(
        draws,
        sensors,
        {
            "n_null": lambda c: F.count(F.when(F.col(c).isNull(), 1)),
            "s1": lambda c: total(c, "_d1"),
            "s2": lambda c: total(c, "_d2"),
        },
        ids=["_d1", "_d2"],
    )
    text = F.concat_ws(":", F.col("n_null").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string"))
    return sums.select("sensor", "n_null", F.md5(text).alias("pattern_hash"))


def null_pattern_classes(hashes: DataFrame) -> DataFrame:
    """One sensor per distinct null pattern: the first by name."""
    return hashes.groupBy("pattern_hash").agg(
        F.min("sensor").alias("sensor"), F.count(F.lit(1)).alias("n_sensors")
    )


def snapshot_stats(df: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    """One row: counts, fail rate, period, share of missing cells and of sparse sensors."""
    sensors = list(sensors or sensor_columns(df))
    rates = sensor_stats(df, sensors, {"rate": lambda c: F.avg(F.col(c).isNull().cast("double"))})
    cells = rates.agg(
        (100 * F.avg("rate")).alias("missing_cell_pct"),
        (100 * F.avg((F.col("rate") > 0.5).cast("double"))).alias("high_miss_sensor_pct"),
    )
    rows = df.agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count(F.when(F.col(TARGET) == 0, 1)).alias("n_pass"),
        F.count(F.when(F.col(TARGET) == 1, 1)).alias("n_fail"),
        F.avg(F.col(TARGET).cast("double")).alias("fail_rate"),
        F.date_format(F.min(TS), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(TS), "yyyy-MM-dd").alias("date_max"),
    ).withColumn("n_sensors", F.lit(len(sensors)))
    return rows.crossJoin(cells)  # one row each


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.when(F.col(TARGET) == 1, "fail").otherwise("pass").alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def weekly_fail_rate(df: DataFrame) -> DataFrame:
    """Mean target per week ending on Sunday; empty weeks inside the period are null."""
    week_end = F.date_add(F.to_date(F.date_trunc("week", F.col(TS))), 6)
    weeks = df.groupBy(week_end.alias("week_end")).agg(
        F.avg(F.col(TARGET).cast("double")).alias("fail_rate"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(TARGET).cast("long")).alias("fails"),
    )
    calendar = weeks.agg(
        F.sequence(F.min("week_end"), F.max("week_end"), F.expr("interval 7 days")).alias("w"),
        (F.sum("fails") / F.sum("n")).alias("baseline"),
    ).select(F.explode("w").alias("week_end"), "baseline")
    return calendar.join(weeks, "week_end", "left").select(
        "week_end", "fail_rate", F.coalesce("n", F.lit(0)).alias("n"), "baseline"
    )


def missing_rate(df: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    sensors = sensors or sensor_columns(df)
    return sensor_stats(df, sensors, {"missing_rate": lambda c: F.avg(F.col(c).isNull().cast("double"))})


def missing_matrix(df: DataFrame, stride: int = 10, sensors: Sequence[str] | None = None) -> DataFrame:
    """Cells `(row_index, sensor, is_missing)` of every `stride`-th sensor, rows in time order."""
    picked = list(sensors or sensor_columns(df))[::stride]
    flags = df.select(TS, ID, *[F.col(c).isNull().cast("int").alias(c) for c in picked])
    numbered = global_row_number(flags, [TS, ID], "_rn")
    return numbered.unpivot([(F.col("_rn") - 1).alias("row_index")], picked, "sensor", "is_missing")


def missing_rate_hist(rates: DataFrame, bins: int = 20, spike_n: int = 100, spike_share: float = 0.15) -> DataFrame:
    """Histogram of the missing rates above 0, in percent, without a dominating repeated rate.

    The most frequent rate (rounded to 0.1, the smallest on a tie) is left out when at least
    `spike_n` sensors, or `spike_share` of all, have it. Bins have equal width.
    """
    n_all = rates.agg(F.count(F.lit(1)).alias("n"))  # one row
    pct = rates.where("missing_rate > 0").select(
        (F.col("missing_rate") * 100).alias("pct"), F.bround(F.col("missing_rate") * 100, 1).alias("r")
    )
    by_rate = pct.groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    mode = by_rate.agg(
        F.max_by("r", F.struct(F.col("c"), -F.col("r"))).alias("mode"),
        F.max("c").alias("mode_n"),
    ).crossJoin(n_all)
    kept = pct.crossJoin(F.broadcast(mode)).where(  # `mode` is one row
        ~((F.col("r") == F.col("mode")) & ((F.col("mode_n") >= spike_n) | (F.col("mode_n") >= spike_share * F.col("n"))))
    )
    span = kept.agg(F.min("pct").alias("lo"), F.max("pct").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("pct") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        kept.crossJoin(F.broadcast(span))
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"))
    )


def variance_ranking(df: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    """Sensors by sample variance, largest first, ties by name."""
    ranked = sensor_stats(df, sensors or sensor_columns(df), {"variance": F.var_samp, "mean": F.avg})
    w = Window.orderBy(F.desc_nulls_last("variance"), "sensor")  # one row per sensor
    return ranked.select("sensor", "variance", "mean", F.row_number().over(w).alias("rank"))


def sensor_histogram(df: DataFrame, sensor: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram of one sensor per class over the sensor's own range."""
    rows = df.select(TARGET, F.col(sensor).alias("v")).where("v is not null")
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return rows.select(F.lit(0).alias("bin"), TARGET).limit(0).withColumn("n", F.lit(0).cast("long"))
    width = (hi - lo) / bins
    bin_no = F.least(F.floor((F.col("v") - lo) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return rows.groupBy(TARGET, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sensor_correlation(df: DataFrame, top_n: int = 36, min_n: int = 100, sensors: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r between the `top_n` sensors of largest variance.

    Each task sums its batches into one small matrix per sum and emits one row per pair, so the
    shuffle is tasks x pairs. A pair with under `min_n` common rows, or without variance, gets 0.
    """
    ranked = variance_ranking(df, sensors or sensor_columns(df))
    top = ranked.where((F.col("rank") <= top_n) & (F.col("variance") > 0)).orderBy("rank").collect()
    names = [r.sensor for r in top]
    pilot = np.array([r.mean for r in top])  # centring keeps the digits of the second moments
    i, j = np.triu_indices(len(names), 1)

    def sums(batches):
        total = None
        for pdf in batches:
            raw = pdf.to_numpy(dtype=float)
            has = ~np.isnan(raw)
            x, m = np.where(has, raw - pilot, 0.0), has.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            n, sx, sy, sxx, syy, sxy = total[:, i, j]
            yield pd.DataFrame({"i": i, "j": j, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sxy})

    cols = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = df.select(*names).mapInPandas(sums, "i int, j int, " + ", ".join(f"{c} double" for c in cols))
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in cols])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    named = F.lit(np.array(names))
    return t.select(
        F.element_at(named, F.col("i") + 1).alias("a"),
        F.element_at(named, F.col("j") + 1).alias("b"),
        n.cast("long").alias("n"),
        F.when((n >= min_n) & (vx > 0) & (vy > 0), r).otherwise(F.lit(0.0)).alias("r"),
    )


def correlation_order(pairs: DataFrame) -> DataFrame:
    """Sensors by mean absolute correlation with the others, the diagonal counted as 1."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sensor"), F.abs("r").alias("r"))
    return ends.groupBy("sensor").agg(
        ((F.sum("r") + 1) / (F.count(F.lit(1)) + 1)).alias("mean_abs_r"), F.max("r").alias("max_abs_r")
    )


def correlation_summary(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs at or above the threshold, and the strongest pair (last by name on a tie)."""
    strongest = F.max_by(F.concat_ws("~", "a", "b"), F.struct(F.abs("r"), F.concat_ws("~", "a", "b")))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(F.when(F.abs("r") >= threshold, 1)).alias("n_high"),
        F.max(F.abs("r")).alias("max_abs_r"),
        strongest.alias("max_pair"),
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, fail rate and period of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(TARGET).cast("double")).alias("fail_rate"),
        F.date_format(F.min(TS), "yyyy-MM-dd'T'HH:mm:ss").alias("ts_min"),
        F.date_format(F.max(TS), "yyyy-MM-dd'T'HH:mm:ss").alias("ts_max"),
    )


def sensor_quantiles(df: DataFrame, sensors: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of each sensor (and group), found once; null where a sensor has no value."""
    found = {(group, j): q for group, j, _, q in quantile_table(df, sensors, list(probs.values()), by)}
    groups = sorted({g for g, _ in found}, key=str) or ([()] if not by else [])
    nothing = [None] * len(probs)
    rows = [(*g, s, *found.get((g, j), nothing)) for g in groups for j, s in enumerate(sensors)]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, "sensor string", *[f"{n} double" for n in probs]]))
