"""Drift between the training era and what follows, per sensor, statistic and row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ID, TS
from .frame import beyond_row, melt, running_totals, sensor_stats, with_row_number
from .metrics import auc_metrics
from .prep import as_dict, fit_median
from .profile import sensor_quantiles

# Shift that counts as drift (in SDs), IQR of a normal variable in SDs.
SHIFT_LIMIT = 2.0
NORMAL_IQR = 1.349


def era_table(df: DataFrame, sensors: Sequence[str], test_size: float = 0.2) -> DataFrame | None:
    """Rows with their `era`, sensors filled by the median of all rows.

    None when the period is too short to compare.
    """
    n = df.count()
    n_train = round(n * (1.0 - test_size))
    if n < 4 or n_train < 2 or n_train >= n:
        return None
    marked = beyond_row(df.select(TS, ID, *sensors), [TS, ID], lambda _: n_train)
    fill = as_dict(fit_median(df, sensors), "median")
    era = F.when(F.col("_beyond"), "holdout").otherwise("train")
    return marked.select(
        TS, ID, era.alias("era"), *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) for c in sensors if c in fill]
    )


def _shift_of(eras: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Per sensor: training mean and SD, and the shift of the holdout mean in those SDs.

    The mean of z-scores is the z-score of the mean, so one scan is enough.
    """
    train = sensor_stats(
        eras,
        sensors,
        {
            "mean": lambda c: F.avg(F.when(F.col("era") == "train", F.col(c))),
            "sd": lambda c: F.stddev_pop(F.when(F.col("era") == "train", F.col(c))),
            "later": lambda c: F.avg(F.when(F.col("era") == "holdout", F.col(c))),
        },
        ids=["era"],
    ).where("sd > 0")
    return train.select("sensor", "mean", "sd", ((F.col("later") - F.col("mean")) / F.col("sd")).alias("shift"))


_EMPTY = "sensor string, mean double, sd double, shift double"


def era_drift(df: DataFrame, sensors: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """`(sensor, shift)`; sensors that are constant in training are left out."""
    eras = era_table(df, sensors, test_size)
    if eras is None:
        return df.sparkSession.createDataFrame([], _EMPTY).select("sensor", "shift")
    return _shift_of(eras, [c for c in sensors if c in eras.columns]).select("sensor", "shift")


def era_drift_summary(drift: DataFrame, limit: float = SHIFT_LIMIT) -> DataFrame:
    """Sensors evaluated and drifted, and the median absolute shift (one row per sensor in)."""
    a = F.abs("shift")
    return drift.agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        F.count(F.when(a > limit, 1)).alias("n_drifted"),
        F.coalesce(100 * F.avg((a > limit).cast("double")), F.lit(0.0)).alias("pct_drifted"),
        F.coalesce(F.median(a), F.lit(0.0)).alias("median_abs_shift"),
    )


def drift_heatmap(df: DataFrame, sensors: Sequence[str], top: int = 30, bins: int = 40, bound: float = 4.0, test_size: float = 0.2) -> DataFrame:
    """Mean z per (most drifted sensor, time bin of equal row count), clipped.

    `bin_end` is the day of the bin's last row; `is_boundary` marks the first bin that reaches
    into the holdout era.
    """
    eras = era_table(df, sensors, test_size)
    if eras is None:
        raise ValueError("too few rows for a drift heatmap")
    shift = _shift_of(eras, [c for c in sensors if c in eras.columns])
    best = shift.orderBy(F.abs("shift").desc(), "sensor").limit(top).collect()
    names = [r.sensor for r in best]
    numbered = with_row_number(eras.select(TS, ID, *names), [TS, ID], ID, "_rn")
    n = numbered.count()
    n_train = round(n * (1.0 - test_size))
    k = min(bins, n)
    size, extra = divmod(n, k)
    z = F.col("_rn") - 1
    edge = extra * (size + 1)
    bin_no = F.when(z < edge, F.floor(z / F.lit(size + 1))).otherwise(extra + F.floor((z - edge) / F.lit(size)))
    binned = numbered.select((bin_no + 1).cast("int").alias("bin"), "_rn", TS, *names)
    ends = binned.groupBy("bin").agg(
        F.date_format(F.max_by(TS, "_rn"), "yyyy-MM-dd").alias("bin_end"), F.max("_rn").alias("_last")
    )
    first = ends.where(F.col("_last") > n_train).agg(F.min("bin").alias("_first"))  # one row
    means = sensor_stats(binned, names, {"m": F.avg}, ["bin"])
    scale = F.array(*[F.struct(F.lit(r.sensor).alias("sensor"), F.lit(r.mean).alias("mean"), F.lit(r.sd).alias("sd")) for r in best])
    params = df.sparkSession.range(1).select(F.inline(scale))
    zmean = (F.col("m") - F.col("mean")) / F.col("sd")
    return (
        means.join(F.broadcast(params), "sensor")  # `top` rows
        .join(ends, "bin")
        .crossJoin(F.broadcast(first))
        .select("sensor", "bin", F.greatest(F.least(zmean, F.lit(bound)), F.lit(-bound)).alias("z"), "bin_end",
                (F.col("bin") == F.col("_first")).alias("is_boundary"))
    )


def ks_pvalue(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Tail of the asymptotic distribution of the two-sample distance."""
    en = F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    x = en * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(2 * series, F.lit(1.0)), F.lit(0.0)))


def ks_two_sample(df: DataFrame, by: Sequence[str], value: str, is_holdout: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance between reference and holdout per key, with its p-value."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_x"))
        .agg(F.count(F.when(~is_holdout, 1)).alias("_a"), F.count(F.when(is_holdout, 1)).alias("_b"))
    )
    cum = running_totals(counts, by, ["_x"], {"_ca": "_a", "_cb": "_b"})
    totals = counts.groupBy(*by).agg(F.sum("_a").alias("n_reference"), F.sum("_b").alias("n_holdout"))
    gap = F.abs(F.col("_ca") / F.col("n_reference") - F.col("_cb") / F.col("n_holdout"))
    both = totals.where("n_reference > 0 and n_holdout > 0")
    out = cum.join(both, list(by)).groupBy(*by, "n_reference", "n_holdout").agg(F.max(gap).alias("ks_distance"))
    return out.withColumn("ks_pvalue", ks_pvalue(F.col("ks_distance"), F.col("n_reference"), F.col("n_holdout")))


def separability_auc(df: DataFrame, by: Sequence[str], value: str, is_holdout: Column) -> DataFrame:
    """How well the value tells holdout from reference, in either direction: 0.5 to 1."""
    scores = df.where(F.col(value).isNotNull()).select(*by, is_holdout.cast("int").alias("y_true"), F.col(value).alias("y_score"))
    auc = F.col("roc_auc")
    return auc_metrics(scores, by).select(*by, F.greatest(auc, 1 - auc).alias("separability_auc"))


def factor_drift_ranking(long_scores: DataFrame, is_holdout: Column, top_sensors: DataFrame) -> DataFrame:
    """Factors `(k, score)` by drift: distance, p-value, mean shift and their heaviest sensors."""
    ks = ks_two_sample(long_scores, ["k"], "score", is_holdout)
    shift = long_scores.groupBy("k").agg(
        (F.avg(F.when(is_holdout, F.col("score"))) - F.avg(F.when(~is_holdout, F.col("score")))).alias("mean_shift")
    )
    w = Window.orderBy(F.desc("ks_distance"), "k")  # one row per factor
    return ks.join(shift, "k").join(top_sensors, "k", "left").withColumn("rank", F.row_number().over(w))


def fit_spc(reference: DataFrame, sensors: Sequence[str], least: int = 5) -> DataFrame:
    """`(sensor, median, scale)` of the passing training rows; no row where z is undefined."""
    q = sensor_quantiles(reference, sensors, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    s = sensor_stats(reference, sensors, {"n": F.count, "sd": F.stddev_pop})
    iqr = F.col("q3") - F.col("q1")
    scale = F.when(iqr > 0, iqr / NORMAL_IQR).otherwise(F.col("sd"))
    return q.join(s, "sensor").where(F.col("n") >= least).select("sensor", "median", scale.alias("scale")).where("scale > 0")


def spc_vector(sensors: Sequence[str], params: DataFrame) -> Column:
    """The row's robust z of each sensor, in order: distance from the reference median in robust SDs, null where undefined."""
    fitted = {r.sensor: (r.median, r.scale) for r in params.collect()}  # one row per sensor

    def z(c: str) -> Column:
        return (F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) if c in fitted else F.lit(None).cast("double")

    return F.array(*[z(c) for c in sensors])


def spc_robust_z(rows: DataFrame, sensors: Sequence[str], params: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long `(keep..., sensor, spc_z)`."""
    named = F.lit(np.array(list(sensors)))
    return rows.select(*keep, F.posexplode(spc_vector(sensors, params)).alias("_i", "spc_z")).select(
        *keep, F.get(named, F.col("_i")).alias("sensor"), "spc_z"
    )


def spc_reference(rows: DataFrame, reference: DataFrame, sensors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each row's value beside the five-number summary of the passing reference."""
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    q = sensor_quantiles(reference, sensors, probs)
    # one parameter row per column of the table
    return melt(rows.select(*keep, *sensors), keep, sensors).join(F.broadcast(q), "sensor", "left")


def drift_spikes(rows: DataFrame, sensors: Sequence[str], params: DataFrame, drift: DataFrame, keep: Sequence[str], top: int = 15, limit: float = SHIFT_LIMIT) -> DataFrame:
    """Per row its strongest robust z on the globally drifted sensors, and how many exceed 2.

    The z of a row's own sensors are ranked inside the row, so cells neither move nor leave their row.
    """
    drifted = {r["sensor"]: r["shift"] for r in drift.where(F.abs("shift") > limit).collect()}  # one row per sensor
    names = [c for c in sensors if c in drifted]
    cells = F.zip_with(
        spc_vector(names, params), F.lit(np.array(names)) if names else F.array().cast("array<string>"),
        lambda z, c: F.struct((-F.abs(z)).alias("order"), c.alias("sensor"), z.alias("robust_z")),
    )
    ranked = rows.select(*keep, F.array_sort(F.filter(cells, lambda c: c["robust_z"].isNotNull())).alias("_c"))
    beyond = F.size(F.filter("_c", lambda c: F.abs(c["robust_z"]) > 2)).cast("long").alias("n_beyond_2")
    shift = F.create_map(*[F.lit(x) for c in names for x in (c, drifted[c])]) if names else F.lit(None).cast("map<string,double>")
    listed = ranked.select(*keep, beyond, F.posexplode(F.slice("_c", 1, top)).alias("_i", "_c"))
    return listed.select(
        *keep, "_c.sensor", "_c.robust_z", F.try_element_at(shift, F.col("_c.sensor")).alias("drift_shift"), (F.col("_i") + 1).alias("rank"), "n_beyond_2"
    )
