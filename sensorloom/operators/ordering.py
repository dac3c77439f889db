"""Rank, top-k, bins and running rates over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import global_row_number, running_totals


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group by a full order.

    An aggregate, so equal groups merge map-side; a ranking window would sort each group in
    one task.
    """
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest])


def equal_count_bins(df: DataFrame, order: Sequence[Column | str], k: int, name: str = "bin") -> DataFrame:
    """Bins 1..k of equal row count in order; the first `n mod k` bins get one row more."""
    numbered = global_row_number(df, order, "_rn")
    n = numbered.count()
    k = min(k, n) or 1
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    z = F.col("_rn") - 1
    number = F.when(z < edge, F.floor(z / F.lit(size + 1))).otherwise(
        F.lit(extra) + F.floor((z - edge) / F.lit(max(size, 1)))
    )
    return numbered.withColumn(name, (number + 1).cast("int")).drop("_rn")


def cumulative_rate(
    df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, name: str = "cumulative_rate"
) -> DataFrame:
    """Share of flagged rows from the start of the group up to each row."""
    totals = running_totals(df.withColumn("_one", F.lit(1)), by, order, {"_flags": flag, "_rows": "_one"})
    return totals.withColumn(name, F.col("_flags") / F.col("_rows")).drop("_one", "_flags", "_rows")


def ooc_rates(df: DataFrame, order: Sequence[str], flag: str) -> DataFrame:
    """Trailing and cumulative share of flagged rows over one ordered series.

    The trailing window is `max(20, n // 10)` rows, too wide for a halo: it is the difference of
    two running sums, joined on the row number.
    """
    numbered = global_row_number(df, order, "_rn").withColumn("_g", F.lit(0))
    n = numbered.count()
    w = min(max(20, n // 10), n) or 1
    cum = running_totals(numbered, ["_g"], ["_rn"], {"_c": flag}).drop("_g")
    before = cum.select((F.col("_rn") + w).alias("_rn"), F.col("_c").alias("_c0"))
    rows = F.least(F.col("_rn"), F.lit(w))
    return (
        cum.join(before, "_rn", "left")
        .withColumn("rolling_rate", (F.col("_c") - F.coalesce("_c0", F.lit(0))) / rows)
        .withColumn("cumulative_rate", F.col("_c") / F.col("_rn"))
        .drop("_rn", "_c", "_c0")
    )


def top_k_abs(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """The k rows of largest magnitude, ties by name."""
    return df.orderBy(F.abs(value).desc(), name).limit(k)


def top_k_abs_by(df: DataFrame, by: Sequence[str], value: str, name: str, k: int) -> DataFrame:
    """Top k by magnitude per group, with the place in `rank`."""
    w = Window.partitionBy(*by).orderBy(F.abs(value).desc(), F.col(name))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signed_top(df: DataFrame, value: str, name: str, k: int = 8) -> DataFrame:
    """k most positive and k most negative rows."""
    up = df.where(F.col(value) > 0).orderBy(F.col(value).desc(), name).limit(k)
    down = df.where(F.col(value) < 0).orderBy(F.col(value).asc(), name).limit(k)
    return up.unionByName(down)


def rank_union_top_k(df: DataFrame, first: str, second: str, name: str, k: int = 10) -> DataFrame:
    """Rows in the top k of either column, placed by the second (0-based, smallest first)."""
    # one row per sensor
    w1 = Window.orderBy(F.col(first).desc(), F.col(name))
    w2 = Window.orderBy(F.col(second).desc(), F.col(name))
    kept = df.select("*", F.row_number().over(w1).alias("_r1"), F.row_number().over(w2).alias("_r2")).where(
        (F.col("_r1") <= k) | (F.col("_r2") <= k)
    )
    return kept.withColumn("place", F.row_number().over(Window.orderBy(second, F.desc(name))) - 1).drop("_r1", "_r2")


def selection_rank(features: DataFrame, list_col: str = "features") -> DataFrame:
    """Selected features with strength k - position, tagged by view."""
    f = features.select(F.size(list_col).alias("_k"), F.posexplode(list_col).alias("position", "feature"))
    return f.select(
        "feature",
        (F.col("_k") - F.col("position")).alias("strength"),
        F.when(F.col("feature").endswith("_rz"), "rolling_z").otherwise("raw").alias("view"),
    )


def top_loading_sensors(loadings: DataFrame, k: int = 3) -> DataFrame:
    """Heaviest sensors of each component, as one comma-separated text."""
    top = top_k_abs_by(loadings, ["k"], "w", "sensor", k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "sensor")))  # at most k per component
    return top.groupBy("k").agg(listed.alias("_l")).select("k", F.concat_ws(", ", F.col("_l.sensor")).alias("top_sensors"))


def strongest_sensors(loadings: DataFrame, k: int = 25) -> DataFrame:
    """Sensors by their largest absolute loading on any component."""
    return (
        loadings.groupBy("sensor")
        .agg(F.max(F.abs("w")).alias("max_abs_loading"))
        .orderBy(F.desc("max_abs_loading"), "sensor")
        .limit(k)
    )
