"""Train/test splits, folds and row weights, all deterministic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID, TARGET, TS
from ..functions.scalar import hash_order
from .frame import beyond_row, row_number_within


def temporal_split(df: DataFrame, test_size: float = 0.2, ts: str = TS, id_col: str = ID) -> DataFrame:
    """`split` = test for the latest `max(1, round(test_size * n))` rows by (time, id)."""
    marked = beyond_row(df, [ts, id_col], lambda n: n - max(1, round(test_size * n)))
    return marked.withColumn("split", F.when(F.col("_beyond"), "test").otherwise("train")).drop("_beyond")


def stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = ID, label: str = TARGET
) -> DataFrame:
    """Random holdout with the class mix of the whole table; the shuffle is a hash of the id.

    The keys are numbered per class to find each class's boundary; rows are compared with it.
    """
    h = hash_order(seed, id_col)
    placed = row_number_within(df.select(label, h.alias("_h"), id_col), [label], ["_h", id_col], "_rn")
    at_cut = F.col("_rn") == F.bround(F.lit(float(test_size)) * F.col("_rn_of"))
    edges = placed.where(at_cut).select(label, F.struct("_h", id_col).alias("_edge"))  # one row per class
    test = F.struct(h.alias("_h"), F.col(id_col)) <= F.col("_edge")
    marked = df.join(F.broadcast(edges), label, "left")
    return marked.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def repeated_stratified_folds(
    df: DataFrame, k: int = 5, repeats: int = 2, seed: int = 42, id_col: str = ID, label: str = TARGET
) -> DataFrame:
    """One row per (row, repeat) with its fold 0..k-1, every fold with the same class mix."""
    copies = df.select(id_col, label, F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    keyed = copies.withColumn("_h", hash_order(seed, "repeat", id_col))
    placed = row_number_within(keyed, ["repeat", label], ["_h", id_col], "_rn")
    folds = placed.select(id_col, "repeat", ((F.col("_rn") - 1) % k).cast("int").alias("fold"))
    return df.join(folds, id_col)


def time_decay_weights(df: DataFrame, decay: float, ts: str = TS) -> DataFrame:
    """`weight` = exp(-decay * age), age 0 for the newest row and 1 for the oldest, mean 1."""
    if not decay:
        return df.withColumn("weight", F.lit(1.0))
    span = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))  # one row

    def micros(a: str | Column, b: str) -> Column:
        return F.timestamp_diff("MICROSECOND", F.col(a) if isinstance(a, str) else a, F.col(b)).cast("double")

    raw = df.crossJoin(F.broadcast(span)).withColumn(
        "_w",
        F.when(F.col("_hi") > F.col("_lo"), F.exp(-F.lit(float(decay)) * micros(ts, "_hi") / micros("_lo", "_hi")))
        .otherwise(F.lit(1.0)),
    )
    mean = raw.agg(F.avg("_w").alias("_m"))  # one row
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_lo", "_hi", "_w", "_m")


def class_balance_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """`weight` = n / (2 * n_class): both classes weigh the same, mean 1."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # at most two rows
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, c in counts.items():
        weight = F.when(F.col(label) == value, F.lit(n / (len(counts) * c))).otherwise(weight)
    return df.withColumn("weight", weight)


def positive_weights(df: DataFrame, factor: float, label: str = TARGET, base: Column | None = None) -> DataFrame:
    """Up-weight the fails by `factor`, on top of `base`, and scale to mean 1."""
    raw = df.withColumn("_w", (base if base is not None else F.lit(1.0)) * F.when(F.col(label) == 1, float(factor)).otherwise(1.0))
    mean = raw.agg(F.avg("_w").alias("_m"))  # one row
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.when(F.col("_m") > 0, F.col("_w") / F.col("_m")).otherwise(F.col("_w"))).drop("_w", "_m")
