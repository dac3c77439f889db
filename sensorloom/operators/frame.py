"""Shared table shapes and ordered computations that stay parallel at any row count."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_LIMIT, spool
from .quantile import quantile_table

_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def melt(df: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Wide to long `(ids..., sensor, value)`; nulls are kept."""
    return df.unpivot(list(ids), list(sensors), "sensor", "value")


def widen(long: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Long back to wide, with the column list given so that no extra job looks for it."""
    return long.groupBy(*ids).pivot("sensor", list(sensors)).agg(F.first("value"))


def sensor_stats(
    df: DataFrame,
    sensors: Sequence[str],
    stats: Mapping[str, Callable[[str], Column]],
    by: Sequence[str] = (),
    ids: Sequence[str] = (),
) -> DataFrame:
    """One row per sensor (and group) from a single scan.

    Aggregates of the melted table: each map task reduces its cells to one partial row per sensor
    before the shuffle, and the generated code does not grow with the number of sensors, as one
    aggregate expression per column would. `stats` functions get the value column's name; `ids`
    are other columns they read.
    """
    long = melt(df.select(*by, *ids, *sensors), [*by, *ids], sensors)
    return long.groupBy(*by, "sensor").agg(*[fn("value").alias(n) for n, fn in stats.items()])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count the caller has established."""
    return F.broadcast(df) if rows <= BROADCAST_ROW_LIMIT else df


def join_keys(rows: DataFrame, keyed: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row per key: written once, counted, and broadcast if small, so that no row moves."""
    kept = spool(keyed)
    right = small(kept, kept.count())
    return rows.join(right, list(by), how) if by else rows.crossJoin(right)


def global_row_number(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """1-based row number over a total order, without one task seeing all rows.

    Rows are range-partitioned and sorted, each gets its place inside its partition, and the
    table is written once so that the places stay fixed; a partition's offset is the number of
    rows in the partitions before it. `keys` must order the rows fully.
    """
    placed = spool(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _INDEX_BITS)
    index = F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    # one row per range partition
    sizes = {
        r["part"]: r["n"]
        for r in placed.groupBy(part.alias("part")).agg((F.max(index) + 1).alias("n")).collect()
    }
    counts = [sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)]
    offsets = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("int64")
    number = F.element_at(F.lit(offsets), (part + 1).cast("int")) + index + 1
    return placed.withColumn(name, number.cast("long")).drop("_place")


def with_row_number(
    df: DataFrame, keys: Sequence[str], id_col: str, name: str
) -> DataFrame:
    """`global_row_number` for wide rows: only the keys are sorted and written, the number is joined
    back on the unique id."""
    numbers = global_row_number(df.select(*dict.fromkeys([*keys, id_col])), keys, name)
    return df.join(numbers.select(id_col, name), id_col)


def beyond_row(df: DataFrame, keys: Sequence[str], place: Callable[[int], int]) -> DataFrame:
    """Add `_beyond`: whether the row comes after the `place(n)`-th of the n rows in key order.

    The keys alone are numbered to find the one boundary row; every row is then compared with it,
    so a wide table is not moved.
    """
    numbers = global_row_number(df.select(*keys), keys, "_rn")
    cut = place(numbers.count())
    if cut < 1:
        return df.withColumn("_beyond", F.lit(True))
    edge = numbers.where(F.col("_rn") == cut).select(F.struct(*keys).alias("_edge"))  # one row
    return df.crossJoin(F.broadcast(edge)).withColumn("_beyond", F.struct(*keys) > F.col("_edge")).drop("_edge")


def row_number_within(
    df: DataFrame, by: Sequence[str], keys: Sequence[Column | str], name: str
) -> DataFrame:
    """1-based row number inside each group, and the group's row count in `{name}_of`.

    Numbers all rows over (group, keys) and subtracts the group's first number, so a group that
    holds most rows is still spread over many tasks.
    """
    numbered = global_row_number(df, [*by, *keys], "_all")
    firsts = numbered.groupBy(*by).agg(
        (F.min("_all") - 1).alias("_before"), F.count(F.lit(1)).alias(f"{name}_of")
    )
    joined = join_keys(numbered, firsts, by)
    return joined.withColumn(name, F.col("_all") - F.col("_before")).drop("_all", "_before")


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, str]) -> DataFrame:
    """Add, per group, running sums `{new column: summed column}` up to and with each row.

    `order` must be unique inside a group: merge ties by groupBy first. Rows are cut into range partitions of (group, order):
    a running sum inside each piece plus the total of the group's pieces before it, so no task sorts a whole group.
    """
    pieces = spool(df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*by, "_piece").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select(
        *by, "_piece", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    inner = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cols = df.columns
    return (
        pieces.select("*", *[F.sum(c).over(inner).alias(f"_in_{n}") for n, c in sums.items()])
        .join(offsets, [*by, "_piece"])
        .select(*cols, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: one row, one column per probability."""
    q = exact_quantile_array(df, by, value, list(probs.values()), "_q")
    return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def exact_quantile_array(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], name: str) -> DataFrame:
    """Exact, linearly interpolated quantiles per group as one array column, in the order given.

    Nulls are ignored; a group without values gives null. `by` names a handful of groups.
    """
    by = list(by)
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), f"`{name}` array<double>"])
    rows = [(*group, q) for group, _, _, q in quantile_table(df, [value], probs, by)]
    if not by:
        return df.sparkSession.createDataFrame(rows or [(None,)], kinds)
    found = df.sparkSession.createDataFrame(rows, kinds)
    groups, there = df.select(*by).distinct().alias("a"), found.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    return groups.join(F.broadcast(there), same, "left").select(*[F.col(f"a.{c}") for c in by], F.col(f"b.{name}"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank of each non-null value in its group; tied values share the mean of their places."""
    ranks = rank_dictionary(df, by, value, name)
    return df.join(ranks, [*by, value], "left")


def rank_dictionary(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank of each different non-null value of a group: one row a value, whatever the number of copies."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(ties, by, [value], {"_cum": "_c"})
    return cum.select(*by, value, (F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0)).alias(name))
