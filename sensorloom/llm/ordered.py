"""Places of rows inside groups of any size, for the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import join_counted
from sensorloom.session import spool


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the key columns of two aliased tables, where null equals null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def number_within(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `place` (from 0, by `order`, nulls first) and `total` (rows of the group) to each row of a stored, slim table.

    Rows are range-partitioned by group and order, sorted and written once, so a group of any size is spread over many
    tasks. Only one row per group and partition is summed up: a row's place is its place in the partition's share of the
    group plus the group's rows in earlier partitions. Equal rows are told apart by where they are stored.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id().bitwiseAND(F.lit(1023)))
    dealt = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = spool(dealt.drop("_tie")).withColumn("_part", F.shiftright("_at", 33))
    cells = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = spool(
        cells.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))
    )
    joined = join_counted(placed.alias("a"), cells.alias("b"), same_keys("a", "b", [*by, "_part"]), "inner")
    place = (F.col("_at") - F.col("_first") + F.col("_before")).alias("place")
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], place, "total")
