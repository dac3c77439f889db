"""Data-quality checks: each returns the violations, an empty result means the check holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one scan for all columns."""
    counts = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_bad"))
            for c in columns
        ]
    )
    return df.agg(counts.alias("_c")).select(F.inline("_c"))


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"), "n")
    )


def accepted_values(df: DataFrame, column: str, accepted: Sequence) -> DataFrame:
    return (
        df.where(~F.col(column).isin(*accepted))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """One row with the count when it is not the expected one."""
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select("n_rows", F.lit(expected).alias("expected"))
        .where("n_rows <> expected")
    )
