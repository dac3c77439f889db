"""Stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; raises with the path when it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no table at {path}") from e


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def materialise(df: DataFrame, name: str, how: str, path: str | None = None) -> DataFrame:
    """`view` keeps the DataFrame lazy under a name; `table` writes it and reads it back."""
    spark = df.sparkSession
    if how == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if how == "table":
        df.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        out.createOrReplaceTempView(name)
        return out
    raise ValueError(f"unknown materialisation {how!r}")
