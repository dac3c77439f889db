"""Adapters that give the test tables the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SENSORS = 64
SENSORS = [f"c_{i}" for i in range(N_SENSORS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_modulus(i: int) -> int:
    """Percent of rows in which sensor i is null."""
    return 0 if i % 4 == 1 else 25 if i % 16 == 0 else 4


def _value_sql(i: int) -> str:
    e = f"cast(embedding[{i}] as double)"
    if i == 5:
        e = "1.0D"
    if i == 9:
        e = "2 * cast(embedding[8] as double) + 1"
    if i == 13:
        e = f"{e} + vec_id * 0.01D"
    return f"case when (vec_id * 7 + {i // 2 * 26}) % 100 < {missing_modulus(i)} then null else {e} end"


def wafers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sensors per item, pairs of items share a timestamp, sensors with rule-made gaps."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "timestampadd(MINUTE, cast(floor(vec_id / 2) * 131 as int), timestamp_ntz'2008-07-19 00:00:00') as measurement_ts",
        "vec_id as raw_row_id",
        "case when label = 0 then 1 else 0 end as target",
        *[f"{_value_sql(i)} as c_{i}" for i in range(N_SENSORS)],
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts",
        "user_id as tool",
        "case when event_id % 7 = 0 then null else value end as value",
        "case when event_type = 'error' then 1 else 0 end as target",
    )


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with ties of three pipelines over the labelled documents, with folds."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id as id", "toxic as y_true")
    pipelines = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("pipeline"), F.lit(m).alias("m"))
                for n, m in (("alpha", 37), ("beta", 41), ("gamma", 43))
            ]
        )
    )
    return labels.select("*", pipelines.alias("p")).selectExpr(
        "p.pipeline as pipeline",
        "cast(id % 5 as int) as fold",
        "id",
        "y_true",
        "cast((id * p.m) % 97 + y_true * 30 as double) / 650.0D as y_score",
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "case when event_type = 'error' then 1 else 0 end as y_true",
        "least(value / 500D, 1D) as y_score",
    )


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`label "dd/MM/yyyy HH:mm:ss"` lines from orders, with a blank and a one-token line for each
    tenth order."""
    orders = table(spark, sf_dir, "orders")
    line = F.concat(
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1"),
        F.lit(' "'),
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"),
        F.lit('"'),
    )
    junk = F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit("   "), F.lit("-1"))).otherwise(F.array(line))
    return orders.select("o_orderkey", F.explode(junk).alias("value"))


def sensor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace-separated sensor lines with `NaN` gaps, from lineitem."""
    n = [
        F.col("l_quantity").cast("string"),
        F.when(F.col("l_linenumber") == 3, "NaN").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")),
        F.when(F.col("l_suppkey") % 11 == 0, "NaN").otherwise(F.col("l_discount").cast("decimal(4,2)").cast("string")),
    ]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("  ", *n).alias("value"))


WIDE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "case when l_returnflag = 'R' then 1 else 0 end as target", *WIDE_NUMBERS
    )
