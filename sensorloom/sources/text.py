"""Raw text files to the seed table, and results back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frame import global_row_number

_LABEL_LINE = r"^\s*(\S+)\s+(\S.*?)\s*$"


def parse_label_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """`label "timestamp"` lines; blank lines and lines without two tokens are skipped.

    -1 becomes 0 (pass), any other whole number 1 (fail); a label that is no whole number raises. Other columns of
    `lines` are kept.
    """
    rest = [c for c in lines.columns if c != col]
    token = F.regexp_extract(col, _LABEL_LINE, 1)
    stamp = F.regexp_replace(F.regexp_extract(col, _LABEL_LINE, 2), '^"+|"+$', "")
    return lines.where(F.col(col).rlike(_LABEL_LINE)).select(
        *rest,
        F.when(token.try_cast("int") == -1, 0).otherwise(F.when(token.rlike(r"^[+-]?[0-9]+$"), 1).otherwise(_bad(token, "label"))).alias("target"),
        stamp.alias("timestamp"),
    )


def _bad(token: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a {what}: "), token)).cast("int")


def _fields(col: str) -> Column:
    """The numbers of a line; only the token `NaN` is missing, any other text raises."""
    return F.transform(
        F.split(F.trim(col), r"\s+"),
        lambda t: F.when(t == "NaN", F.lit(None).cast("double")).otherwise(
            F.coalesce(t.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), t)).cast("double"))
        ),
    )


def parse_sensor_lines(lines: DataFrame, n_sensors: int, col: str = "value") -> DataFrame:
    """Whitespace-separated numbers to c_0 .. c_{n-1}; `NaN` becomes null, a line of another length raises."""
    rest = [c for c in lines.columns if c != col]
    split = lines.where(F.trim(col) != "").select(*rest, _fields(col).alias("_v"))
    wrong = F.raise_error(F.concat(F.size("_v").cast("string"), F.lit(f" fields, not {n_sensors}"))).cast("array<double>")
    held = split.withColumn("_v", F.when(F.size("_v") == n_sensors, F.col("_v")).otherwise(wrong))
    return held.select(*rest, *[F.col("_v")[i].alias(f"c_{i}") for i in range(n_sensors)])


def parse_sensor_cells(lines: DataFrame, col: str = "value") -> DataFrame:
    """The same lines in long form `(…, sensor, value)`; needs no sensor count."""
    rest = [c for c in lines.columns if c != col]
    return (
        lines.where(F.trim(col) != "")
        .select(*rest, F.posexplode(_fields(col)).alias("_i", "value_"))
        .select(*rest, F.concat(F.lit("c_"), F.col("_i")).alias("sensor"), F.col("value_").alias("value"))
    )


def read_lines(spark, path: str) -> DataFrame:
    """Text lines with a sortable position: file, place of the split in it, line in the split."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_pos"),
    )


def zip_by_row(left: DataFrame, right: DataFrame, pos: str, name: str = "raw_row_id") -> DataFrame:
    """Pair two tables by position, each ordered by its own `pos`; row ids start at 0.

    Raises when the row counts differ.
    """
    a = global_row_number(left, [pos], "_rn").drop(pos)
    b = global_row_number(right, [pos], "_rn").drop(pos)
    n_a, n_b = a.count(), b.count()
    if n_a != n_b:
        raise ValueError(f"row counts differ: {n_a} and {n_b}")
    joined = a.join(b, "_rn")
    rest = [c for c in joined.columns if c != "_rn"]
    return joined.select((F.col("_rn") - 1).alias(name), *rest)


def write_seed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def as_json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def export_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
