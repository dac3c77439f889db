"""Second moments of many columns in Spark, p x p algebra on the driver, dense scoring in tasks.

p is the number of columns, so everything the driver holds is bounded by the schema and not by
the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .frame import sensor_stats


@dataclass(frozen=True)
class Moments:
    names: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # sample covariance, divisor n - 1

    def select(self, names: Sequence[str]) -> "Moments":
        i = [self.names.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[i], self.cov[np.ix_(i, i)])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix of complete columns by one tree aggregation; 0 where a column is constant."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df.select(*cols)).select("_x")
    r = Correlation.corr(vec, "_x").first()[0].toArray()
    r = np.nan_to_num(r, nan=0.0)
    np.fill_diagonal(r, 1.0)
    return r


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """n, means and covariance of columns without nulls."""
    stats = {
        r.sensor: r
        for r in sensor_stats(
            df, cols, {"n": F.count, "mean": F.avg, "sd": F.stddev_samp}
        ).collect()  # one row per column
    }
    sd = np.array([stats[c].sd or 0.0 for c in cols])
    return Moments(
        list(cols),
        int(stats[cols[0]].n),
        np.array([stats[c].mean for c in cols], dtype=float),
        correlation_matrix(df, cols) * np.outer(sd, sd),
    )


def vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as a matrix, from the flat buffer: no Python object per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


SUMS = "lane int, record int, sums binary"


def records_of(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Numbered arrays of a task's sums, for `summed`."""
    lane = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([lane] * len(parts), pa.int32()), pa.array(list(parts), pa.int32()), pa.array([np.ascontiguousarray(x, np.float64).tobytes() for x in parts.values()], pa.binary())],
        ["lane", "record", "sums"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the records of one number that reach this task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for record, sums in zip(batch["record"].to_pylist(), batch["sums"], strict=True):
            part = np.frombuffer(sums.as_buffer(), np.float64)
            if record in held:
                held[record] += part
            else:
                held[record] = part.copy()
    if held:
        yield records_of(held)


def summed(rows: DataFrame, fn: Callable) -> dict[int, np.ndarray]:
    """What `fn`, a function of Arrow batches that yields `records_of`, gives over all tasks, added up by record number.

    Two levels where there are many tasks: the records of some first, then those sums. The driver gets one sum a record, or
    a few.
    """
    parts = rows.mapInArrow(fn, SUMS)
    lanes = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    added = parts.withColumn("lane", F.col("lane") % lanes).repartition("record", "lane").mapInArrow(_add, SUMS)
    if lanes > 4:
        added = added.repartition("record").mapInArrow(_add, SUMS)
    out: dict[int, np.ndarray] = {}
    for r in added.collect():
        part = np.frombuffer(r.sums, np.float64)
        out[r.record] = out[r.record] + part if r.record in out else part
    return out


def arrays_of(values: np.ndarray) -> pa.Array:
    """A column of numbers, or of arrays for a matrix."""
    if values.ndim == 1:
        return pa.array(values, pa.float64())
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def dense(fn: Callable[[np.ndarray], np.ndarray], schema: str) -> Callable[[Column], Column]:
    """Arrow-batched matrix function of a vector column.

    `fn` maps a block (rows x p) to one column, to a matrix (for `array<double>`), or for a struct
    schema to a dict of columns.
    """

    @arrow_udf(schema)
    def apply(x: pa.Array) -> pa.Array:
        return arrays_of(fn(matrix_of(x)))

    @arrow_udf(schema)
    def apply_struct(x: pa.Array) -> pa.Array:
        out = fn(matrix_of(x))
        return pa.StructArray.from_arrays([arrays_of(v) for v in out.values()], list(out))

    return apply_struct if " " in schema else apply


def with_struct(df: DataFrame, value: Column) -> DataFrame:
    """Add the fields of a struct-valued column as columns."""
    return df.withColumn("_s", value).select(*df.columns, "_s.*")


def loadings_matrix(loadings: DataFrame, sensors: Sequence[str]) -> np.ndarray:
    """`(sensor, k, w)` as p x K in the order of `sensors` (parameter table, p * K rows)."""
    rows = loadings.collect()
    ks = sorted({r["k"] for r in rows})
    out = np.zeros((len(sensors), len(ks)))
    place = {s: i for i, s in enumerate(sensors)}
    for r in rows:
        if r["sensor"] in place:
            out[place[r["sensor"]], ks.index(r["k"])] = r["w"]
    return out


def loadings_table(spark, w: np.ndarray, sensors: Sequence[str]) -> DataFrame:
    rows = [(s, k + 1, float(w[i, k])) for i, s in enumerate(sensors) for k in range(w.shape[1])]
    return spark.createDataFrame(rows, "sensor string, k int, w double")
