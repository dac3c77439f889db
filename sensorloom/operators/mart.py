"""Staging, calendar features, past-only rolling z-scores and the feature mart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import CALENDAR, ID, OBS, TARGET, TS, natural_order, require_columns, sensor_columns
from ..functions.scalar import clean_timestamp, cyclic, day_of_week
from .frame import global_row_number, with_row_number
from .profile import (
    column_profile,
    keep_drop_rule,
    null_pattern_classes,
    null_pattern_hash,
)

WINDOW_ROWS = 50
BLOCK_ROWS = 8192


def parse_timestamp(seed: DataFrame, raw: str = "timestamp") -> DataFrame:
    """Staging table: the parsed time first, the raw text gone."""
    rest = [c for c in seed.columns if c != raw]
    return seed.select(clean_timestamp(raw).alias(TS), *rest)


def calendar_features(df: DataFrame) -> DataFrame:
    dow = day_of_week(TS)
    return df.select(
        "*",
        F.month(TS).alias("month"),
        dow.alias("day_of_week"),
        F.hour(TS).alias("hour"),
        F.when(dow.isin(0, 6), 1).otherwise(0).alias("is_weekend"),
    )


def cyclical_encoding(df: DataFrame) -> DataFrame:
    cols = []
    for source, stem, period in (("month", "month", 12), ("day_of_week", "dow", 7), ("hour", "hour", 24)):
        s, c = cyclic(F.col(source), period)
        cols += [s.alias(f"{stem}_sin"), c.alias(f"{stem}_cos")]
    return df.select("*", *cols)


def project_kept(df: DataFrame, kept: Sequence[str], others: Sequence[str]) -> DataFrame:
    """Only the kept sensors, in name order, after the other columns asked for."""
    require_columns(kept, "kept sensors")
    return df.select(*others, *sorted(kept))


def observation_ids(df: DataFrame) -> DataFrame:
    """1-based row number by (time, row id)."""
    return with_row_number(df, [TS, ID], ID, OBS)


def with_halo(df: DataFrame, number: str, reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut numbered rows into blocks, each led by the last `reach` rows of the block before.

    Adds `_block` and `_own`; a window over `_block` that looks back up to `reach` rows is exact
    on the rows with `_own`, and only those must be kept.
    """
    size = max(reach, block_rows)
    home = F.floor((F.col(number) - 1) / F.lit(size)).cast("long")
    near_end = (F.col(number) - 1) % F.lit(size) >= size - reach
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.select("*", home.alias("_home"), F.explode(blocks).alias("_block")).select(
        "*", (F.col("_home") == F.col("_block")).alias("_own")
    ).drop("_home")


def _past_z(v: np.ndarray, window: int) -> np.ndarray:
    """z of each value against the `window` values before it; 0 where it is undefined."""
    past = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window, np.nan), v]), window)[: len(v)]
    ok = ~np.isnan(past)
    n = ok.sum(1)
    with np.errstate(all="ignore"):
        mean = np.where(ok, past, 0.0).sum(1) / n
        dev = np.where(ok, past - mean[:, None], 0.0)
        z = (v - mean) / np.sqrt((dev * dev).sum(1) / (n - 1))
        # a constant past has no spread; its computed spread may be a rounding residue
        flat = np.where(ok, past, -np.inf).max(1) <= np.where(ok, past, np.inf).min(1)
    return np.where((n > 1) & ~flat & np.isfinite(z), z, 0.0)


def rolling_z(
    df: DataFrame,
    sensors: Sequence[str],
    number: str = OBS,
    window: int = WINDOW_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`c_rz` = (x - mean) / sample SD of the `window` rows strictly before; 0 where undefined.

    `number` is the global row number. The wide row is moved once, whatever the sensor count, and
    a task holds one block at a time. Hundreds of window expressions over one wide row compile
    slowly and run interpreted; the block form with arrays is several times faster (README).
    """
    names = list(sensors)
    schema = T.StructType(df.schema.fields + [T.StructField(f"{c}_rz", T.DoubleType()) for c in names])

    def score(block: pa.Table) -> pa.Table:
        block = block.sort_by(number)
        own = block["_own"].to_numpy(zero_copy_only=False)
        out = block.filter(block["_own"]).drop_columns(["_block", "_own"])
        for c in names:
            z = _past_z(block[c].to_numpy(zero_copy_only=False).astype(float), window)
            out = out.append_column(f"{c}_rz", pa.array(z[own]))
        return out

    return with_halo(df, number, window, block_rows).groupBy("_block").applyInArrow(score, schema)


def rolling_z_by(
    df: DataFrame, group: str, order: Sequence[str], value: str, window: int = WINDOW_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Past-only rolling z of one value per group (a tool, a line), hot groups included.

    Rows are numbered over (group, order), so a block may start inside a group and a group may
    fill many blocks; the window is over (block, group).
    """
    numbered = with_halo(global_row_number(df, [group, *order], "_rn"), "_rn", window, block_rows)
    w = Window.partitionBy("_block", group).orderBy("_rn").rowsBetween(-window, -1)
    sd = F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    z = F.coalesce((F.col(value) - F.avg(value).over(w)) / sd, F.lit(0.0))
    return numbered.withColumn(f"{value}_rz", z).where("_own").drop("_block", "_own", "_rn")


def missing_flags(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}__missing") for c in sensors])


def n_missing_sensors(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Nulls per row over all kept sensors, as an array so the expression stays flat."""
    nulls = F.filter(F.array(*[F.col(c).isNull() for c in kept]), lambda x: x)
    return df.withColumn("n_missing_sensors", F.size(nulls))


def flag_representatives(df: DataFrame, gaps: Sequence[str]) -> list[str]:
    """Of the kept sensors with gaps, one per distinct null pattern."""
    if not gaps:
        return []
    reps = null_pattern_classes(null_pattern_hash(df, gaps)).select("sensor").collect()
    return sorted(r[0] for r in reps)


def build_mart(staging: DataFrame, profile_where: Column | None = None) -> DataFrame:
    """Staging to mart: profile, keep/drop, calendar, rolling z, flags, row number.

    Two small collects of column names (profile, null patterns) precede the wide pass.
    """
    sensors = sensor_columns(staging)
    profile = keep_drop_rule(column_profile(staging, sensors, profile_where))
    rows = profile.where("keep_in_mart").select("column_name", "has_missing").collect()  # one row per sensor
    kept = require_columns(sorted(r.column_name for r in rows), "kept sensors")
    reps = flag_representatives(staging, [r.column_name for r in rows if r.has_missing])
    features = cyclical_encoding(calendar_features(staging))
    base = project_kept(features, kept, [ID, TS, TARGET, *CALENDAR])
    numbered = observation_ids(base)
    full = n_missing_sensors(missing_flags(rolling_z(numbered, kept), reps), kept)
    order = [OBS, TS, TARGET, *CALENDAR, *kept, *[f"{c}_rz" for c in kept], *[f"{c}__missing" for c in reps]]
    return full.select(*order, "n_missing_sensors")


def mart_sensors(mart: DataFrame) -> list[str]:
    return natural_order(sensor_columns(mart))
