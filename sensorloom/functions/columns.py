"""Which columns of a wide table play which role, from its schema alone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID, TS, TARGET = "raw_row_id", "measurement_ts", "target"
OBS = "observation_id"

# Name patterns of the column roles.
SENSOR = r"c_\d+"
SENSOR_VALUE = r"c_\d+(_rz)?"
MISSING_FLAG = r"c_\d+__missing"
CALENDAR = ("is_weekend", "month_sin", "month_cos", "dow_sin", "dow_cos", "hour_sin", "hour_cos")


def natural_order(names: Sequence[str]) -> list[str]:
    """By number where the name ends in one, so c_2 precedes c_10."""
    return sorted(names, key=lambda n: [int(t) if t.isdigit() else t for t in re.split(r"(\d+)", n)])


def sensor_columns(df: DataFrame, pattern: str = SENSOR) -> list[str]:
    """Raw sensor columns: no rolling twins, no flags."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def columns_except(df: DataFrame, deny: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(deny)]


def select_except(df: DataFrame, deny: Sequence[str]) -> DataFrame:
    return df.drop(*deny)


def numeric_feature_columns(df: DataFrame, deny: Sequence[str] = (ID, OBS, TS, TARGET)) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(deny)
    ]


def branch_columns(df: DataFrame) -> dict[str, list[str]]:
    """Route columns to the branch that prepares them; others are dropped."""
    cols = df.columns
    return {
        "sensor": [c for c in cols if re.fullmatch(SENSOR_VALUE, c)],
        "n_missing": [c for c in cols if c == "n_missing_sensors"],
        "calendar": [c for c in cols if c in CALENDAR],
        "missing_flag": [c for c in cols if re.fullmatch(MISSING_FLAG, c)],
    }


def require_columns(names: Sequence[str], what: str) -> list[str]:
    if not names:
        raise ValueError(f"no {what} found")
    return list(names)
