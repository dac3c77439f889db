"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_timestamp(c: Column | str) -> Column:
    """`"dd/MM/yyyy HH:mm:ss"` text, with or without quotes, to a zone-free timestamp.

    Bad text raises, as a load must not lose rows silently.
    """
    return F.to_timestamp_ntz(
        F.replace(c, F.lit('"'), F.lit("")), F.lit("dd/MM/yyyy HH:mm:ss")
    )


def try_timestamp(c: Column | str) -> Column:
    """As `clean_timestamp`, but bad text gives null."""
    return F.try_to_timestamp(
        F.replace(c, F.lit('"'), F.lit("")), F.lit("dd/MM/yyyy HH:mm:ss")
    ).cast("timestamp_ntz")


def day_of_week(ts: Column | str) -> Column:
    """0 = Sunday."""
    return F.dayofweek(ts) - 1


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp; null stays null (`greatest` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def logistic(c: Column, bound: float = 30.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(c, -bound, bound)))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den as double; `empty` where den is 0 or null."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty).cast("double"))


def hash_order(seed: int | str, *parts: Column | str) -> Column:
    """Deterministic shuffle key, the same in any engine that has md5."""
    text = [F.lit(str(seed))]
    for p in parts:
        text += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*text))


def hash_draw(key: Column) -> Column:
    """60-bit integer from an md5 text."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines; minus zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
