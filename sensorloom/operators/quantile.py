"""Exact quantiles of many columns and groups at once by selection over key bits.

A double's bits, with negatives flipped, order as the numbers do. A pass counts the non-null values of each column by 16 bits
of that key, below the prefixes that hold a wanted rank; the next pass refines only those buckets. After four passes, or as
soon as every wanted bucket holds one value, the values at the ranks are known exactly. A task sends at most 65,536 counts
for a wanted bucket, whatever its rows, nothing is sorted or moved, and there is one plan for every size.

What the driver holds is a row per group, column and bucket: `by` names a handful of groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_BITS, _PASSES = 16, 4

# Values of a task's runs that are gathered before they are counted.
_GATHER = 1 << 20


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)  # minus zero becomes zero
    return (bits ^ ((bits >> 63) | np.int64(-(2**63)))).view(np.uint64)


def from_keys(keys: np.ndarray) -> np.ndarray:
    bits = keys.view(np.int64)
    return (bits ^ (~(bits >> 63) | np.int64(-(2**63)))).view(np.float64)


def _count(keys: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(prefix, number, least, largest key) of the buckets of `depth` passes that lie below the wanted prefixes."""
    if depth > 1:
        keys = keys[np.isin(keys >> np.uint64(64 - _BITS * (depth - 1)), wanted)]
    keys = np.sort(keys)
    prefix = keys >> np.uint64(64 - _BITS * depth)
    begin = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(keys) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(keys)] if len(keys) else begin
    return prefix[begin], end - begin, keys[begin], keys[end - 1]


def _groups(rows: pa.RecordBatch | pa.Table, by: list[str]) -> list[tuple[tuple, np.ndarray | slice]]:
    """Key values and places of each group; a null is a key of its own."""
    if not by:
        return [((), slice(None))]
    if not rows.num_rows:
        return []
    code, names = np.zeros(rows.num_rows, np.int64), [()]
    for c in by:
        column = rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
        column = column.dictionary_encode()
        values = [*column.dictionary.to_pylist(), None]
        own = column.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
        each, code = np.unique(code * len(values) + own, return_inverse=True)
        names = [(*names[k // len(values)], values[k % len(values)]) for k in each.tolist()]
    order = np.argsort(code, kind="stable")
    cuts = np.cumsum(np.bincount(code, minlength=len(names)))[:-1]
    return list(zip(names, np.split(order, cuts), strict=True))


def _counter(by: list[str], columns: list[str], wanted: dict, depth: int, schema: pa.Schema):
    """Counts of a task, by group, column and bucket."""

    def emit(held: dict) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(len(by))]
        parts: list[tuple] = []
        for (group, j), runs in held.items():
            prefix, n, low, high = _count(np.concatenate(runs), wanted.get((group, j), np.zeros(0, np.uint64)), depth)
            parts.append((np.full(len(n), j, np.int32), prefix.view(np.int64), n, low.view(np.int64), high.view(np.int64)))
            for k, value in enumerate(group):
                rows[k] += [value] * len(n)
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(r, schema.field(i).type) for i, r in enumerate(rows)] + [pa.array(c) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            groups = _groups(batch, by)
            for j, c in enumerate(columns):
                column = batch[c]
                x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                for group, at in groups:
                    if depth > 1 and (group, j) not in wanted:
                        continue
                    v = x[at]
                    v = v[~np.isnan(v)]
                    held.setdefault((group, j), []).append(ordered_keys(v))
                    size += len(v)
            if size > _GATHER:
                yield emit(held)
                held, size = {}, 0
        if held:
            yield emit(held)

    return run


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> list[tuple]:
    """Linearly interpolated quantiles, on the driver: (group, place in `columns`, number of values, quantiles).

    Nulls and NaN are no values; a column without any value in a group has no entry.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(columns)])
    names = [f"_{j}" for j in range(len(columns))]
    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "j int, prefix long, n long, low long, high long"])
    like = rows.select(*by, F.lit(0).alias("j"), *[F.lit(0).cast("long").alias(c) for c in ("prefix", "n", "low", "high")])
    schema = to_arrow_schema(like.schema)
    state: dict | None = None
    wanted: dict = {}
    for depth in range(1, _PASSES + 1):
        told = rows.mapInArrow(_counter(by, names, wanted, depth, schema), shape).groupBy(*by, "j", "prefix")
        got = told.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        state, wanted, settled = _refine(got, by, probs, state)
        if settled:
            break
    return _table(state, by, probs)


def _refine(got: pa.Table, by: list[str], probs: list[float], state: dict | None) -> tuple[dict, dict, bool]:
    """The bucket that holds each wanted rank, and the rank inside it; settled once every such bucket holds one value."""
    new, wanted, settled = {}, {}, True
    told = {c: got[c].to_numpy() for c in ("prefix", "n", "low", "high")}
    for key, at in _groups(got, [*by, "j"]):
        part = {c: x[at] for c, x in told.items()}
        group, j = key[:-1], key[-1]
        prefix = part["prefix"].view(np.uint64)
        order = np.argsort(prefix)
        prefix, n = prefix[order], part["n"][order]
        # All keys of a bucket share their first bit, so signed least and largest are those of the keys.
        low, high = (part[c].view(np.uint64)[order] for c in ("low", "high"))
        if state is None:
            total = int(n.sum())
            at = np.array([p * (total - 1) for p in probs])
            ranks = np.unique(np.r_[np.floor(at), np.ceil(at)]).astype(np.int64)
            entry = {"n": total, "ranks": ranks, "left": ranks, "bucket": np.zeros(len(ranks), np.uint64)}
            above = np.zeros(len(prefix), np.uint64)
        else:
            entry, above = state[group, j], prefix >> np.uint64(_BITS)
        left, bucket, keys = (np.zeros(len(entry["left"]), t) for t in (np.int64, np.uint64, np.uint64))
        for i, rank in enumerate(entry["left"]):
            mine = np.flatnonzero(above == entry["bucket"][i])
            upto = np.cumsum(n[mine])
            b = int(np.searchsorted(upto, rank, side="right"))
            left[i], bucket[i], keys[i] = rank - (upto[b] - n[mine[b]]), prefix[mine[b]], low[mine[b]]
            settled &= bool(low[mine[b]] == high[mine[b]])
        new[group, j] = {**entry, "left": left, "bucket": bucket, "key": keys}
        wanted[group, j] = np.unique(bucket)
    return new, wanted, settled


def _table(state: dict, by: list[str], probs: list[float]) -> list[tuple]:
    rows = []
    for (group, j), e in state.items():
        place = {int(r): float(v) for r, v in zip(e["ranks"], from_keys(e["key"]), strict=True)}
        q = []
        for p in probs:
            at = p * (e["n"] - 1)
            a, b = place[int(np.floor(at))], place[int(np.ceil(at))]
            q.append(a + (b - a) * (at - float(np.floor(at))) if a != b else a)
        rows.append((group, j, e["n"], q))
    return rows
