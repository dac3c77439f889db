"""Stratified bootstrap by score cells: cost is distinct scores x draws, whatever the number of rows.

Rows of one key, class and score are exchangeable, so a draw with replacement needs only how often each cell is hit: the
class total is split over the cells. The cells, highest score first, are the leaves of a binary tree of aligned blocks; a
node's count is split among its two halves by a binomial with the halves' share of the class. Each split has its own number
from a hash of (key, class, draw, level, node), so a draw does not depend on how the work is cut: subtrees of `block` cells
are drawn by different tasks, after one pass over the blocks' totals has drawn what each subtree gets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_draw
from ..session import spool
from .frame import row_number_within

# Cells of a subtree that one task draws; a power of two.
BLOCK = 1 << 14

# Draws that are held at once.
CHUNK = 50

# Odd multipliers that place (class, draw, level, node) in the stream, and those of the 64-bit finaliser.
STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def uniform(key: int, cls: int, draws: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), one per draw and node."""
    mask = (1 << 64) - 1
    base = np.uint64((key + cls * STEPS[0] + level * STEPS[2]) & mask)
    x = base + draws.astype(np.uint64)[:, None] * np.uint64(STEPS[1]) + nodes.astype(np.uint64)[None, :] * np.uint64(STEPS[3])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 16)))])


def _stirling_rest(k: np.ndarray) -> np.ndarray:
    """log(k!) without its leading terms k log k - k + log(2 pi k) / 2, for k > 0."""
    k = np.asarray(k, np.float64)
    low = np.minimum(k, 15).astype(np.int64)
    k1 = np.maximum(k, 1.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * k1**2)) / k1**2) / k1**2) / k1
    return np.where(k < 16, _SMALL[low] - (k1 * np.log(k1) - k1 + 0.5 * np.log(2 * np.pi * k1)), series)


def _mode_mass(n: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability of `m` under Binomial(n, p), near its mode; exact to the last digits for any n."""
    rest, q = n - m, 1.0 - p
    inside = (m > 0) & (rest > 0)
    a, b = np.where(inside, m, 1.0), np.where(inside, rest, 1.0)
    off = a - n * p
    away = np.where(inside, a * np.log1p(np.where(inside, off / np.where(inside, n * p, 1.0), 0)) + b * np.log1p(np.where(inside, -off / np.where(inside, n * q, 1.0), 0)), 0)
    mass = np.exp(_stirling_rest(np.maximum(n, 1)) - _stirling_rest(a) - _stirling_rest(b) - away) * np.sqrt(np.maximum(n, 1) / (2 * np.pi * a * b))
    edge = np.where(m == 0, n * np.log1p(-np.minimum(p, 1 - 1e-300)), n * np.log(np.maximum(p, 1e-300)))
    return np.where(inside, mass, np.exp(edge))


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial(n, p) from one uniform number each: outcomes take their mass from `u` in the order mode, mode + 1, mode - 1,
    mode + 2, ... until it is used up. Exact, in about as many steps as the standard deviation."""
    shape = n.shape
    n, p, u = n.ravel(), np.broadcast_to(p, shape).ravel(), u.ravel()
    out = np.where(p >= 1.0, n, 0)
    live = np.flatnonzero((n > 0) & (p > 0.0) & (p < 1.0))
    nf, pf = n[live].astype(np.float64), p[live]
    m = np.minimum(np.floor((nf + 1) * pf), nf)
    mass = _mode_mass(nf, pf, m)
    odds = pf / (1 - pf)
    left = u[live] - mass
    out[live] = m
    go = left >= 0
    live, nf, odds, m, left, up, down = live[go], nf[go], odds[go], m[go], left[go], mass[go], mass[go]
    high, low = m.copy(), m.copy()
    while len(live):
        up = np.where(high < nf, up * (nf - high) / (high + 1) * odds, 0.0)
        high = high + 1
        hit = left < up
        out[live[hit]] = high[hit]
        left = left - up
        go = ~hit
        live, nf, odds, left, up, down, high, low = live[go], nf[go], odds[go], left[go], up[go], down[go], high[go], low[go]
        down = np.where(low > 0, down * low / ((nf - low + 1) * odds), 0.0)
        low = low - 1
        hit = left < down
        out[live[hit]] = low[hit]
        left = left - down
        go = ~hit & ((high < nf) | (low > 0))  # what rounding leaves over goes to the mode
        live, nf, odds, left, up, down, high, low = live[go], nf[go], odds[go], left[go], up[go], down[go], high[go], low[go]
    return out.reshape(shape)


def split_counts(weights: np.ndarray, totals: np.ndarray, key: int, cls: int, draws: np.ndarray, level: int = 0, first: int = 0) -> np.ndarray:
    """Counts (draws x leaves) that add up to `totals`, one per draw. The leaves are the nodes of `level` from `first` on."""
    deep = int(len(weights) - 1).bit_length()
    sums = [np.concatenate([weights, np.zeros((1 << deep) - len(weights), weights.dtype)])]
    for _ in range(deep):
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    now = totals[:, None]
    for i in range(deep, 0, -1):
        whole, left = sums[i], sums[i - 1][0::2]
        p = np.where(whole > 0, left / np.maximum(whole, 1), 0.0)
        nodes = (first >> i) + np.arange(len(whole))
        some = (left > 0) & (left < whole)  # elsewhere one half has all of the class
        k = np.where(left == whole, now, 0)
        if some.any():
            k[:, some] = binomial(now[:, some], p[some], uniform(key, cls, draws, level + i, nodes[some]))
        now = np.stack([k, now - k], axis=2).reshape(len(draws), -1)
    return now[:, : len(weights)]


def _draws(chunk: int, n_boot: int) -> np.ndarray:
    return np.arange(chunk * CHUNK + 1, min((chunk + 1) * CHUNK, n_boot) + 1)


def _share_blocks(n_boot: int, level: int):
    """Class counts that each block of cells gets in each draw, and those before it."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                draws = _draws(r.chunk, n_boot)
                got = []
                for cls, weights in ((1, np.asarray(r.pos)), (0, np.asarray(r.neg))):
                    got.append(split_counts(weights, np.full(len(draws), weights.sum()), r.hash, cls, draws, level))
                before = [np.cumsum(g, axis=1) - g for g in got]
                for top in range(0, len(r.block), 64):
                    part = range(top, min(top + 64, len(r.block)))
                    yield pd.DataFrame(
                        {"keys": [r.keys] * len(part), "block": [r.block[i] for i in part], "chunk": r.chunk,
                         "pos_got": [got[0][:, i] for i in part], "neg_got": [got[1][:, i] for i in part],
                         "pos_before": [before[0][:, i] for i in part], "neg_before": [before[1][:, i] for i in part]}
                    )

    return share


def _measure(n_boot: int, level: int):
    """What each block adds to the sums behind the metrics, per draw."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                draws, first = _draws(r.chunk, n_boot), r.block << level
                pos = split_counts(np.asarray(r.pos), np.asarray(r.pos_got), r.hash, 1, draws, 0, first)
                neg = split_counts(np.asarray(r.neg), np.asarray(r.neg_got), r.hash, 0, draws, 0, first)
                tp = np.cumsum(pos, axis=1) + np.asarray(r.pos_before)[:, None]
                fp = np.cumsum(neg, axis=1) + np.asarray(r.neg_before)[:, None]
                hit = np.asarray(r.hit, bool)
                yield pd.DataFrame(
                    {"keys": [r.keys] * len(draws), "draw": draws, "ap": (pos * (tp / np.maximum(tp + fp, 1))).sum(axis=1),
                     "below": (pos * (neg / 2 - fp)).sum(axis=1), "tp": pos[:, hit].sum(axis=1), "fp": neg[:, hit].sum(axis=1)}
                )

    return measure


def draw_metrics(
    scores: DataFrame, by: Sequence[str], threshold: float | Column, n_boot: int = 1000, seed: int = 42, block: int = BLOCK
) -> DataFrame:
    """PR-AUC, ROC-AUC and BER of each stratified draw: (by..., draw, pr_auc, roc_auc, ber_percent).

    `by` names at least one column. `threshold` may be a column of `scores` that is constant within a key. A key with one
    class only has no rows.
    """
    by = list(by)
    level = (block - 1).bit_length()
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    cells = scores.where("y_score is not null").groupBy(*by, "y_score").agg(
        F.sum("y_true").cast("long").alias("pos"), F.sum(1 - F.col("y_true")).cast("long").alias("neg"), F.max(F.col("y_score") >= t).alias("hit")
    )
    placed = row_number_within(cells, by, [F.desc("y_score")], "place")
    listed = F.array_sort(F.collect_list(F.struct("place", "pos", "neg", "hit")))  # `block` of them
    number = F.expr(f"(place - 1) div {1 << level}").alias("block")
    key = hash_draw(F.md5(F.concat_ws(":", F.lit(str(seed)), *by)))
    blocks = placed.groupBy(*by, number).agg(listed.alias("c")).select(
        F.struct(*by).alias("keys"), key.alias("hash"), "block", "c.pos", "c.neg", "c.hit"
    )
    blocks = spool(blocks)
    total = {c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias(c) for c in ("pos", "neg")}
    tops = blocks.select("keys", "hash", "block", *total.values()).groupBy("keys", "hash").agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "neg"))).alias("b"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    tops = spool(tops.where("n_pos > 0 and n_neg > 0"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))).alias("chunk")
    keys = f"keys {tops.schema['keys'].dataType.simpleString()}"
    work = tops.select("keys", "hash", "b.block", "b.pos", "b.neg", chunks).repartition("hash", "chunk")
    many = "pos_got array<long>, neg_got array<long>, pos_before array<long>, neg_before array<long>"
    shared = work.mapInPandas(_share_blocks(n_boot, level), f"{keys}, block long, chunk int, {many}")
    both = shared.repartition("keys", "block", "chunk").join(blocks, ["keys", "block"])
    parts = both.mapInPandas(_measure(n_boot, level), f"{keys}, draw int, ap double, below double, tp long, fp long")
    sums = parts.groupBy("keys", "draw").agg(*[F.sum(c).alias(c) for c in ("ap", "below", "tp", "fp")])
    p, n = F.col("n_pos"), F.col("n_neg")
    pairs = p.cast("double") * n
    ber = 100 * (1 - (F.col("tp") / p + (n - F.col("fp")) / n) / 2)
    return sums.join(tops.select("keys", "n_pos", "n_neg"), "keys").select(
        "keys.*", "draw", (F.col("ap") / p).alias("pr_auc"), ((F.col("below") + pairs) / pairs).alias("roc_auc"), ber.alias("ber_percent")
    )


def interval(values: DataFrame, by: Sequence[str], stats: Sequence[str], level: float = 0.95) -> DataFrame:
    """Median and percentile interval of each column over the rows of a key: a bootstrap's draws, a thousand or so."""
    alpha = (1 - level) / 2
    p = F.array(F.lit(alpha), F.lit(0.5), F.lit(1 - alpha))
    agg = values.groupBy(*by).agg(*[F.percentile(s, p).alias(s) for s in stats])
    return agg.select(*by, *[F.col(s)[i].alias(f"{s}_{tag}") for s in stats for i, tag in ((1, "median"), (0, "ci_low"), (2, "ci_high"))])
