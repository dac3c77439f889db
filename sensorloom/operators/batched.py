"""Many weighted logistic fits at once: draws, folds, penalties and calibration curves over the same rows.

All problems advance together by proximal Newton steps. A pass over the table multiplies each block of rows with the
coefficients of all problems and adds up, per task, every problem's loss, gradient and curvature; sums of tasks are added
pairwise in Spark. What the driver holds is problems x columns squared, whatever the rows, and that is bounded by taking
`HELD` numbers' worth of problems at a time. A problem is a choice of row weights (class weights, a fold left out, a bootstrap
draw by Poisson weights from a hash of the id) and of penalties, so nothing is copied per problem.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID, TARGET
from ..session import spool
from .linalg import matrix_of, records_of, summed, vector
from .resample import uniform

# Numbers of curvature that the driver and a task hold at once.
HELD = 8_000_000

# Rows multiplied at once, problems per summed record.
ROWS, RECORD = 512, 64

MOST_PASSES = 200


@dataclass(frozen=True)
class Problems:
    """One entry per problem; all arrays are of one length.

    Objective: sum of weight * log loss + (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2) / c, the intercept free.
    `neg` and `pos` weigh the classes; `draw` >= 0 multiplies by Poisson(1) weights; `repeat` >= 0 leaves the rows of `fold` in
    that repeat out, or takes them alone with `inside`. `low` and `high` are the targets of the two classes.
    """

    c: np.ndarray
    l1_ratio: np.ndarray
    neg: np.ndarray = field(default=None)
    pos: np.ndarray = field(default=None)
    draw: np.ndarray = field(default=None)
    repeat: np.ndarray = field(default=None)
    fold: np.ndarray = field(default=None)
    inside: np.ndarray = field(default=None)
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)

    def __post_init__(self):
        n = len(np.atleast_1d(self.c))
        plain = {"neg": 1.0, "pos": 1.0, "draw": -1, "repeat": -1, "fold": -1, "inside": False, "low": 0.0, "high": 1.0}
        for name in self.__dataclass_fields__:
            value = getattr(self, name)
            value = plain[name] if value is None else value
            object.__setattr__(self, name, np.broadcast_to(np.asarray(value), n).copy())

    def __len__(self) -> int:
        return len(self.c)

    def take(self, at: np.ndarray) -> Problems:
        return replace(self, **{name: getattr(self, name)[at] for name in self.__dataclass_fields__})


def _poisson_steps() -> np.ndarray:
    p, k, cum, out = math.exp(-1.0), 0, 0.0, []
    while cum + p > cum:  # until the next chance no longer shows in a double
        cum += p
        out.append(cum)
        k += 1
        p /= k
    return np.array(out)


POISSON = _poisson_steps()


def poisson_weights(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Copies of each row (by its 64-bit key) in each draw: rows x draws."""
    u = uniform(seed, 0, draws, 0, keys.view(np.uint64))
    return np.searchsorted(POISSON, u.T, side="right").astype(np.float64)


def row_weights(p: Problems, y: np.ndarray, keys: np.ndarray, folds: np.ndarray | None, seed: int) -> np.ndarray:
    """Weight of each row in each problem."""
    w = np.where(y[:, None] == 1, p.pos[None, :], p.neg[None, :]).astype(np.float64)
    drawn = np.flatnonzero(p.draw >= 0)
    if len(drawn):
        each, at = np.unique(p.draw[drawn], return_inverse=True)
        w[:, drawn] *= poisson_weights(keys, each, seed)[:, at]
    cut = np.flatnonzero(p.repeat >= 0)
    if len(cut):
        here = folds[:, p.repeat[cut]] == p.fold[cut][None, :]
        w[:, cut] *= np.where(p.inside[cut][None, :], here, ~here)
    return w


def rows_of(df: DataFrame, features: Sequence[str], label: str = TARGET, id_col: str = ID, folds: str | None = None) -> DataFrame:
    """The table that passes read: vector, label, key and the folds of each repeat; stored."""
    fold = F.col(folds).cast("array<int>") if folds else F.lit(None).cast("array<int>")
    return spool(df.select(vector(features).alias("x"), F.col(label).cast("int").alias("y"), F.xxhash64(id_col).alias("key"), fold.alias("folds")))


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Blocks of a batch of `rows_of`: matrix with a last column of ones, labels, keys, folds."""
    for top in range(0, batch.num_rows, ROWS):
        part = batch.slice(top, ROWS)
        x = matrix_of(part["x"])
        folds = None if part["folds"].null_count else matrix_of(part["folds"])
        yield np.concatenate([x, np.ones((len(x), 1))], axis=1), part["y"].to_numpy(), part["key"].to_numpy(), folds


def _pass(p: Problems, beta: np.ndarray, seed: int):
    """Sums of one task: loss, gradient and curvature of every problem."""
    wide = beta.shape[1]
    upper = np.triu_indices(wide)
    target = np.stack([p.low, p.high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = np.zeros(len(p)), np.zeros((len(p), wide))
        bend = np.zeros((len(p), len(upper[0])))
        for batch in batches:
            for x, y, keys, folds in blocks_of(batch):
                w = row_weights(p, y, keys, folds, seed)
                eta = x @ beta.T
                t = target[y]
                loss += (w * (np.logaddexp(0, eta) - t * eta)).sum(axis=0)
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                slope += (w * (mu - t)).T @ x
                bend += (w * mu * (1 - mu)).T @ (x[:, upper[0]] * x[:, upper[1]])
        told = np.concatenate([loss[:, None], slope, bend], axis=1)
        yield records_of({i // RECORD: told[i : i + RECORD] for i in range(0, len(p), RECORD)})

    return run


def _sums(rows: DataFrame, p: Problems, beta: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = beta.shape[1]
    size = 1 + wide + wide * (wide + 1) // 2
    told = np.zeros((len(p), size))
    for record, part in summed(rows, _pass(p, beta, seed)).items():  # records of RECORD problems each
        part = part.reshape(-1, size)
        told[record * RECORD : record * RECORD + len(part)] = part
    upper = np.triu_indices(wide)
    bend = np.zeros((len(p), wide, wide))
    bend[:, upper[0], upper[1]] = told[:, 1 + wide :]
    bend[:, upper[1], upper[0]] = told[:, 1 + wide :]
    return told[:, 0], told[:, 1 : 1 + wide], bend


def newton_step(beta: np.ndarray, slope: np.ndarray, bend: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimiser of each problem's quadratic model with its penalty, minus `beta`, by coordinates; the last has no penalty."""
    wide = beta.shape[1]
    now, moved = beta.copy(), np.zeros_like(beta)  # moved: curvature times the step so far
    diagonal = np.maximum(bend[:, range(wide), range(wide)], 1e-12)
    live = np.arange(len(beta))
    for _ in range(1_000):
        most = np.zeros(len(live))
        for j in range(wide):
            a1, a2 = (0.0, 0.0) if j == wide - 1 else (l1[live], l2[live])
            whole = diagonal[live, j] + a2
            z = whole * now[live, j] - (slope[live, j] + moved[live, j] + a2 * now[live, j])
            step = np.sign(z) * np.maximum(np.abs(z) - a1, 0) / whole - now[live, j]
            now[live, j] += step
            moved[live] += bend[live, :, j] * step[:, None]
            most = np.maximum(most, np.abs(step))
        live = live[most > 1e-10 * (1 + np.abs(now[live]).max(axis=1))]
        if not len(live):
            break
    return now - beta


def _penalty(beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    b = beta[:, :-1]
    return l1 * np.abs(b).sum(axis=1) + l2 * (b * b).sum(axis=1) / 2


def fit_batch(rows: DataFrame, wide: int, problems: Problems, seed: int = 42, tolerance: float = 1e-7) -> np.ndarray:
    """Coefficients of all problems, the intercept last: problems x (columns + 1). `rows` is a table of `rows_of`."""
    beta = np.zeros((len(problems), wide + 1))
    at_once = max(1, HELD // (wide + 1) ** 2)
    for top in range(0, len(problems), at_once):
        part = np.arange(top, min(top + at_once, len(problems)))
        beta[part] = _fit_some(rows, problems.take(part), wide + 1, seed, tolerance)
    return beta


def _fit_some(rows: DataFrame, problems: Problems, wide: int, seed: int, tolerance: float) -> np.ndarray:
    beta = np.zeros((len(problems), wide))
    l1, l2 = problems.l1_ratio / problems.c, (1 - problems.l1_ratio) / problems.c
    live = np.arange(len(problems))
    trial, size = beta.copy(), np.ones(len(problems))
    step, gain, value = np.zeros_like(beta), np.zeros(len(problems)), np.full(len(problems), np.inf)
    for _ in range(MOST_PASSES):
        loss, slope, bend = _sums(rows, problems.take(live), trial[live], seed)
        found = loss + _penalty(trial[live], l1[live], l2[live])
        better = found <= value[live] + 1e-4 * size[live] * gain[live] + 1e-12 * np.abs(found)
        worse = live[~better]
        size[worse] /= 2
        trial[worse] = beta[worse] + size[worse, None] * step[worse]
        good = live[better]
        beta[good], value[good], size[good] = trial[good], found[better], 1.0
        if len(good):
            slope, bend = slope[better], bend[better]
            step[good] = newton_step(beta[good], slope, bend, l1[good], l2[good])
            ahead = beta[good] + step[good]
            gain[good] = (slope * step[good]).sum(axis=1) + _penalty(ahead, l1[good], l2[good]) - _penalty(beta[good], l1[good], l2[good])
            trial[good] = ahead
        small = np.abs(size[live, None] * step[live]).max(axis=1) <= tolerance * (1 + np.abs(beta[live]).max(axis=1))
        live = live[~small]
        if not len(live):
            return beta
    raise ArithmeticError(f"{len(live)} fits did not converge")


def scores_of(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probabilities, rows x problems, of a matrix whose last column is one."""
    return 1 / (1 + np.exp(-np.clip(x @ beta.T, -700, 700)))
