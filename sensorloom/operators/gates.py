"""Process gates: multivariate control charts fitted on passing training rows.

Fitting reads second moments and exact quantiles from Spark; scoring is a dense product per Arrow
batch; everything after the scores is plain columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TARGET
from ..session import spool
from .frame import exact_quantile_array, exact_quantiles, global_row_number, join_keys, row_number_within, running_totals
from .linalg import dense, matrix_of, moments, records_of, summed, vector, with_struct
from .metrics import MIN_POSITIVES, auc_metrics, bootstrap_metrics
from .prep import as_dict, corr_prune, fit_median, fit_robust, median_impute, robust_scale, spearman_edges, target_priority

# Gate settings.
N_COMPONENTS, N_FACTORS, N_MODES, N_SEEDS = 10, 8, 5, 5
T2_ALPHA, Q_ALPHA, DENSITY_ALPHA = 0.03, 0.005, 0.03
CLIP = 5.0
COVERAGE_GRID = (1.0, 0.99, 0.95, 0.9, 0.85, 0.8)
FLOOR = 1e-12
ACTIVE_WEIGHT = 0.05


def passing_reference(df: DataFrame) -> DataFrame:
    """Passing training rows; an empty reference is an error."""
    ref = df.where((F.col("split") == "train") & (F.col(TARGET) == 0)) if "split" in df.columns else df.where(F.col(TARGET) == 0)
    if ref.isEmpty():
        raise ValueError("no passing training rows to serve as reference")
    return ref


@dataclass(frozen=True)
class GateSpace:
    """Fitted preparation of the gate: fill, pruned sensor list, robust scale, clip."""

    sensors: list[str]
    fill: DataFrame
    scale: DataFrame
    bound: float


def fit_gate_space(train: DataFrame, sensors: Sequence[str], corr_threshold: float = 0.99, bound: float = CLIP, id_col: str = "raw_row_id") -> GateSpace:
    fill = fit_median(train, sensors)
    have = sorted(as_dict(fill, "median"))
    filled = median_impute(train, have, fill)
    pruned = corr_prune(spearman_edges(filled, have, corr_threshold, id_col), target_priority(filled, have))
    kept = {r[0] for r in pruned.where("kept").select("feature").collect()}
    names = [s for s in sensors if s in kept]
    return GateSpace(names, fill, fit_robust(filled, names), bound)


def gate_matrix(df: DataFrame, space: GateSpace) -> DataFrame:
    """Sensors of the gate filled, scaled and clipped; other columns stay."""
    fill = as_dict(space.fill, "median")
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in space.sensors})
    return robust_scale(filled, space.scale, space.bound)


# --- scores from given parameters ------------------------------------------------------------


def t2_q_score(df: DataFrame, sensors: Sequence[str], mean: np.ndarray, loadings: np.ndarray, eigen: np.ndarray) -> DataFrame:
    """Add `t2` (sum of t_k^2 / lambda_k) and `q` (squared residual)."""
    lam = np.clip(eigen, FLOOR, None)

    def score(x: np.ndarray) -> dict:
        c = x - mean
        t = c @ loadings
        resid = c - t @ loadings.T
        return {"t2": (t * t / lam).sum(1), "q": (resid * resid).sum(1)}

    return with_struct(df, dense(score, "t2 double, q double")(vector(sensors)))


def residuals(df: DataFrame, sensors: Sequence[str], mean: np.ndarray, loadings: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """Long `(keep..., sensor, resid)`: what the components cannot rebuild."""

    def score(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return c - c @ loadings @ loadings.T

    return _long_vector(df.select(*keep, dense(score, "array<double>")(vector(sensors)).alias("_v")), keep, sensors, "resid")


def _long_vector(df: DataFrame, keep: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    named = F.lit(np.array(list(names)))
    return df.select(*keep, F.posexplode("_v").alias("_i", value)).select(
        *keep, F.element_at(named, F.col("_i") + 1).alias("sensor"), value
    )


def factor_projection(w: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """(I + W' P^-1 W)^-1 W' P^-1, a k x k solve."""
    wp = w.T / np.clip(psi, FLOOR, None)
    return np.linalg.solve(np.eye(w.shape[1]) + wp @ w, wp)


def factor_score(df: DataFrame, sensors: Sequence[str], w: np.ndarray, psi: np.ndarray) -> DataFrame:
    """Add the factor scores `z` (array) and the squared residual `q`."""
    proj = factor_projection(w, psi)

    def score(x: np.ndarray) -> dict:
        z = x @ proj.T
        resid = x - z @ w.T
        return {"z": z, "q": (resid * resid).sum(1)}

    return with_struct(df, dense(score, "z array<double>, q double")(vector(sensors)))


def factor_residuals(df: DataFrame, sensors: Sequence[str], w: np.ndarray, psi: np.ndarray, keep: Sequence[str]) -> DataFrame:
    back = factor_projection(w, psi).T @ w.T
    score = dense(lambda x: x - x @ back, "array<double>")
    return _long_vector(df.select(*keep, score(vector(sensors)).alias("_v")), keep, sensors, "resid")


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        """Log of weight times density of each mode, modes x rows."""
        parts = []
        for wt, mu, cov in zip(self.weights, self.means, self.covs):
            chol = np.linalg.cholesky(cov)
            d = np.linalg.solve(chol, (z - mu).T)
            logdet = 2 * np.log(np.diag(chol)).sum()
            parts.append(np.log(max(wt, 1e-300)) - 0.5 * ((d * d).sum(0) + logdet + z.shape[1] * math.log(2 * math.pi)))
        return np.stack(parts)

    def log_density(self, z: np.ndarray) -> np.ndarray:
        p = self.log_parts(z)
        top = p.max(0)
        return top + np.log(np.exp(p - top).sum(0))


def mixture_log_density(df: DataFrame, z: str, mixture: Mixture, name: str = "density") -> DataFrame:
    return df.withColumn(name, dense(mixture.log_density, "double")(F.col(z)))


# --- fits -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PcaGate:
    sensors: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    eigen: np.ndarray
    t2_ucl: float
    q_ucl: float
    n_reference: int
    logic: str = "or"


def control_limits(ref: DataFrame, uppers: Mapping[str, float], lowers: Mapping[str, float] = {}, by: Sequence[str] = ()) -> DataFrame:
    """Exact reference quantiles: `<stat>_ucl` at 1 - alpha, `<stat>_lcl` at alpha."""
    stats = [*uppers, *lowers]
    probs = {**{s: 1 - a for s, a in uppers.items()}, **dict(lowers)}
    levels = sorted(set(probs.values()))
    long = ref.unpivot(list(by), stats, "stat", "_x")
    q = exact_quantile_array(long, [*by, "stat"], "_x", levels, "_q")
    cols = [
        F.max(F.when(F.col("stat") == s, F.col("_q")[levels.index(probs[s])])).alias(f"{s}_{'ucl' if s in uppers else 'lcl'}")
        for s in stats
    ]
    return q.groupBy(*by).agg(*cols) if by else q.agg(*cols)


def fit_pca_gate(ref: DataFrame, sensors: Sequence[str], n_components: int = N_COMPONENTS, t2_alpha: float = T2_ALPHA, q_alpha: float = Q_ALPHA) -> PcaGate:
    """`ref`: passing training rows in the gate space."""
    m = moments(ref, sensors)
    k = max(1, min(n_components, len(sensors), m.n - 1))
    values, vectors = np.linalg.eigh(m.cov)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(k)])
    eigen = np.clip(values[order], FLOOR, None)
    scored = t2_q_score(ref.select(*sensors), sensors, m.mean, v, eigen).select("t2", "q")
    lim = control_limits(scored, {"t2": t2_alpha, "q": q_alpha}).first()
    return PcaGate(list(sensors), m.mean, v, eigen, lim.t2_ucl, lim.q_ucl, m.n)


def _factor_fit(second: np.ndarray, k: int, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Factor analysis by maximum likelihood on the p x p second-moment matrix.

    For given noise the best loadings are the leading eigenvectors of the matrix in units of the noise; noise and loadings
    take turns until the log-likelihood of a row stands still.
    """
    diag = np.diag(second)
    psi, value = np.clip(diag, FLOOR, None).copy(), -np.inf
    while True:
        unit = np.sqrt(psi)
        values, vectors = np.linalg.eigh(second / np.outer(unit, unit))
        values, vectors = values[::-1], vectors[:, ::-1]
        top = np.maximum(values[:k], 1.0)
        w = unit[:, None] * vectors[:, :k] * np.sqrt(top - 1)
        like = -0.5 * (np.log(top).sum() + (values[:k] / top).sum() + values[k:].sum() + np.log(psi).sum())
        if abs(like - value) <= tolerance:
            return w, psi
        psi, value = np.clip(diag - (w * w).sum(axis=1), 1e-4, None), like


@dataclass(frozen=True)
class FactorGate:
    sensors: list[str]
    members: list[tuple[np.ndarray, np.ndarray, Mixture]]
    density_lcl: float = field(default=float("-inf"))
    q_ucl: float = field(default=float("inf"))
    logic: str = "or"


def factor_gate_score(df: DataFrame, gate: FactorGate) -> DataFrame:
    """Add `density` and `q`, averaged over the members of the seed ensemble."""
    members = [(factor_projection(w, psi), w, mix) for w, psi, mix in gate.members]

    def score(x: np.ndarray) -> dict:
        density, q = np.zeros(len(x)), np.zeros(len(x))
        for proj, w, mix in members:
            z = x @ proj.T
            resid = x - z @ w.T
            density += mix.log_density(z) / len(members)
            q += (resid * resid).sum(1) / len(members)
        return {"density": density, "q": q}

    return with_struct(df, dense(score, "density double, q double")(vector(gate.sensors)))


# Change of the mean log-likelihood of a row at which a mixture stands still, what is added to its variances.
SETTLED, EXTRA_VARIANCE = 1e-3, 1e-4

MOST_PASSES = 5_000

# Rows from which the modes of a mixture are first placed, per mode.
FIRST_ROWS = 50


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive x: shifted up, then by its series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _first_modes(z: np.ndarray, modes: int, cov: np.ndarray, rng: np.random.Generator) -> Mixture:
    """Modes placed apart: each next one at a row drawn by its squared distance from those so far."""
    means = [z[rng.integers(len(z))]]
    while len(means) < modes:
        gap = np.min([((z - m) ** 2).sum(1) for m in means], axis=0)
        means.append(z[rng.choice(len(z), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(z))])
    return Mixture(np.full(modes, 1 / modes), np.array(means), np.repeat(cov[None], modes, axis=0))


def _responsibilities(projections: Sequence[np.ndarray], mixtures: Sequence[Mixture], live: Sequence[int]):
    """Sums of one task for every live member: log-likelihood, and weight, first and second moments of each mode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix_of(batch.column(0))
            for s in live:
                z = x @ projections[s].T
                log = mixtures[s].log_parts(z)
                top = log.max(axis=0)
                total = top + np.log(np.exp(log - top).sum(axis=0))
                r = np.exp(log - total)
                second = np.einsum("kn,ni,nj->kij", r, z, z, optimize=True)
                told = np.concatenate([[total.sum()], r.sum(axis=1), (r @ z).ravel(), second.ravel()])
                sums[s] = sums[s] + told if s in sums else told
        if sums:
            yield records_of(sums)

    return run


def fit_mixtures(rows: DataFrame, n: int, projections: Sequence[np.ndarray], first: Sequence[Mixture]) -> list[Mixture]:
    """Gaussian mixtures on several projections of the same rows, fitted together: one pass a step sums the responsibilities
    of all members that still move.

    Weights are those of a Dirichlet prior of 1 / modes each, so a mode without rows fades. `rows` is a stored table of one
    array column.
    """
    mixtures, live = list(first), list(range(len(first)))
    value = [-np.inf] * len(first)
    for _ in range(MOST_PASSES):
        for s, told in summed(rows, _responsibilities(projections, mixtures, live)).items():
            k, d = mixtures[s].means.shape
            mass, like = np.maximum(told[1 : 1 + k], 1e-10), told[0] / n
            mean = told[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
            cov = told[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
            alpha = 1 / k + mass
            weights = np.exp(digamma(alpha) - digamma(np.array([alpha.sum()])))
            mixtures[s] = Mixture(weights, mean, cov + EXTRA_VARIANCE * np.eye(d))
            if abs(like - value[s]) <= SETTLED:
                mixtures[s] = Mixture(alpha / alpha.sum(), mean, cov + EXTRA_VARIANCE * np.eye(d))
                live.remove(s)
            value[s] = like
        if not live:
            return mixtures
    raise ArithmeticError("the mixture did not settle")


def fit_factor_gate(ref: DataFrame, sensors: Sequence[str], k: int = N_FACTORS, modes: int = N_MODES, seeds: int = N_SEEDS,
                    density_alpha: float = DENSITY_ALPHA, q_alpha: float = Q_ALPHA, seed: int = 42) -> FactorGate:
    """Factor analysis on the second moments plus Gaussian mixtures on the scores, one per seed.

    The factors have one optimum; members differ in where their modes start, and their densities are averaged.
    """
    m = moments(ref, sensors)
    second = m.cov * (m.n - 1) / m.n + np.outer(m.mean, m.mean)
    k, modes = max(1, min(k, len(sensors))), max(1, min(modes, m.n))
    rows = spool(ref.select(vector(sensors).alias("x")))
    some = rows.orderBy(F.xxhash64("x")).limit(FIRST_ROWS * modes).collect()  # a bounded number of rows, at random
    some = np.array([r.x for r in some])
    w, psi = _factor_fit(second, k)
    project = factor_projection(w, psi)
    cov = project @ (m.cov * (m.n - 1) / m.n) @ project.T + EXTRA_VARIANCE * np.eye(k)
    first = [_first_modes(some @ project.T, modes, cov, np.random.default_rng(seed + s)) for s in range(seeds)]
    mixtures = fit_mixtures(rows, m.n, [project] * seeds, first)
    gate = FactorGate(list(sensors), [(w, psi, mix) for mix in mixtures])
    scored = factor_gate_score(ref.select(*sensors), gate).select("density", "q")
    lim = control_limits(scored, {"q": q_alpha}, {"density": density_alpha}).first()
    return FactorGate(gate.sensors, gate.members, lim.density_lcl, lim.q_ucl)


# --- flags ------------------------------------------------------------------------------------


def gate_flags(df: DataFrame, uppers: Mapping[str, Column | float], lowers: Mapping[str, Column | float] = {}, logic: str = "or") -> DataFrame:
    """Add `<stat>_ooc` per statistic, `both_ooc`, `either_ooc` and the verdict `ooc`.

    Limits are exclusive: a value on the limit is in control.
    """
    if logic not in ("or", "and"):
        raise ValueError(f"gate logic must be 'or' or 'and', got {logic!r}")

    def lim(v: Column | float) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    flags = {f"{s}_ooc": F.col(s) > lim(v) for s, v in uppers.items()}
    flags |= {f"{s}_ooc": F.col(s) < lim(v) for s, v in lowers.items()}
    out = df.withColumns(flags)
    both, either = F.lit(True), F.lit(False)
    for name in flags:
        both, either = both & F.col(name), either | F.col(name)
    return out.withColumns({"both_ooc": both, "either_ooc": either, "ooc": both if logic == "and" else either})


def flag_breakdown(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per flag and rows in control."""
    flags = [c for c in flagged.columns if c.endswith("_ooc")] + ["ooc"]

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    aggs = [F.count(F.lit(1)).alias("n_total")]
    aggs += [n(F.col(c)).alias("n_flagged_" + (c[:-4] if c != "ooc" else c)) for c in flags]
    aggs.append(n(~F.col("ooc")).alias("n_in_control"))
    return flagged.groupBy(*by).agg(*aggs) if by else flagged.agg(*aggs)


def ooc_severity(ref: DataFrame, rows: DataFrame, keys: Sequence[str], uppers: Sequence[str], lowers: Sequence[str] = ()) -> DataFrame:
    """`severity`: largest share of the reference at or inside the row's value over the statistics.

    An empirical distribution function per statistic: reference and rows shrink to counts per
    distinct value, one running sum orders them, and the shares join back on the value.
    """
    def long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
        signed = [F.col(s).alias(s) for s in uppers] + [(-F.col(s)).alias(s) for s in lowers]
        return df.select(*ids, *signed).unpivot(list(ids), [*uppers, *lowers], "stat", "_x").where("_x is not null")

    ref_long, row_long = long(ref, []), long(rows, keys)
    n_ref = ref_long.groupBy("stat").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        ref_long.select("stat", "_x", F.lit(1).alias("_r"))
        .unionByName(row_long.select("stat", "_x", F.lit(0).alias("_r")))
        .groupBy("stat", "_x")
        .agg(F.sum("_r").alias("_c"))
    )
    share = join_keys(running_totals(counts, ["stat"], ["_x"], {"_cum": "_c"}), n_ref, ["stat"]).select(
        "stat", "_x", (F.col("_cum") / F.col("_n")).alias("_share")
    )
    return row_long.join(share, ["stat", "_x"]).groupBy(*keys).agg(F.max("_share").alias("severity"))


def gate_conditional(scores: DataFrame, flags: DataFrame, n_boot: int = 0, min_pos: int = MIN_POSITIVES, id_col: str = "id") -> DataFrame:
    """Per pipeline: coverage, fails in and out, global AUCs and AUCs of the rows in control.

    Conditional values are null below `min_pos` fails or with one class. `flags` is `(id, ooc)`.
    """
    joined = scores.join(flags.select(id_col, "ooc"), id_col)
    keys = ["pipeline"]
    counts = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(~F.col("ooc"), 1)).alias("n_in_control"),
        F.sum("y_true").alias("n_fails_total"),
        F.sum(F.when(~F.col("ooc"), F.col("y_true")).otherwise(0)).alias("n_fails_in_control"),
    )
    inside = joined.where(~F.col("ooc"))
    whole = auc_metrics(joined, keys).select(*keys, F.col("pr_auc").alias("global_pr_auc"), F.col("roc_auc").alias("global_roc_auc"))
    cond = auc_metrics(inside, keys)
    ok = (F.col("n_pos") >= min_pos) & (F.col("n_neg") > 0)
    cond = cond.select(*keys, *[F.when(ok, F.col(c)).alias(f"conditional_{c}") for c in ("pr_auc", "roc_auc")])
    out = (
        counts.withColumn("coverage", F.col("n_in_control") / F.col("n_total"))
        .withColumn("n_flagged_ooc", F.col("n_total") - F.col("n_in_control"))
        .withColumn("n_fails_flagged_ooc", F.col("n_fails_total") - F.col("n_fails_in_control"))
        .join(whole, keys)
        .join(cond, keys, "left")
    )
    if n_boot:
        boot = bootstrap_metrics(inside, keys, 0.5, n_boot).select(
            *keys, F.col("pr_auc_ci_low").alias("_lo"), F.col("pr_auc_ci_high").alias("_hi")
        )
        has = F.col("conditional_pr_auc").isNotNull()
        out = out.join(boot, keys, "left").withColumns(
            {"conditional_pr_auc_ci_low": F.when(has, F.col("_lo")), "conditional_pr_auc_ci_high": F.when(has, F.col("_hi"))}
        ).drop("_lo", "_hi")
    return out


def least_coverage(severity: DataFrame, coverages: Sequence[float] = COVERAGE_GRID, id_col: str = "id") -> DataFrame:
    """`(id, need)`: place in the rising coverages of the smallest that keeps the row; rows that none keeps are left out.

    Coverages are nested: a row of least severity is kept by every coverage from its own on.
    """
    placed = global_row_number(severity.select(id_col, "severity"), ["severity", id_col], "_rn")
    n = placed.count()
    kept = [round(c * n) for c in sorted(coverages)]  # halves go to the even number
    need = F.size(F.filter(F.lit(kept).cast("array<long>"), lambda k: k < F.col("_rn")))
    return placed.select(id_col, need.alias("need")).where(F.col("need") < len(kept))


def keep_least_suspicious(severity: DataFrame, coverages: Sequence[float] = COVERAGE_GRID, id_col: str = "id") -> DataFrame:
    """`(id, coverage)`: for each coverage c the `round(c * n)` rows of least severity."""
    rising = F.lit([float(c) for c in sorted(coverages)])
    kept = F.slice(rising, F.col("need") + 1, F.lit(len(coverages)))
    return least_coverage(severity, coverages, id_col).select(id_col, F.explode(kept).alias("coverage"))


def risk_coverage(scores: DataFrame, severity: DataFrame, coverages: Sequence[float] = COVERAGE_GRID, min_pos: int = MIN_POSITIVES, id_col: str = "id") -> DataFrame:
    """AUCs of each pipeline on the kept share of rows, null where too few fails remain.

    Each row counts once, for the smallest coverage that keeps it; the counts of a distinct score at every coverage are sums
    over the coverages up to it, and one running sum orders them all.
    """
    rising = sorted(float(c) for c in coverages)
    placed = scores.select("pipeline", "y_true", "y_score", id_col).join(least_coverage(severity, coverages, id_col), id_col)
    cells = placed.groupBy("pipeline", "y_score").agg(
        *[F.sum(F.when(F.col("need") <= j, c).otherwise(0)).alias(f"{n}{j}") for j in range(len(rising)) for n, c in (("p", F.col("y_true")), ("n", 1 - F.col("y_true")))]
    )
    sums = {f"{run}{j}": f"{n}{j}" for j in range(len(rising)) for run, n in (("tp", "p"), ("fp", "n"))}
    ordered = running_totals(cells, ["pipeline"], [F.col("y_score").desc()], sums)

    def at(j: int) -> Column:
        p, n, tp, fp = (F.col(f"{c}{j}") for c in ("p", "n", "tp", "fp"))
        ap = F.sum(F.when(p > 0, p * tp / (tp + fp)).otherwise(F.lit(0.0)))
        below = F.sum((p * (n / 2 - fp)).cast("double"))
        return F.struct(F.lit(rising[j]).alias("coverage"), F.sum(p).alias("pos"), F.sum(n).alias("neg"), ap.alias("ap"), below.alias("below"))

    each = ordered.groupBy("pipeline").agg(F.array(*[at(j) for j in range(len(rising))]).alias("_c")).select("pipeline", F.inline("_c"))
    ok = (F.col("pos") >= min_pos) & (F.col("pos") > 0) & (F.col("neg") > 0)
    pairs = F.col("pos").cast("double") * F.col("neg")
    return each.where("pos + neg > 0").select(
        "pipeline", "coverage",
        (F.col("pos") + F.col("neg")).alias("n_kept"),
        F.col("pos").alias("n_fails_kept"),
        F.when(ok, F.col("ap") / F.col("pos")).alias("pr_auc"),
        F.when(ok, (F.col("below") + pairs) / pairs).alias("roc_auc"),
    )


def coverage_drift(coverage: DataFrame) -> DataFrame:
    """`(gate, track, coverage)` to one row per gate, in percent."""
    wide = coverage.groupBy("gate").pivot("track", ["interpolation", "extrapolation"]).agg(F.first("coverage"))
    return wide.select(
        "gate",
        (100 * F.col("interpolation")).alias("interpolation_pct"),
        (100 * F.col("extrapolation")).alias("extrapolation_pct"),
        (100 * (F.col("extrapolation") - F.col("interpolation"))).alias("delta_pct"),
    )


def below_limit_share(df: DataFrame, stat: str, limit: Column | float, by: str = "population") -> DataFrame:
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    below = F.col(stat) < lim
    return df.groupBy(by).agg(
        F.count(F.when(below, 1)).alias("n_below"), F.count(stat).alias("n"), (100 * F.avg(below.cast("double"))).alias("pct_below")
    )


def gate_disagreement(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows by which of two gates flags them."""
    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        n(first & ~second, "pca_only"), n(~first & second, "bgm_only"), n(first & second, "both"), n(~first & ~second, "neither"),
    )


def noise_ranking(psi: DataFrame) -> DataFrame:
    """Sensors by falling noise variance, with the spread largest / smallest positive."""
    spread = psi.agg((F.max("psi") / F.min(F.when(F.col("psi") > 0, F.col("psi")))).alias("spread"))  # one row
    w = Window.orderBy(F.desc("psi"), "sensor")  # one row per sensor
    return psi.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(spread))


def contribution_compare(resid: DataFrame) -> DataFrame:
    """`(sensor, pca_resid, sbfa_resid, psi)` of one row: equal-weight and noise-weighted
    contributions, each on its own maximum."""
    raw = resid.select(
        "sensor",
        (F.col("pca_resid") * F.col("pca_resid")).alias("a"),
        (F.col("sbfa_resid") * F.col("sbfa_resid") / F.greatest("psi", F.lit(FLOOR))).alias("b"),
    )
    top = raw.agg(F.max("a").alias("_a"), F.max("b").alias("_b"))  # one row
    return raw.crossJoin(F.broadcast(top)).select(
        "sensor",
        (F.col("a") / F.when(F.col("_a") == 0, 1.0).otherwise(F.col("_a"))).alias("pca_contribution"),
        (F.col("b") / F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_b"))).alias("sbfa_contribution"),
    )


def example_row(df: DataFrame, q: str, id_col: str) -> DataFrame:
    """The row of largest Q, the first by id on a tie."""
    return df.orderBy(F.desc(q), id_col).limit(1)


def active_modes(weights: DataFrame, least: float = ACTIVE_WEIGHT) -> DataFrame:
    """Mixture weights, largest first, and how many count as active."""
    n = weights.agg(F.count(F.when(F.col("weight") >= least, 1)).alias("n_active"))  # one row
    w = Window.orderBy(F.desc("weight"), "mode")  # one row per mode
    return weights.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(n))


def gate_distribution(df: DataFrame, stat: str, by: Sequence[str] = ("population",)) -> DataFrame:
    """Quartiles, mean and count of the finite values per population."""
    x = df.where(F.col(stat).isNotNull() & ~F.isnan(stat) & (F.abs(stat) != float("inf")))
    q = exact_quantiles(x, by, stat, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.join(x.groupBy(*by).agg(F.avg(stat).alias("mean"), F.count(stat).alias("n")), list(by))


def control_ellipse(params: DataFrame, radius: Column, points: int = 60) -> DataFrame:
    """Points of the ellipse at `radius` SDs of a 2-D Gaussian `(mean_x, mean_y, xx, xy, yy)`."""
    half_sum, half_diff = (F.col("xx") + F.col("yy")) / 2, (F.col("xx") - F.col("yy")) / 2
    root = F.sqrt(half_diff * half_diff + F.col("xy") * F.col("xy"))
    major, minor = F.greatest(half_sum + root, F.lit(FLOOR)), F.greatest(half_sum - root, F.lit(FLOOR))
    tilt = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    t = F.lit(2 * math.pi) * F.col("point") / F.lit(float(points - 1))
    base = params.withColumns({"_r": radius, "_a": F.sqrt(major), "_b": F.sqrt(minor), "_t": tilt})
    pts = base.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    u, v = F.col("_r") * F.col("_a") * F.cos(t), F.col("_r") * F.col("_b") * F.sin(t)
    return pts.withColumns(
        {
            "x": F.col("mean_x") + u * F.cos("_t") - v * F.sin("_t"),
            "y": F.col("mean_y") + u * F.sin("_t") + v * F.cos("_t"),
        }
    ).drop("_r", "_a", "_b", "_t")


def chi2_radius(alpha: float) -> Column:
    """Radius of the region of probability 1 - alpha in two dimensions."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(float(alpha))))


def quadrant(y_true: Column, flagged: Column) -> Column:
    return (
        F.when((y_true == 1) & flagged, "caught_fail")
        .when(y_true == 1, "missed_fail")
        .when(flagged, "flagged_pass")
        .otherwise("pass")
    )


def gate_diagnostics(flagged: DataFrame, stats: Sequence[str], keep: Sequence[str], **tags: str) -> DataFrame:
    """Long `(tags, keep..., stat, value, flag)` of the control statistics, for one stored table."""
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value"), F.col(f"{s}_ooc").alias("flag")) for s in stats])
    return flagged.select(*[F.lit(v).alias(k) for k, v in tags.items()], *keep, F.inline(rows))


# --- reads of the diagnostics -----------------------------------------------------------------

# Text shown per tripped statistic.
TRIPPED = {
    "t2_ooc": "Hotelling T2 above limit",
    "q_ooc": "Q/SPE above limit",
    "density_ooc": "BGM density below limit",
}


def wafer_gate_facts(gates: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Per id: verdict and tripped statistics of each gate; a gate without the id gives null."""
    out = None
    for name, flagged in gates.items():
        trips = [F.when(F.col(c), F.lit(text)) for c, text in TRIPPED.items() if c in flagged.columns]
        fact = F.struct(F.col("ooc").alias("out_of_control"), F.array_compact(F.array(*trips)).alias("tripped"))
        one = flagged.select(id_col, fact.alias(name))
        out = one if out is None else out.join(one, id_col, "full_outer")
    return out


def gate_flag_map(flagged: DataFrame, id_col: str) -> DataFrame:
    return flagged.select(id_col, "ooc")


def passing_ooc_rows(flagged: DataFrame, id_col: str, stat: str = "density", label: str = "y_true") -> DataFrame:
    """Flagged rows that passed, least dense first in `place`, rows without density last."""
    hits = flagged.where(F.col("ooc") & (F.col(label) == 0)).withColumn("_g", F.lit(0))
    placed = row_number_within(hits, ["_g"], [F.asc_nulls_last(stat), id_col], "place")
    return placed.drop("_g", "place_of")


def triage_filter(outcomes: DataFrame, flags: DataFrame, outcome: str | None = None, gate: str = "all", id_col: str = "id") -> DataFrame:
    """Outcomes of one verdict and gate side; ids the gate does not know count as in control."""
    j = outcomes.join(flags.select(id_col, "ooc"), id_col, "left").withColumn("ooc", F.coalesce("ooc", F.lit(False)))
    if outcome is not None:
        j = j.where(F.col("outcome") == outcome)
    if gate == "ooc":
        j = j.where("ooc")
    elif gate == "in_control":
        j = j.where("not ooc")
    return j
