"""Classifier fits with Spark ML, calibration, coefficient draws, grids and out-of-fold scores.

Fits are data-parallel; the driver loops over folds, parameters and draws, never over rows.
Every fit returns a `Scorer` whose `score` adds one probability column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CALENDAR, ID, MISSING_FLAG, SENSOR_VALUE, TARGET
from ..session import spool
from .batched import Problems, fit_batch, rows_of
from .linalg import arrays_of, dense, matrix_of, vector
from .metrics import auc_metrics, confusion, holdout_metrics
from .prep import (
    corr_prune,
    dependence_top_k,
    fit_hotelling,
    fit_median,
    fit_pls,
    fit_robust,
    hotelling_t2,
    hub_pairs,
    median_impute,
    pls_scores,
    rf_top_k,
    robust_scale,
    spearman_edges,
    target_priority,
)
from .split import class_balance_weights, positive_weights, repeated_stratified_folds

# Forest settings, calibration folds, draws.
TREES, DEPTH, LEAF = 1000, 5, 10
CALIBRATION_FOLDS = 5
DRAWS = 1000
LOGIT_BOUND = 30.0


@dataclass(frozen=True)
class Scorer:
    """`transform` maps a prepared DataFrame to one with `name` added."""

    transform: Callable[[DataFrame, str], DataFrame]
    coefficients: dict[str, float] | None = None
    intercept: float = 0.0

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return self.transform(df, name)


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def _ml_scorer(model, features: Sequence[str], coefficients=None, intercept=0.0) -> Scorer:
    def transform(df: DataFrame, name: str) -> DataFrame:
        scored = model.transform(_assemble(df, features))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))

    return Scorer(transform, coefficients, intercept)


MOST_STEPS = 5_000


def _settled(model):
    """The fitted model; raises if its steps ended before they converged."""
    if model.hasSummary and model.summary.totalIterations >= MOST_STEPS:
        raise ArithmeticError("the fit did not converge")
    return model


def fit_enet(df: DataFrame, features: Sequence[str], c: float, l1_ratio: float, label: str = TARGET, weight: str = "weight") -> Scorer:
    """Elastic-net logistic regression; the penalty weighs 1/C against the summed row loss."""
    total = df.agg(F.sum(weight)).first()[0]
    lr = LogisticRegression(
        featuresCol="_x", labelCol=label, weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=l1_ratio,
        standardization=False, maxIter=MOST_STEPS,
    )
    model = _settled(lr.fit(_assemble(df, features)))
    return _ml_scorer(model, features, dict(zip(features, map(float, model.coefficients.toArray()))), float(model.intercept))


def fit_rf(df: DataFrame, features: Sequence[str], trees: int = TREES, label: str = TARGET, weight: str = "weight", seed: int = 42, depth: int = DEPTH) -> Scorer:
    rf = RandomForestClassifier(
        featuresCol="_x", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF,
        featureSubsetStrategy="sqrt", seed=seed,
    )
    model = rf.fit(_assemble(df, features))
    return _ml_scorer(model, features, dict(zip(features, map(float, model.featureImportances.toArray()))))


def fit_calibrated(df: DataFrame, fit: Callable[[DataFrame], Scorer], k: int = CALIBRATION_FOLDS, label: str = TARGET, id_col: str = ID) -> tuple[Scorer, list[tuple[float, float]]]:
    """k models, each fitted without one fold and calibrated on it; the score is their mean."""
    # Folds hold the same share of fails each, so that no sigmoid sees one class only.
    numbered = repeated_stratified_folds(df, k, 1, label=label, id_col=id_col)
    folds = spool(numbered.withColumnRenamed("fold", "_fold").drop("repeat"))
    parts = [fit(folds.where(F.col("_fold") != i)) for i in range(k)]
    sigmoids = fold_sigmoids(folds, parts, label, id_col)

    def transform(rows: DataFrame, name: str) -> DataFrame:
        out = rows
        for i, model in enumerate(parts):
            out = model.score(out, f"_p{i}")
        mean = sum((1 / (1 + F.exp(a * F.col(f"_p{i}") + b)) for i, (a, b) in enumerate(sigmoids)), F.lit(0.0)) / len(parts)
        return out.withColumn(name, mean).drop(*[f"_p{i}" for i in range(len(parts))])

    first = parts[0]
    coefs = None
    if first.coefficients is not None:
        coefs = {f: float(np.mean([m.coefficients[f] for m in parts])) for f in first.coefficients}
    return Scorer(transform, coefs), sigmoids


def fold_sigmoids(folds: DataFrame, models: Sequence[Scorer], label: str, id_col: str) -> list[tuple[float, float]]:
    """(a, b) of each model on the fold that it was not fitted on, with smoothed targets; all curves at once."""
    k = len(models)
    scored = None
    for i, model in enumerate(models):
        part = model.score(folds.where(F.col("_fold") == i), "_base").select(id_col, label, "_base", F.array("_fold").alias("_folds"))
        scored = part if scored is None else scored.unionByName(part)
    rows = rows_of(scored, ["_base"], label, id_col, "_folds")
    n = {(r["f"], r["y"]): r["count"] for r in rows.groupBy(F.col("folds")[0].alias("f"), "y").count().collect()}  # two rows a fold
    pos, neg = (np.array([n.get((i, y), 0) for i in range(k)], float) for y in (1, 0))
    problems = Problems(c=np.full(k, np.inf), l1_ratio=0.0, repeat=0, fold=np.arange(k), inside=True, low=1 / (neg + 2), high=(pos + 1) / (pos + 2))
    return [(-float(slope), -float(shift)) for slope, shift in fit_batch(rows, 1, problems)]


def balanced(n: Mapping[tuple, int], repeat: int, fold: int) -> tuple[float, float]:
    """Class weights n / (2 n_class) of the rows outside a fold, from counts by (repeat, fold, label)."""
    by = [sum(c for (r, f, y), c in n.items() if r == repeat and f != fold and y == cls) for cls in (0, 1)]
    return tuple(sum(by) / (2 * x) if x else 1.0 for x in by)


def enet_fold_scores(folds: DataFrame, features: Sequence[str], grid: Sequence[Mapping[str, float]], label: str = TARGET, id_col: str = ID) -> DataFrame:
    """Out-of-fold scores of every setting (`c`, `l1_ratio`): (place in `grid`, repeat, fold, id, y_true, y_score).

    `folds` has one row per row and repeat. All settings, repeats and folds are fitted at once, and rows are scored in one
    pass by the fits that did not see them.
    """
    folds = spool(folds)
    first = folds.agg(F.min("repeat")).first()[0]
    each = folds.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("repeat", "fold"))).alias("_f"))  # one entry a repeat
    once = folds.where(F.col("repeat") == first).drop("repeat", "fold").join(each, id_col)
    once = spool(once.withColumn("_folds", F.col("_f.fold")).drop("_f"))
    n = {(r["repeat"], r["fold"], r[label]): r["count"] for r in folds.groupBy("repeat", "fold", label).count().collect()}
    repeats = sorted({r for r, _, _ in n})
    kinds = 1 + max(f for _, f, _ in n)
    cells = [(g, i, f) for g in range(len(grid)) for i in range(len(repeats)) for f in range(kinds)]
    weigh = [balanced(n, repeats[i], f) for _, i, f in cells]
    problems = Problems(
        c=np.array([grid[g]["c"] for g, _, _ in cells], float), l1_ratio=np.array([grid[g]["l1_ratio"] for g, _, _ in cells], float),
        neg=np.array([w[0] for w in weigh]), pos=np.array([w[1] for w in weigh]),
        repeat=np.array([i for _, i, _ in cells]), fold=np.array([f for _, _, f in cells]),
    )
    beta = fit_batch(rows_of(once, features, label, id_col, "_folds"), len(features), problems).reshape(len(grid), len(repeats), kinds, -1)

    @F.arrow_udf("array<double>")
    def unseen(x: pa.Array, fold: pa.Array) -> pa.Array:
        x, fold = matrix_of(x), matrix_of(fold).astype(int)
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        eta = np.stack([(x * beta[g, i, fold[:, i]]).sum(axis=1) for g in range(len(grid)) for i in range(len(repeats))], axis=1)
        return arrays_of(1 / (1 + np.exp(-np.clip(eta, -700, 700))))

    scored = once.select(F.col(id_col).alias("id"), F.col(label).alias("y_true"), "_folds", F.posexplode(unseen(vector(features), F.col("_folds"))).alias("_at", "y_score"))
    which = F.expr(f"_at % {len(repeats)}")
    return scored.select(
        F.expr(f"_at div {len(repeats)}").cast("int").alias("setting"), F.element_at(F.lit(repeats), (which + 1).cast("int")).alias("repeat"),
        F.element_at("_folds", (which + 1).cast("int")).alias("fold"), "id", "y_true", "y_score",
    )


def coef_draws(df: DataFrame, features: Sequence[str], n_draws: int, c: float, l1_ratio: float, pos_weight: float = 15.0, label: str = TARGET, id_col: str = ID, seed: int = 42) -> DataFrame:
    """`(draw, feature, beta)`, intercept included: refits under bootstrap row weights, all draws at once.

    Poisson weights resample every partition on its own, so draws cost no shuffle.
    """
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two rows
    mean = (n.get(0, 0) + pos_weight * n.get(1, 0)) / max(sum(n.values()), 1)
    draws = np.arange(n_draws)
    problems = Problems(c=np.full(n_draws, float(c)), l1_ratio=l1_ratio, neg=1 / mean, pos=pos_weight / mean, draw=draws)
    beta = fit_batch(rows_of(df, features, label, id_col), len(features), problems, seed)
    names = np.array([*features, "(intercept)"], object)
    table = pd.DataFrame({"draw": np.repeat(draws, len(names)).astype(np.int32), "feature": np.tile(names, n_draws), "beta": beta.ravel()})
    return df.sparkSession.createDataFrame(table, "draw int, feature string, beta double")


def draws_matrix(draws: DataFrame, features: Sequence[str]) -> np.ndarray:
    """S x (p + 1) with the intercept last (parameter table, S * (p + 1) rows)."""
    place = {f: i for i, f in enumerate([*features, "(intercept)"])}
    rows = draws.collect()
    ids = {d: i for i, d in enumerate(sorted({r.draw for r in rows}))}
    out = np.zeros((len(ids), len(place)))
    for r in rows:
        if r.feature in place:
            out[ids[r.draw], place[r.feature]] = r.beta
    return out


def draws_score(df: DataFrame, features: Sequence[str], draws: DataFrame, name: str = "probability") -> DataFrame:
    """Mean over draws of the sigmoid of the clipped logit."""
    b = draws_matrix(draws, features)

    def score(x: np.ndarray) -> np.ndarray:
        logits = np.clip(x @ b[:, :-1].T + b[:, -1], -LOGIT_BOUND, LOGIT_BOUND)
        return (1.0 / (1.0 + np.exp(-logits))).mean(1)

    return df.withColumn(name, dense(score, "double")(vector(features)))


def fit_draws(df: DataFrame, features: Sequence[str], n_draws: int, c: float, l1_ratio: float, pos_weight: float = 15.0, label: str = TARGET, id_col: str = ID) -> Scorer:
    draws = coef_draws(df, features, n_draws, c, l1_ratio, pos_weight, label, id_col)
    return Scorer(lambda rows, name: draws_score(rows, features, draws, name))


# --- design -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """Fitted feature design: `apply` prepares any rows, `features` are its model inputs."""

    apply: Callable[[DataFrame], DataFrame]
    features: list[str]
    stages: dict[str, list[str]]


def _branches(df: DataFrame) -> tuple[list[str], list[str]]:
    import re

    sensors = [c for c in df.columns if re.fullmatch(SENSOR_VALUE, c)]
    aux = [c for c in df.columns if c in CALENDAR or c == "n_missing_sensors" or re.fullmatch(MISSING_FLAG, c)]
    return sensors, aux


@dataclass(frozen=True)
class Pruned:
    """What all front-ends start from: medians (one row per sensor), the imputed rows (stored), sensors imputed and kept."""

    fill: DataFrame
    rows: DataFrame
    have: list[str]
    kept: list[str]


def fit_pruned(train: DataFrame, corr_threshold: float = 0.99, label: str = TARGET, id_col: str = ID) -> Pruned:
    """impute -> prune."""
    sensors, _ = _branches(train)
    fill = spool(fit_median(train, sensors))  # written once: every design applies it several times
    x = spool(median_impute(train, sensors, fill))
    have = [c for c in sensors if c in x.columns]
    pruned = corr_prune(spearman_edges(x, have, corr_threshold, id_col), target_priority(x, have, label))
    kept_set = {r[0] for r in pruned.where("kept").select("feature").collect()}
    return Pruned(fill, x, have, [c for c in have if c in kept_set])


def fit_design(train: DataFrame, front: str, k: int = 20, hubs: int = 0, corr_threshold: float = 0.99, label: str = TARGET, id_col: str = ID, pruned: Pruned | None = None) -> Design:
    """impute -> prune -> front-end (`rfsel`, `hsic`, `pls`) -> aux columns -> robust scale.

    `pruned` is what `fit_pruned` gave for the same rows, if it was fitted before.
    """
    sensors, aux = _branches(train)
    start = pruned or fit_pruned(train, corr_threshold, label, id_col)
    fill, x, kept = start.fill, start.rows, start.kept
    stages = {"staged": sensors, "imputed": start.have, "pruned": kept}
    if front == "pls":
        pls = fit_pls(x, kept, k, label)
        made = [f"pls_{i}" for i in range(pls["rotation"].shape[1])]

        def build(df: DataFrame) -> DataFrame:
            return pls_scores(df, pls)
    else:
        ranked = rf_top_k(x, kept, k, label) if front == "rfsel" else dependence_top_k(x, kept, k, label=label, id_col=id_col)
        order = [r[0] for r in ranked.orderBy("rank").select("feature").collect()]
        chosen = [c for c in kept if c in set(order[:k])]
        t2 = fit_hotelling(x, chosen)
        hub_names = order[:hubs]
        made = [*chosen, "hotelling_t2", *[f"interact_{a}__{b}" for i, a in enumerate(hub_names) for b in hub_names[i + 1 :]]]

        def build(df: DataFrame) -> DataFrame:
            return hub_pairs(hotelling_t2(df, t2), hub_names)

    features = [*made, *aux]
    scale = fit_robust(build(x).select(*[F.col(c).cast("double").alias(c) for c in features]), features)

    def apply(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in sensors and c not in aux]
        y = build(median_impute(df, sensors, fill))
        return robust_scale(y.select(*rest, *[F.col(c).cast("double").alias(c) for c in features]), scale)

    return Design(apply, features, {**stages, "model_inputs": features})


HEADS: Mapping[str, Callable[..., Scorer]] = {
    "enet": lambda df, f, label, id_col, **p: fit_enet(class_balance_weights(df, label), f, p.get("c", 0.1), p.get("l1_ratio", 0.3), label),
    "rf": lambda df, f, label, id_col, **p: fit_rf(class_balance_weights(df, label), f, p.get("trees", TREES), label, depth=p.get("depth", DEPTH)),
    "bayes": lambda df, f, label, id_col, **p: fit_draws(df, f, p.get("draws", DRAWS), p.get("c", 0.05), p.get("l1_ratio", 0.3), label=label, id_col=id_col),
}
FRONTS = ("hsic", "rfsel", "pls")
MODEL_GRID = tuple(f"{f}_{h}" for f in FRONTS for h in HEADS)


def fit_model(train: DataFrame, model_id: str, calibrate: int = 0, label: str = TARGET, id_col: str = ID, design: Design | None = None, applied: DataFrame | None = None, **params) -> tuple[Design, Scorer]:
    """One cell of the grid: front-end and head by name. `applied` is `design` applied to `train`, if it was stored before."""
    front, head = model_id.split("_")
    d = design or fit_design(train, front, params.pop("k", 20), params.pop("hubs", 0), label=label, id_col=id_col)
    x = spool(d.apply(train)) if applied is None else applied  # written once: fits read it many times

    def fit(rows: DataFrame) -> Scorer:
        return HEADS[head](rows, d.features, label, id_col, **params)

    return d, (fit_calibrated(x, fit, calibrate, label, id_col)[0] if calibrate else fit(x))


def holdout_scores(train: DataFrame, test: DataFrame, specs: Mapping[str, dict], label: str = TARGET, id_col: str = ID) -> DataFrame:
    """Each model fitted once on train: long `(pipeline, id, y_true, y_score)` of the test rows.

    Cells that share a front-end share its fitted design and the rows that it prepared; all share the pruned sensors.
    """
    designs: dict[tuple, tuple[Design, DataFrame, DataFrame]] = {}
    out = pruned = None
    for name, spec in specs.items():
        p = dict(spec)
        key = (name.split("_")[0], p.get("k", 20), p.get("hubs", 0))
        if key not in designs:
            pruned = pruned or fit_pruned(train, label=label, id_col=id_col)
            made = fit_design(train, key[0], key[1], key[2], label=label, id_col=id_col, pruned=pruned)
            designs[key] = made, spool(made.apply(train)), spool(made.apply(test))
        d, applied, unseen = designs[key]
        _, scorer = fit_model(train, name, p.pop("calibrate", 0), label, id_col, d, applied, **{a: b for a, b in p.items() if a not in ("k", "hubs")})
        rows = scorer.score(unseen, "y_score").select(
            F.lit(name).alias("pipeline"), F.col(id_col).alias("id"), F.col(label).alias("y_true"), "y_score"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def last_repeat(scored: DataFrame) -> DataFrame:
    """`(id, y_true, y_score)` of the last repeat that scored the row."""
    return scored.groupBy("id").agg(F.max_by("y_true", "repeat").alias("y_true"), F.max_by("y_score", "repeat").alias("y_score"))


def oof_scores(folds: DataFrame, fit: Callable[[DataFrame], Scorer], label: str = TARGET, id_col: str = ID) -> DataFrame:
    """Out-of-fold `(id, y_true, y_score)`; the last repeat wins, rows never scored are absent.

    `folds` carries `repeat` and `fold`. One fit per (repeat, fold); `enet_fold_scores` fits all at once.
    """
    pairs = sorted((r.repeat, r.fold) for r in folds.select("repeat", "fold").distinct().collect())
    out = None
    for rep, fold in pairs:
        here = folds.where(F.col("repeat") == rep)
        scored = fit(here.where(F.col("fold") != fold)).score(here.where(F.col("fold") == fold), "y_score")
        part = scored.select(F.col(id_col).alias("id"), F.col(label).alias("y_true"), "y_score", "repeat")
        out = part if out is None else out.unionByName(part)
    return last_repeat(out)


# What a fit raises when its numbers, not the cluster, are at fault.
NUMERIC_ERRORS = (ArithmeticError, ValueError, np.linalg.LinAlgError)


FOLD_METRICS = ("pr_auc", "roc_auc", "balanced_accuracy", "tpr", "tnr")


def fold_metrics_of(scored: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    m = holdout_metrics(confusion(scored, keys, threshold)).select(*keys, "balanced_accuracy", "tpr", "tnr")
    return auc_metrics(scored, keys).join(m, list(keys)).select(*keys, *FOLD_METRICS)


def enet_grid_search(folds: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence[float]], label: str = TARGET, id_col: str = ID, threshold: float = 0.5) -> DataFrame:
    """All settings of the elastic net x folds, fitted at once: one row each with the five metrics."""
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    scored = spool(enet_fold_scores(folds, features, settings, label, id_col))
    rows = [(i, *[float(s[n]) for n in grid]) for i, s in enumerate(settings)]
    named = folds.sparkSession.createDataFrame(rows, "setting int, " + ", ".join(f"{n} double" for n in grid))  # one row a setting
    return fold_metrics_of(scored, ["setting", "repeat", "fold"], threshold).join(F.broadcast(named), "setting").select(*grid, "repeat", "fold", *FOLD_METRICS)


def grid_search(
    folds: DataFrame, fit: Callable[..., Scorer], grid: Mapping[str, Sequence], label: str = TARGET, id_col: str = ID, threshold: float = 0.5,
    tolerate: tuple[type[Exception], ...] = (),
) -> DataFrame:
    """All parameter sets x folds: one row each with the five metrics.

    An error ends the search, but for those in `tolerate` (NUMERIC_ERRORS for the kernel and draw-based cells), whose
    row has nulls.
    """
    pairs = sorted((r.repeat, r.fold) for r in folds.select("repeat", "fold").distinct().collect())
    names = list(grid)
    spark = folds.sparkSession
    failed, out = [], None
    kept = spool(folds)
    for values in product(*grid.values()):
        params = dict(zip(names, values))
        for rep, fold in pairs:
            here = kept.where(F.col("repeat") == rep)
            try:
                scorer = fit(here.where(F.col("fold") != fold), **params)
            except tolerate:
                failed.append((*map(float, values), rep, fold))
                continue
            part = scorer.score(here.where(F.col("fold") == fold), "y_score").select(
                *[F.lit(float(v)).alias(n) for n, v in params.items()], "repeat", "fold",
                F.col(label).alias("y_true"), "y_score",
            )
            out = part if out is None else out.unionByName(part)
    keys = [*names, "repeat", "fold"]
    result = None if out is None else fold_metrics_of(spool(out), keys, threshold)
    if failed:
        schema = ", ".join([f"{n} double" for n in names] + ["repeat int", "fold int"])
        lost = spark.createDataFrame(failed, schema).select(*keys, *[F.lit(None).cast("double").alias(c) for c in FOLD_METRICS])
        result = lost if result is None else result.unionByName(lost)
    return result
