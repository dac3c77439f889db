"""Result tables: joins of metric tables, grid-search summaries, upserts, funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frame import row_number_within
from .metrics import outcome_rank


def holdout_delta(interpolation: DataFrame, extrapolation: DataFrame, metric: str) -> DataFrame:
    a = interpolation.select("pipeline", F.col(metric).alias("interpolation"))
    b = extrapolation.select("pipeline", F.col(metric).alias("extrapolation"))
    return a.join(b, "pipeline").withColumn("delta", F.col("interpolation") - F.col("extrapolation"))


def cv_vs_holdout(cv: DataFrame, holdout: DataFrame, metric: str) -> DataFrame:
    """Both tables side by side with `_cv` / `_ho` names, best holdout first in `place`."""
    a = cv.select("pipeline", *[F.col(c).alias(f"{c}_cv") for c in cv.columns if c != "pipeline"])
    b = holdout.select("pipeline", *[F.col(c).alias(f"{c}_ho") for c in holdout.columns if c != "pipeline"])
    w = Window.orderBy(F.desc(f"{metric}_ho"), "pipeline")  # one row per model
    return a.join(b, "pipeline").withColumn("place", F.row_number().over(w))


def track_comparison(cv: DataFrame, random_holdout: DataFrame, temporal_holdout: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Two rows per model: its cross-validation value against each track's holdout value."""

    def rows(track: str, holdout: DataFrame) -> DataFrame:
        h = holdout.select("pipeline", F.bround(metric, 3).alias(f"holdout_{metric}"))
        c = cv.select("pipeline", F.lit(track).alias("track"), F.bround(f"mean_{metric}", 3).alias(f"cv_{metric}"))
        return c.join(h, "pipeline", "left")

    return rows("interpolation", random_holdout).unionByName(rows("extrapolation", temporal_holdout))


def outcome_order(outcomes: DataFrame, by: Sequence[str], score: str = "y_score", id_col: str = "id") -> DataFrame:
    """Place in the review list: costly errors first, then by falling probability."""
    keyed = outcomes.withColumn("_o", outcome_rank(F.col("outcome")))
    return row_number_within(keyed, by, ["_o", F.desc(score), id_col], "place").drop("_o", "place_of")


def grid_summary(results: DataFrame, params: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of means and of SDs per parameter set (null is a value), best first in `place`."""
    agg = results.groupBy(*by, *params).agg(
        F.avg("mean_pr_auc").alias("mean_pr_auc"),
        F.avg(F.coalesce("std_pr_auc", F.lit(0.0))).alias("std_pr_auc"),
        F.avg(100 * (1 - F.col("mean_balanced_accuracy"))).alias("mean_ber_percent"),
    )
    w = Window.partitionBy(*by).orderBy(  # one row per parameter set
        F.desc("mean_pr_auc"), F.asc("std_pr_auc"), *[F.asc_nulls_last(p) for p in params]
    )
    return agg.withColumn("place", F.row_number().over(w))


def grid_best(summary: DataFrame, defaults: Mapping[str, object], by: Sequence[str] = ()) -> DataFrame:
    return summary.where("place = 1").select(*by, *[F.coalesce(F.col(p), F.lit(d)).alias(p) for p, d in defaults.items()])


def fold_metrics_for_best(results: DataFrame, best: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """`splitN_test_<metric>` columns of the best parameter set as one row per fold."""
    tail = f"_test_{metric}"
    names = [c for c in results.columns if c.startswith("split") and c.endswith(tail)]
    cond = None
    for k in keys:
        same = results[k].eqNullSafe(best[k])
        cond = same if cond is None else cond & same
    long = results.join(best, cond, "left_semi").unpivot(list(keys), names, "_name", metric)
    return long.select(*keys, F.regexp_extract("_name", r"^split(\d+)", 1).cast("int").alias("fold"), metric)


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `old` whose key is not in `new`, plus `new`."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def selection_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Features `(feature, rank)` picked by both, in the order of the first; each one's top pick."""
    both = first.join(second.select("feature"), "feature", "left_semi")
    tops = [d.agg(F.min_by("feature", "rank").alias(n)) for d, n in ((first, "top_first"), (second, "top_second"))]
    return both.crossJoin(tops[0]).crossJoin(tops[1])  # one row each


def stage_counts(stages: DataFrame) -> DataFrame:
    """Feature count per stage of `(stage_no, stage, feature)` and the drop from the one before."""
    n = stages.groupBy("stage_no", "stage").agg(F.count(F.lit(1)).alias("n_features"))
    w = Window.orderBy("stage_no")  # one row per stage
    return n.withColumn("dropped", F.coalesce(F.lag("n_features").over(w) - F.col("n_features"), F.lit(0)))


def survivor_range(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("n_features").alias("min_features"), F.max("n_features").alias("max_features"))
