"""Ranking and decision metrics over long score tables `(keys..., y_true, y_score)`.

Every operator first merges rows with the same score, then works on the distinct scores of each
key, so equal scores never reach one task in bulk and ties are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .frame import exact_quantile_array, join_keys, running_totals
from .resample import draw_metrics, interval

MIN_POSITIVES = 5
PROFILES = ("conservative", "ber", "aggressive", "economic")


def threshold_predict(df: DataFrame, threshold: float | Column, score: str = "y_score") -> DataFrame:
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    return df.withColumn("y_pred", (F.col(score) >= t).cast("int"))


def ranked_counts(scores: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Per distinct score, highest first: `pos`, `neg` there and running `tp`, `fp`."""
    w = F.lit(1) if weight is None else weight
    merged = scores.groupBy(*by, "y_score").agg(
        F.sum(w * F.col("y_true")).alias("pos"), F.sum(w * (1 - F.col("y_true"))).alias("neg")
    )
    return running_totals(merged, by, [F.col("y_score").desc()], {"tp": "pos", "fp": "neg"})


def auc_metrics(scores: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Step-wise average precision and rank AUC (ties half); null without both classes."""
    c = ranked_counts(scores, by, weight)
    agg = c.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))).alias("_ap"),
        F.sum((F.col("pos") * (F.col("neg") / 2 - F.col("fp"))).cast("double")).alias("_below"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return agg.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(both, F.col("_ap") / F.col("n_pos")).alias("pr_auc"),
        F.when(both, (F.col("_below") + pairs) / pairs).alias("roc_auc"),
    )


def confusion(scores: DataFrame, by: Sequence[str], threshold: float | Column, weight: Column | None = None) -> DataFrame:
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    w = F.lit(1) if weight is None else weight
    hit, real = F.col("y_score") >= t, F.col("y_true") == 1

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0))

    cells = [
        total(~hit & ~real).alias("tn"),
        total(hit & ~real).alias("fp"),
        total(~hit & real).alias("fn"),
        total(hit & real).alias("tp"),
    ]
    return scores.groupBy(*by).agg(*cells) if by else scores.agg(*cells)


def holdout_metrics(conf: DataFrame) -> DataFrame:
    """Rates of a confusion row; a rate without rows is 0."""
    out = conf.withColumns(
        {
            "tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0),
            "tnr": ratio(F.col("tn"), F.col("tn") + F.col("fp"), 0.0),
        }
    )
    out = out.withColumn("balanced_accuracy", (F.col("tpr") + F.col("tnr")) / 2)
    return out.withColumns(
        {
            "ber_percent": 100 * (1 - F.col("balanced_accuracy")),
            "true_positive_percent": 100 * F.col("tpr"),
            "true_negative_percent": 100 * F.col("tnr"),
        }
    )


def catch_overkill(conf: DataFrame) -> DataFrame:
    """Confusion row in the words of the line: catch, overkill, precision and the raw counts."""
    rest = [c for c in conf.columns if c not in ("tn", "fp", "fn", "tp")]
    fails, goods = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return conf.select(
        *rest,
        ratio(F.col("tp"), fails, 0.0).alias("catch_rate"),
        ratio(F.col("fp"), goods, 0.0).alias("overkill_rate"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"),
        F.col("tp").alias("fails_caught"),
        fails.alias("fails_total"),
        F.col("fp").alias("good_flagged"),
        goods.alias("good_total"),
    )


def fbeta(conf: DataFrame, beta: float) -> DataFrame:
    b2 = float(beta) ** 2
    rest = [c for c in conf.columns if c not in ("tn", "fp", "fn", "tp")]
    den = (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")
    return conf.select(*rest, ratio((1 + b2) * F.col("tp"), den, 0.0).alias("fbeta"))


def pr_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision and recall at each distinct score, the end point (0, 1), and the prevalence."""
    c = ranked_counts(scores, by)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    base = (F.col("_p") / (F.col("_p") + F.col("_n"))).alias("baseline")
    points = join_keys(c, totals, by).select(
        *by,
        F.col("y_score").alias("threshold"),
        ratio(F.col("tp"), F.col("_p"), 1.0).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        base,
    )
    ends = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), base
    )
    return points.unionByName(ends)


def pr_point(scores: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    conf = confusion(scores, by, threshold)
    return conf.select(
        *by,
        ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"),
    )


def pr_curve_payload(cv: DataFrame, holdout: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Cross-validation curve, holdout curve and the decision point of the holdout, tagged."""
    cols = [*by, "curve", "threshold", "recall", "precision", "baseline"]
    point = pr_point(holdout, by, threshold).select(
        *by, F.lit("point").alias("curve"), F.lit(float(threshold)).alias("threshold"), "recall", "precision",
        F.lit(None).cast("double").alias("baseline"),
    )
    parts = [pr_curve(d, by).withColumn("curve", F.lit(tag)).select(cols) for tag, d in (("cv", cv), ("holdout", holdout))]
    return parts[0].unionByName(parts[1]).unionByName(point.select(cols))


def _score_cells(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    clipped = scores.withColumn("y_score", F.greatest(F.least("y_score", F.lit(1.0)), F.lit(0.0)))
    return clipped.groupBy(*by, "y_score").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))


def _curve_at(cells: DataFrame, grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates at the scores of `grid`, and at 0 and 1, from the counts per distinct score."""
    zero = F.lit(0).cast("long")
    ends = cells.select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("y_score"))
    wanted = grid.select(*by, "y_score").unionByName(ends).select(*by, "y_score", zero.alias("pos"), zero.alias("neg"), F.lit(1).alias("_g"))
    both = cells.withColumn("_g", F.lit(0)).unionByName(wanted).groupBy(*by, "y_score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("_g").alias("_g")
    )
    run = running_totals(both, by, [F.col("y_score").desc()], {"tp": "pos", "fp": "neg"})
    totals = cells.groupBy(*by).agg(
        F.greatest(F.sum("pos"), F.lit(1)).alias("_p"), F.greatest(F.sum("neg"), F.lit(1)).alias("_n")
    )
    return join_keys(run.where("_g = 1"), totals, by).select(
        *by,
        F.col("y_score").alias("threshold"),
        (F.col("tp") / F.col("_p")).alias("tpr"),
        (F.col("fp") / F.col("_n")).alias("fpr"),
    )


def operating_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Catch and overkill at each distinct score clipped to [0, 1] and at 0 and 1."""
    cells = _score_cells(scores, by)
    return _curve_at(cells, cells, by)


def thinned_curve(scores: DataFrame, by: Sequence[str], points: int) -> DataFrame:
    """The operating curve read at `points` quantiles of the distinct scores, for drawing."""
    cells = _score_cells(scores, by)
    q = exact_quantile_array(cells, by, "y_score", [i / (points - 1) for i in range(points)], "_q")
    return _curve_at(cells, q.select(*by, F.explode("_q").alias("y_score")), by)


def calibration_bins(scores: DataFrame, by: Sequence[str], bins: int = 5) -> DataFrame:
    """Mean predicted against observed rate in quantile bins; empty bins do not appear."""
    edges = exact_quantile_array(scores, by, "y_score", [i / bins for i in range(1, bins)], "_edges")
    bin_no = F.size(F.filter("_edges", lambda e: e < F.col("y_score")))
    return (
        join_keys(scores, edges, by)
        .groupBy(*by, bin_no.alias("bin"))
        .agg(F.avg("y_score").alias("mean_predicted"), F.avg(F.col("y_true").cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))
    )


def brier_score(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    d = F.col("y_score") - F.col("y_true")
    return scores.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def outcome(actual: Column, predicted: Column) -> Column:
    return (
        F.when((actual == 1) & (predicted == 1), "caught_fail")
        .when(actual == 1, "missed_fail")
        .when(predicted == 1, "false_alarm")
        .otherwise("correct_pass")
    )


def outcome_labels(scores: DataFrame, threshold: float | Column) -> DataFrame:
    out = threshold_predict(scores, threshold)
    return out.withColumn("outcome", outcome(F.col("y_true"), F.col("y_pred")))


# Errors come first, the costly one before the cheap one.
OUTCOME_ORDER = {"missed_fail": 0, "false_alarm": 1, "caught_fail": 2, "correct_pass": 3}


def outcome_rank(c: Column) -> Column:
    rank = F.lit(len(OUTCOME_ORDER))
    for name, place in OUTCOME_ORDER.items():
        rank = F.when(c == name, place).otherwise(rank)
    return rank


def bootstrap_metrics(
    scores: DataFrame,
    by: Sequence[str],
    threshold: float | Column,
    n_boot: int = 1000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Median and percentile interval of PR-AUC, ROC-AUC and BER over stratified draws.

    A key with only one class gives nulls. `threshold` may be a column of `scores` that is constant within a key.
    """
    draws = draw_metrics(scores, by, threshold, n_boot, seed)
    found = interval(draws, by, ("pr_auc", "roc_auc", "ber_percent"), level)
    return scores.select(*by).distinct().join(found, list(by), "left")


def fold_metrics(scores: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The five metrics of each (key, fold)."""
    return auc_metrics(scores, by).drop("n_pos", "n_neg").join(
        holdout_metrics(confusion(scores, by, threshold)).drop("tn", "fp", "fn", "tp"), list(by)
    )


def cv_leaderboard(folds: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Mean and population SD over folds; rates in percent."""
    cols = {
        "ber_percent": 100 * (1 - F.col("balanced_accuracy")),
        "true_positive_percent": 100 * F.col("tpr"),
        "true_negative_percent": 100 * F.col("tnr"),
        "roc_auc": F.col("roc_auc"),
        "pr_auc": F.col("pr_auc"),
    }
    return folds.groupBy(*by).agg(
        *[f(c).alias(f"{p}_{n}") for n, c in cols.items() for p, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def profile_rows(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Confusion and rates per (key, threshold profile); `thresholds` is `(keys, profile, threshold)`.

    The profiles of a key are few, so each score row meets at most that many thresholds.
    """
    joined = join_keys(scores, thresholds, by)
    keys = [*by, "profile", "threshold"]
    return holdout_metrics(confusion(joined, keys, F.col("threshold")))


def holdout_benchmark(
    scores: DataFrame, thresholds: DataFrame, n_boot: int = 1000, by: Sequence[str] = ("pipeline",), seed: int = 42
) -> DataFrame:
    """One row per key: AUCs, metrics at each profile, metrics and intervals (unless `n_boot` is 0) at the default one."""
    by = list(by)
    rows = profile_rows(scores, thresholds, by)
    per_profile = rows.groupBy(*by).pivot("profile", list(PROFILES)).agg(
        F.first("threshold").alias("threshold"),
        F.first("ber_percent").alias("ber_percent"),
        F.first("true_positive_percent").alias("true_positive_percent"),
        F.first("true_negative_percent").alias("true_negative_percent"),
        F.first(F.array(F.array("tn", "fp"), F.array("fn", "tp"))).alias("confusion_matrix"),
    )
    default = thresholds.where("profile = 'ber'").select(*by, F.col("threshold").alias("_t"))
    base = join_keys(scores, default, by, "left").withColumn("_t", F.coalesce("_t", F.lit(0.5)))
    at_default = holdout_metrics(confusion(base, by, F.col("_t"))).select(
        *by, "ber_percent", "true_positive_percent", "true_negative_percent",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )
    rows = auc_metrics(scores, by).select(*by, "pr_auc", "roc_auc").join(at_default, by).join(per_profile, by, "left")
    return rows.join(bootstrap_metrics(base, by, F.col("_t"), n_boot, seed=seed), by, "left") if n_boot else rows


def auc_summary(holdout: DataFrame) -> DataFrame:
    names = ["pr_auc", "pr_auc_ci_low", "pr_auc_ci_high", "roc_auc", "roc_auc_ci_low", "roc_auc_ci_high"]
    return holdout.select("pipeline", *[F.bround(n, 3).alias(n) for n in names])


def _cell(name: str, i: int, j: int) -> Column:
    return F.col(name)[i][j]


def confusion_by_profile(holdout: DataFrame) -> DataFrame:
    """Long `(pipeline, profile, tn, fp, fn, tp)` from the wide benchmark row."""
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("profile"),
                F.col(f"{p}_threshold").alias("threshold"),
                F.col(f"{p}_ber_percent").alias("ber_percent"),
                *[_cell(f"{p}_confusion_matrix", i, j).alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))],
            )
            for p in PROFILES
        ]
    )
    return holdout.select("pipeline", F.inline(rows))


def operating_table(holdout: DataFrame) -> DataFrame:
    """One row per (pipeline, profile) as shown to an engineer."""
    rows = catch_overkill(confusion_by_profile(holdout)).where("threshold is not null or ber_percent is not null")

    def pct(c: str) -> Column:
        return F.bround(100 * F.col(c), 1)

    return rows.select(
        "pipeline",
        "profile",
        F.bround("threshold", 4).alias("threshold"),
        pct("catch_rate").alias("catch_pct"),
        pct("overkill_rate").alias("overkill_pct"),
        pct("precision").alias("precision_pct"),
        F.concat_ws("/", F.col("fails_caught").cast("string"), F.col("fails_total").cast("string")).alias("fails_caught"),
        F.concat_ws("/", F.col("good_flagged").cast("string"), F.col("good_total").cast("string")).alias("good_flagged"),
        F.bround("ber_percent", 1).alias("ber_pct"),
    )
