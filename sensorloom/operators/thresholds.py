"""Decision thresholds: sweep over a fixed grid, BER band, cost optimum, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import join_keys
from .metrics import PROFILES, confusion, holdout_metrics, operating_curve

# The threshold grid, the band width in BER points, the cost of an escape in overkills.
GRID_LOW, GRID_HIGH, GRID_SIZE = 0.0001, 0.2, 3000
BAND_POINTS = 2.0
COST_RATIO = 20.0
# The profile each track is deployed at.
DEPLOY_PROFILE = {"interpolation": "ber", "extrapolation": "economic"}


def grid_value(i: Column) -> Column:
    step = (GRID_HIGH - GRID_LOW) / (GRID_SIZE - 1)
    return F.when(i == GRID_SIZE - 1, F.lit(GRID_HIGH)).otherwise(i * F.lit(step) + F.lit(GRID_LOW))


def grid_index(score: Column) -> Column:
    """Largest grid place whose threshold is <= score, -1 below the grid.

    Division gives the place up to one; comparing with the grid values themselves settles it.
    """
    step = (GRID_HIGH - GRID_LOW) / (GRID_SIZE - 1)
    guess = F.greatest(F.least(F.floor((score - GRID_LOW) / step), F.lit(GRID_SIZE - 1)), F.lit(-1)).cast("int")
    up = (guess < GRID_SIZE - 1) & (grid_value(guess + 1) <= score)
    down = (guess >= 0) & (grid_value(guess) > score)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def fold_sweep(scores: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """BER, TPR per (key, fold, threshold) for the whole grid.

    Scores shrink to counts per grid place first; each key and fold then has exactly
    GRID_SIZE + 1 places, which one window sums.
    """
    keys = [*by, fold]
    counts = scores.groupBy(*keys, grid_index(F.col("y_score")).alias("i")).agg(
        F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg")
    )
    full = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    grid = full.select("*", F.explode(F.sequence(F.lit(-1), F.lit(GRID_SIZE - 1))).alias("i"))
    w = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    swept = grid.join(counts, [*keys, "i"], "left").select(
        *keys, "i", "p", "n",
        F.sum(F.coalesce("pos", zero)).over(w).alias("tp"),
        F.sum(F.coalesce("neg", zero)).over(w).alias("fp"),
    )
    return holdout_metrics(
        swept.where("i >= 0").select(
            *keys, grid_value(F.col("i")).alias("threshold"), (F.col("n") - F.col("fp")).alias("tn"), "fp",
            (F.col("p") - F.col("tp")).alias("fn"), "tp",
        )
    )


def threshold_sweep(scores: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean over folds of BER % and TPR % at each grid threshold."""
    return fold_sweep(scores, by, fold).groupBy(*by, "threshold").agg(
        F.avg("ber_percent").alias("mean_ber_percent"), F.avg("true_positive_percent").alias("mean_tpr_percent")
    )


def ber_band(sweep: DataFrame, by: Sequence[str], tolerance: float = BAND_POINTS) -> DataFrame:
    """Thresholds of the BER minimum (lowest on a tie) and of both ends of the band around it.

    Only thresholds that catch something count, unless none does. Mean BERs that differ by less
    than 1e-9 are ties: the last bits of a mean depend on the order of its terms.
    """
    sweep = sweep.withColumn("mean_ber_percent", F.round("mean_ber_percent", 9))
    caught = sweep.groupBy(*by).agg(F.max((F.col("mean_tpr_percent") > 0).cast("int")).alias("_any"))
    pool = sweep.join(caught, list(by)).where((F.col("_any") == 0) | (F.col("mean_tpr_percent") > 0))
    best = pool.groupBy(*by).agg(
        F.min_by("threshold", F.struct("mean_ber_percent", "threshold")).alias("ber"),
        F.min("mean_ber_percent").alias("_min"),
    )
    inside = pool.join(best, list(by)).where(F.col("mean_ber_percent") <= F.col("_min") + tolerance)
    return inside.groupBy(*by).agg(
        F.max("threshold").alias("conservative"), F.min("ber").alias("ber"), F.min("threshold").alias("aggressive")
    )


def expected_cost(prevalence: Column, tpr: Column, tnr: Column, cost_ratio: float = COST_RATIO) -> Column:
    return F.lit(float(cost_ratio)) * prevalence * (1 - tpr) + (1 - prevalence) * (1 - tnr)


def cost_optimal(rates: DataFrame, by: Sequence[str], cost_ratio: float = COST_RATIO) -> DataFrame:
    """Cheapest threshold of `(keys, threshold, tpr, tnr, prevalence)`; the lowest on a tie."""
    cost = rates.withColumn("cost", expected_cost(F.col("prevalence"), F.col("tpr"), F.col("tnr"), cost_ratio))
    least = cost.groupBy(*by).agg(F.min("cost").alias("min_cost")) if by else cost.agg(F.min("cost").alias("min_cost"))
    tied = (cost.join(least, list(by)) if by else cost.crossJoin(least)).where(F.col("cost") <= F.col("min_cost") + 1e-12)
    return tied.groupBy(*by).agg(F.min("threshold").alias("economic"), F.min("min_cost").alias("min_cost"))


def sweep_rates(sweep: DataFrame, prevalence: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates as fractions; the TNR follows from BER and TPR."""
    return sweep.join(prevalence, list(by)).select(
        *by,
        "threshold",
        (F.col("mean_tpr_percent") / 100).alias("tpr"),
        ((2 * (100 - F.col("mean_ber_percent")) - F.col("mean_tpr_percent")) / 100).alias("tnr"),
        "prevalence",
    )


def prevalence_of(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(F.col("y_true").cast("double")).alias("prevalence"))


def threshold_profiles(scores: DataFrame, by: Sequence[str] = ("pipeline",), fold: str = "fold") -> DataFrame:
    """Long `(keys, profile, threshold)` of the four profiles from out-of-fold scores."""
    sweep = threshold_sweep(scores, by, fold)
    econ = cost_optimal(sweep_rates(sweep, prevalence_of(scores, by), by), by)
    wide = ber_band(sweep, by).join(econ, list(by))
    return wide.unpivot(list(by), list(PROFILES), "profile", "threshold")


def profile_at_threshold(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("pipeline",), fold: str = "fold") -> DataFrame:
    """Mean and population SD over folds of the rates at each profile's threshold."""
    keys = [*by, "profile", "threshold"]
    rates = holdout_metrics(confusion(join_keys(scores, thresholds, by), [*keys, fold], F.col("threshold")))
    return rates.groupBy(*keys).agg(
        F.avg("ber_percent").alias("mean_ber_percent"),
        F.stddev_pop("ber_percent").alias("std_ber_percent"),
        F.avg("true_positive_percent").alias("mean_true_positive_percent"),
        F.avg("true_negative_percent").alias("mean_true_negative_percent"),
    )


def expected_cost_curve(scores: DataFrame, by: Sequence[str], cost_ratio: float = COST_RATIO) -> DataFrame:
    """Cost at each distinct score; `is_minimum` marks the cheapest, the lowest on a tie."""
    curve = join_keys(operating_curve(scores, by), prevalence_of(scores, by), by)
    cost = curve.select(*by, "threshold", expected_cost(F.col("prevalence"), F.col("tpr"), 1 - F.col("fpr"), cost_ratio).alias("cost"))
    best = cost.groupBy(*by).agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("_best"))
    return join_keys(cost, best, by).select(*by, "threshold", "cost", (F.col("threshold") == F.col("_best")).alias("is_minimum"))


def resolve_thresholds(stored: DataFrame, pipelines: DataFrame, tracks: Mapping[str, str] = DEPLOY_PROFILE) -> DataFrame:
    """Deployed threshold per (pipeline, track): the track's profile, else `ber`, else 0.5."""
    known = stored.where(F.col("profile").isin(*PROFILES) & F.col("threshold").isNotNull())
    wide = known.groupBy("pipeline").pivot("profile", list(PROFILES)).agg(F.first("threshold"))
    deploy = F.array(*[F.struct(F.lit(t).alias("track"), F.col(p).alias("_t")) for t, p in tracks.items()])
    rows = pipelines.join(wide, "pipeline", "left").select("pipeline", "ber", F.inline(deploy))
    return rows.select("pipeline", "track", F.coalesce("_t", "ber", F.lit(0.5)).alias("threshold"))
