"""Metrics, thresholds, costs and the result tables built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import metrics, reporting, thresholds
from ..sources import fixtures as fx
from . import sql
from .catalog import query
from .sql import EVENT_SCORES, SCORES, with_

BY = ["pipeline"]

CONF = "conf as (select pipeline, count(*) filter (y_score < 0.1 and y_true = 0) as tn, count(*) filter (y_score >= 0.1 and y_true = 0) as fp, count(*) filter (y_score < 0.1 and y_true = 1) as fn, count(*) filter (y_score >= 0.1 and y_true = 1) as tp from scores group by pipeline)"
RATES = "rates as (select *, coalesce(tp / nullif(tp + fn, 0)::double, 0) as tpr, coalesce(tn / nullif(tn + fp, 0)::double, 0) as tnr from conf)"

# by definition: pair counting, and precision at the score of each positive
AUC = (
    """auc as (select a.pipeline, avg(case when a.y_score > b.y_score then 1.0 when a.y_score = b.y_score then 0.5 else 0.0 end) as roc_auc
       from scores a join scores b on a.pipeline = b.pipeline and a.y_true = 1 and b.y_true = 0 group by a.pipeline)""",
    """ap as (select pipeline, avg(precision_) as pr_auc from (
         select a.pipeline, a.id, sum(b.y_true)::double / count(*) as precision_ from scores a join scores b on a.pipeline = b.pipeline and a.y_true = 1 and b.y_score >= a.y_score
         group by 1, 2) group by pipeline)""",
)
RANKED = (
    "merged as (select pipeline, y_score, sum(y_true) as pos, sum(1 - y_true) as neg from scores group by 1, 2)",
    """ranked as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by pipeline) as p, sum(neg) over (partition by pipeline) as n
       from merged window w as (partition by pipeline order by y_score desc rows unbounded preceding))""",
)


def _scores(spark, sf):
    return fx.label_scores(spark, sf)


def _round(df, *skip):
    return df.withColumns({c: r6(c) for c, t in df.dtypes if t == "double" and c not in skip})


@query("threshold_predict", with_(SCORES, final="select pipeline, id, case when y_score >= 0.1 then 1 else 0 end as y_pred from scores"))
def _(spark, sf):
    return metrics.threshold_predict(_scores(spark, sf), 0.1).select("pipeline", "id", "y_pred")


@query("confusion", with_(SCORES, CONF, final="select * from conf"))
def _(spark, sf):
    return metrics.confusion(_scores(spark, sf), BY, 0.1).select("pipeline", *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])


def _conf(spark, sf):
    return metrics.confusion(_scores(spark, sf), BY, 0.1).select("pipeline", *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])


@query("holdout_metrics", with_(SCORES, CONF, RATES, final=f"""select pipeline, {sql.r6('tpr')} as tpr, {sql.r6('tnr')} as tnr, {sql.r6('(tpr + tnr) / 2')} as balanced_accuracy,
   {sql.r6('100 * (1 - (tpr + tnr) / 2)')} as ber_percent, {sql.r6('100 * tpr')} as true_positive_percent, {sql.r6('100 * tnr')} as true_negative_percent from rates"""))
def _(spark, sf):
    return _round(metrics.holdout_metrics(_conf(spark, sf)).drop("tn", "fp", "fn", "tp"))


@query("average_precision", with_(SCORES, *AUC, final=f"select pipeline, {sql.r6('pr_auc')} as pr_auc from ap"))
def _(spark, sf):
    return _round(metrics.auc_metrics(_scores(spark, sf), BY).select("pipeline", "pr_auc"))


@query("roc_auc", with_(SCORES, *AUC, final=f"select pipeline, {sql.r6('roc_auc')} as roc_auc from auc"))
def _(spark, sf):
    return _round(metrics.auc_metrics(_scores(spark, sf), BY).select("pipeline", "roc_auc"))


E_RANKED = (
    "merged as (select y_score, sum(y_true) as pos, sum(1 - y_true) as neg from scores group by 1)",
    "ranked as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from merged window w as (order by y_score desc rows unbounded preceding))",
)


@query("auc_metrics_events", with_(EVENT_SCORES, *E_RANKED, final=f"select min(p)::bigint as n_pos, min(n)::bigint as n_neg, {sql.r6('sum(pos * tp::double / (tp + fp)) / min(p)')} as pr_auc, {sql.r6('sum(pos * (n - fp + neg / cast(2 as double))) / (min(p)::double * min(n))')} as roc_auc from ranked"))
def _(spark, sf):
    s = fx.event_scores(spark, sf).withColumn("pipeline", F.lit("events"))
    return _round(metrics.auc_metrics(s, BY).drop("pipeline"))


PR = """pr as (select pipeline, y_score as threshold, tp / nullif(p, 0)::double as recall, tp / (tp + fp)::double as precision, p / (p + n)::double as baseline from ranked
   union all select distinct pipeline, null, cast(0 as double), cast(1 as double), p / (p + n)::double from ranked)"""


@query("pr_curve", with_(SCORES, *RANKED, PR, final="select pipeline, " + ", ".join(f"{sql.r6(c)} as {c}" for c in ("threshold", "recall", "precision", "baseline")) + " from pr"))
def _(spark, sf):
    return _round(metrics.pr_curve(_scores(spark, sf), BY))


@query("pr_point", with_(SCORES, CONF, final=f"select pipeline, {sql.r6('tp / (tp + fn)::double')} as recall, {sql.r6('coalesce(tp / nullif(tp + fp, 0)::double, 0)')} as precision from conf"))
def _(spark, sf):
    return _round(metrics.pr_point(_scores(spark, sf), BY, 0.1))


def _pr_sql(scores: str, tag: str) -> tuple[str, ...]:
    return (
        f"m_{tag} as (select pipeline, y_score, sum(y_true) as pos, sum(1 - y_true) as neg from scores where {scores} group by 1, 2)",
        f"""r_{tag} as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by pipeline) as p, sum(neg) over (partition by pipeline) as n
           from m_{tag} window w as (partition by pipeline order by y_score desc rows unbounded preceding))""",
        f"""c_{tag} as (select pipeline, '{tag}' as curve, y_score as threshold, tp / nullif(p, 0)::double as recall, tp / (tp + fp)::double as precision, p / (p + n)::double as baseline from r_{tag}
           union all select distinct pipeline, '{tag}', null, cast(0 as double), cast(1 as double), p / (p + n)::double from r_{tag})""",
    )


@query("pr_curve_payload", with_(SCORES, *_pr_sql("fold < 4", "cv"), *_pr_sql("fold = 4", "holdout"),
    """c_point as (select pipeline, 'point' as curve, cast(0.1 as double) as threshold, sum(y_true) filter (y_score >= 0.1) / sum(y_true)::double as recall,
       sum(y_true) filter (y_score >= 0.1) / (count(*) filter (y_score >= 0.1))::double as precision, null::double as baseline from scores where fold = 4 group by pipeline)""",
    final="select pipeline, curve, " + ", ".join(f"{sql.r6(c)} as {c}" for c in ("threshold", "recall", "precision", "baseline")) + " from (select * from c_cv union all select * from c_holdout union all select * from c_point)"))
def _(spark, sf):
    s = _scores(spark, sf)
    return _round(metrics.pr_curve_payload(s.where("fold < 4"), s.where("fold = 4"), BY, 0.1))


@query("fbeta", with_(SCORES, CONF, final=f"select pipeline, {sql.r6('5 * tp / (5 * tp + 4 * fn + fp)::double')} as fbeta from conf"))
def _(spark, sf):
    return _round(metrics.fbeta(_conf(spark, sf), 2.0))


@query("catch_overkill", with_(SCORES, CONF, final=f"select pipeline, {sql.r6('tp / (tp + fn)::double')} as catch_rate, {sql.r6('fp / (tn + fp)::double')} as overkill_rate, {sql.r6('tp / (tp + fp)::double')} as precision, tp as fails_caught, tp + fn as fails_total, fp as good_flagged, tn + fp as good_total from conf"))
def _(spark, sf):
    return _round(metrics.catch_overkill(_conf(spark, sf)))


def _curve_sql(points: int | None = None) -> tuple[str, ...]:
    read = "select pipeline, s as t from distinct_"
    if points:
        read = f"select pipeline, unnest(quantile_cont(s, [{', '.join(repr(i / (points - 1)) for i in range(points))}])) as t from distinct_ group by pipeline"
    return (
        "clipped as (select *, greatest(least(y_score, 1), 0) as s from scores)",
        "distinct_ as (select distinct pipeline, s from clipped)",
        f"grid as ({read} union select pipeline, unnest([0.0::double, 1.0::double]) from (select distinct pipeline from scores))",
        """curve as (select g.pipeline, g.t as threshold, count(*) filter (c.y_true = 1 and c.s >= g.t) / greatest(count(*) filter (c.y_true = 1), 1)::double as tpr,
             count(*) filter (c.y_true = 0 and c.s >= g.t) / greatest(count(*) filter (c.y_true = 0), 1)::double as fpr
           from grid g join clipped c using (pipeline) group by 1, 2)""",
    )


@query("operating_curve", with_(SCORES, *_curve_sql(), final=f"select pipeline, {sql.r6('threshold')} as threshold, {sql.r6('tpr')} as tpr, {sql.r6('fpr')} as fpr from curve"))
def _(spark, sf):
    return _round(metrics.operating_curve(_scores(spark, sf), BY))


@query("operating_curve_capped", with_(SCORES, *_curve_sql(40), final=f"select pipeline, {sql.r6('threshold')} as threshold, {sql.r6('tpr')} as tpr, {sql.r6('fpr')} as fpr from curve"))
def _(spark, sf):
    return _round(metrics.thinned_curve(_scores(spark, sf), BY, 40))


@query("calibration_bins", with_(SCORES, "edges as (select pipeline, quantile_cont(y_score, [0.2, 0.4, 0.6, 0.8]) as e from scores group by 1)",
    final=f"select pipeline, (y_score > e[1])::int + (y_score > e[2])::int + (y_score > e[3])::int + (y_score > e[4])::int as bin, {sql.r6('avg(y_score)')} as mean_predicted, {sql.r6('avg(y_true)')} as observed, count(*) as n from scores join edges using (pipeline) group by 1, 2"))
def _(spark, sf):
    return _round(metrics.calibration_bins(_scores(spark, sf), BY))


@query("brier_score", with_(SCORES, final=f"select pipeline, {sql.r6('avg((y_score - y_true) * (y_score - y_true))')} as brier from scores group by 1"))
def _(spark, sf):
    return _round(metrics.brier_score(_scores(spark, sf), BY))


OUTCOME = "case when y_true = 1 and y_score >= 0.1 then 'caught_fail' when y_true = 1 then 'missed_fail' when y_score >= 0.1 then 'false_alarm' else 'correct_pass' end"


@query("outcome_labels", with_(SCORES, final=f"select pipeline, id, {OUTCOME} as outcome from scores"))
def _(spark, sf):
    return metrics.outcome_labels(_scores(spark, sf), 0.1).select("pipeline", "id", "outcome")


# --- folds -------------------------------------------------------------------------------------

FOLD = (
    """fold_auc as (select a.pipeline, a.fold, avg(case when a.y_score > b.y_score then 1.0 when a.y_score = b.y_score then 0.5 else 0.0 end) as roc_auc
       from scores a join scores b on a.pipeline = b.pipeline and a.fold = b.fold and a.y_true = 1 and b.y_true = 0 group by 1, 2)""",
    """fold_ap as (select pipeline, fold, avg(precision_) as pr_auc from (
         select a.pipeline, a.fold, a.id, sum(b.y_true)::double / count(*) as precision_ from scores a join scores b on a.pipeline = b.pipeline and a.fold = b.fold and a.y_true = 1 and b.y_score >= a.y_score
         group by 1, 2, 3) group by 1, 2)""",
    """fold_conf as (select pipeline, fold, avg((y_score >= 0.1)::int) filter (y_true = 1) as tpr, avg((y_score < 0.1)::int) filter (y_true = 0) as tnr from scores group by 1, 2)""",
    """folds as (select pipeline, fold, pr_auc, roc_auc, tpr, tnr, (tpr + tnr) / 2 as balanced_accuracy, 100 * (1 - (tpr + tnr) / 2) as ber_percent, 100 * tpr as true_positive_percent, 100 * tnr as true_negative_percent
       from fold_auc join fold_ap using (pipeline, fold) join fold_conf using (pipeline, fold))""",
)
FOLD_COLS = ("pr_auc", "roc_auc", "tpr", "tnr", "balanced_accuracy", "ber_percent", "true_positive_percent", "true_negative_percent")


def _folds(spark, sf):
    return metrics.fold_metrics(_scores(spark, sf), ["pipeline", "fold"], 0.1)


@query("fold_metrics", with_(SCORES, *FOLD, final="select pipeline, fold, " + ", ".join(f"{sql.r6(c)} as {c}" for c in FOLD_COLS) + " from folds"))
def _(spark, sf):
    return _round(_folds(spark, sf))


LEAD = ("ber_percent", "true_positive_percent", "true_negative_percent", "roc_auc", "pr_auc")
CV = "cv as (select pipeline, " + ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in LEAD) + " from folds group by pipeline)"


@query("cv_leaderboard", with_(SCORES, *FOLD, CV, final="select pipeline, " + ", ".join(f"{sql.r6(f'{p}_{c}')} as {p}_{c}" for c in LEAD for p in ("mean", "std")) + " from cv"))
def _(spark, sf):
    return _round(metrics.cv_leaderboard(_folds(spark, sf)))


# --- thresholds --------------------------------------------------------------------------------

STEP = (thresholds.GRID_HIGH - thresholds.GRID_LOW) / (thresholds.GRID_SIZE - 1)
GRID = f"grid as (select case when i = 2999 then cast(0.2 as double) else i * cast({STEP!r} as double) + cast(0.0001 as double) end as threshold from generate_series(0, 2999) g(i))"
SWEEP = (
    GRID,
    """fold_rates as (select pipeline, fold, threshold, coalesce(count(*) filter (y_true = 1 and y_score >= threshold) / nullif(count(*) filter (y_true = 1), 0)::double, 0) as tpr,
         coalesce(count(*) filter (y_true = 0 and y_score < threshold) / nullif(count(*) filter (y_true = 0), 0)::double, 0) as tnr from scores, grid group by 1, 2, 3)""",
    "sweep as (select pipeline, threshold, avg(100 * (1 - (tpr + tnr) / 2)) as mean_ber_percent, avg(100 * tpr) as mean_tpr_percent from fold_rates group by 1, 2)",
)


@query("threshold_sweep", with_(SCORES, *SWEEP, final=f"select pipeline, {sql.r6('threshold', 9)} as threshold, {sql.r6('mean_ber_percent')} as mean_ber_percent, {sql.r6('mean_tpr_percent')} as mean_tpr_percent from sweep"))
def _(spark, sf):
    out = thresholds.threshold_sweep(_scores(spark, sf), BY)
    return _round(out, "threshold").withColumn("threshold", r6("threshold", 9))


BAND = (
    "pool as (select pipeline, threshold, round(mean_ber_percent, 9) as mean_ber_percent from sweep s where mean_tpr_percent > 0 or not exists (select 1 from sweep z where z.pipeline = s.pipeline and z.mean_tpr_percent > 0))",
    "best as (select pipeline, min(mean_ber_percent) as m from pool group by 1)",
    "bermin as (select pipeline, min(threshold) as ber from pool join best using (pipeline) where mean_ber_percent = m group by 1)",
    "band as (select pipeline, max(threshold) as conservative, min(threshold) as aggressive from pool join best using (pipeline) where mean_ber_percent <= m + 2 group by 1)",
)
# thresholds of equal mean BER differ in the last bits of an average: compare what they decide
PREV = "prev as (select pipeline, avg(y_true) as prevalence from scores group by 1)"
COST = (
    PREV,
    """costs as (select pipeline, threshold, 20 * prevalence * (1 - mean_tpr_percent / 100) + (1 - prevalence) * (1 - (2 * (100 - mean_ber_percent) - mean_tpr_percent) / 100) as cost from sweep join prev using (pipeline))""",
    "econ as (select pipeline, min(threshold) as economic, min(m) as min_cost from costs join (select pipeline, min(cost) as m from costs group by 1) using (pipeline) where cost <= m + 1e-12 group by 1)",
)


@query("ber_band", with_(SCORES, *SWEEP, *BAND, final=f"select pipeline, {sql.r6('conservative')} as conservative, {sql.r6('ber')} as ber, {sql.r6('aggressive')} as aggressive from bermin join band using (pipeline)"))
def _(spark, sf):
    return _round(thresholds.ber_band(thresholds.threshold_sweep(_scores(spark, sf), BY), BY))


@query("cost_optimal_threshold", with_(SCORES, *SWEEP, *COST, final=f"select pipeline, {sql.r6('economic')} as economic, {sql.r6('min_cost')} as min_cost from econ"))
def _(spark, sf):
    s = _scores(spark, sf)
    rates = thresholds.sweep_rates(thresholds.threshold_sweep(s, BY), thresholds.prevalence_of(s, BY), BY)
    return _round(thresholds.cost_optimal(rates, BY))


PROFILES = "profiles as (unpivot (select pipeline, conservative, ber, aggressive, economic from bermin join band using (pipeline) join econ using (pipeline)) on conservative, ber, aggressive, economic into name profile value threshold)"


def _profiles(spark, sf):
    return thresholds.threshold_profiles(_scores(spark, sf))


@query("threshold_profiles", with_(SCORES, *SWEEP, *BAND, *COST, PROFILES, final=f"select pipeline, profile, {sql.r6('threshold')} as threshold from profiles"))
def _(spark, sf):
    return _round(_profiles(spark, sf))


@query("profile_at_threshold", with_(SCORES, *SWEEP, *BAND, *COST, PROFILES,
    "pf as (select pipeline, profile, threshold, fold, avg((y_score >= threshold)::int) filter (y_true = 1) as tpr, avg((y_score < threshold)::int) filter (y_true = 0) as tnr from profiles join scores using (pipeline) group by all)",
    final=f"""select pipeline, profile, {sql.r6('threshold')} as threshold, {sql.r6('avg(100 * (1 - (tpr + tnr) / 2))')} as mean_ber_percent, {sql.r6('stddev_pop(100 * (1 - (tpr + tnr) / 2))')} as std_ber_percent,
      {sql.r6('avg(100 * tpr)')} as mean_true_positive_percent, {sql.r6('avg(100 * tnr)')} as mean_true_negative_percent from pf group by all"""))
def _(spark, sf):
    s = _scores(spark, sf)
    return _round(thresholds.profile_at_threshold(s, _profiles(spark, sf)))


@query("expected_cost_curve", with_(SCORES, *_curve_sql(), PREV,
    "cost as (select pipeline, threshold, 20 * prevalence * (1 - tpr) + (1 - prevalence) * (1 - (1 - fpr)) as cost from curve join prev using (pipeline))",
    final=f"select pipeline, {sql.r6('threshold')} as threshold, {sql.r6('cost')} as cost, row_number() over (partition by pipeline order by cost, threshold) = 1 as is_minimum from cost"))
def _(spark, sf):
    return _round(thresholds.expected_cost_curve(_scores(spark, sf), BY))


STORED = [("alpha", "ber", 0.11), ("alpha", "economic", 0.07), ("beta", "ber", 0.12), ("beta", "other", 0.5)]


def _stored(spark):
    return spark.createDataFrame(STORED, "pipeline string, profile string, threshold double")


@query("resolve_thresholds", with_(SCORES, sql.values(STORED, "stored", "pipeline, profile, threshold"),
    "known as (select pipeline, max(threshold) filter (profile = 'ber') as ber, max(threshold) filter (profile = 'economic') as economic from stored group by 1)",
    final="""select p.pipeline, t.track, coalesce(case when t.track = 'interpolation' then ber else economic end, ber, 0.5) as threshold
       from (select distinct pipeline from scores) p left join known using (pipeline), (values ('interpolation'), ('extrapolation')) t(track)"""))
def _(spark, sf):
    return thresholds.resolve_thresholds(_stored(spark), _scores(spark, sf).select("pipeline").distinct())


# --- holdout tables ----------------------------------------------------------------------------

P_ROWS = (
    "prof(pipeline, profile, threshold) as (select pipeline, profile, t from (select distinct pipeline from scores), (values ('conservative', cast(0.15 as double)), ('ber', cast(0.1 as double)), ('aggressive', cast(0.05 as double)), ('economic', cast(0.08 as double))) v(profile, t))",
    """pc as (select pipeline, profile, threshold, count(*) filter (y_score < threshold and y_true = 0) as tn, count(*) filter (y_score >= threshold and y_true = 0) as fp,
         count(*) filter (y_score < threshold and y_true = 1) as fn, count(*) filter (y_score >= threshold and y_true = 1) as tp from scores join prof using (pipeline) group by 1, 2, 3)""",
)


def _fixed_profiles(spark, sf):
    pairs = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(t).alias("threshold")) for p, t in (("conservative", 0.15), ("ber", 0.1), ("aggressive", 0.05), ("economic", 0.08))])
    return _scores(spark, sf).select("pipeline").distinct().select("pipeline", F.inline(pairs))


def _holdout(spark, sf, n_boot=1000):
    return metrics.holdout_benchmark(_scores(spark, sf), _fixed_profiles(spark, sf), n_boot)


def _profiles_only(spark, sf):
    """The benchmark rows without intervals, for tables that show none."""
    return _holdout(spark, sf, n_boot=0)


@query("confusion_by_profile", with_(SCORES, *P_ROWS, final="select pipeline, profile, tn, fp, fn, tp from pc"))
def _(spark, sf):
    out = metrics.confusion_by_profile(_profiles_only(spark, sf))
    return out.select("pipeline", "profile", *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])


@query("operating_table", with_(SCORES, *P_ROWS, final="""select pipeline, profile, round_even(threshold, 4) as threshold, round_even(100 * tp / (tp + fn)::double, 1) as catch_pct, round_even(100 * fp / (tn + fp)::double, 1) as overkill_pct,
     round_even(100 * coalesce(tp / nullif(tp + fp, 0)::double, 0), 1) as precision_pct, tp || '/' || (tp + fn) as fails_caught, fp || '/' || (tn + fp) as good_flagged,
     round_even(100 * (1 - (tp / (tp + fn)::double + tn / (tn + fp)::double) / 2), 1) as ber_pct from pc"""))
def _(spark, sf):
    return metrics.operating_table(_profiles_only(spark, sf))


BOOT_STATS = ("pr_auc", "roc_auc", "ber_percent")
HOLDOUT = (
    *P_ROWS, *AUC, "flagged as (select s.*, y_score >= threshold as hit from scores s join prof using (pipeline) where profile = 'ber')", *sql.bootstrap("flagged", 1000),
    "wide as (select pipeline, " + ", ".join(
        f"max(threshold) filter (profile = '{p}') as {p}_threshold, max(100 * (1 - (tp / (tp + fn)::double + tn / (tn + fp)::double) / 2)) filter (profile = '{p}') as {p}_ber_percent" for p in metrics.PROFILES) + " from pc group by pipeline)",
    f"bands as (select pipeline, {sql.intervals(BOOT_STATS)} from per_draw group by pipeline)",
)
BANDS = [f"{s}_{t}" for s in BOOT_STATS for t in ("median", "ci_low", "ci_high")]


@query("holdout_benchmark", with_(SCORES, *HOLDOUT,
    final=f"select pipeline, {sql.r6('pr_auc')} as pr_auc, {sql.r6('roc_auc')} as roc_auc, " + ", ".join(f"{sql.r6(f'{p}_{c}')} as {p}_{c}" for p in metrics.PROFILES for c in ("threshold", "ber_percent"))
    + f", {sql.r6('ber_ber_percent')} as ber_percent, {', '.join(BANDS)} from ap join auc using (pipeline) join wide using (pipeline) join bands using (pipeline)"))
def _(spark, sf):
    h = _holdout(spark, sf)
    keep = ["pipeline", "pr_auc", "roc_auc", "ber_percent", *[f"{p}_{c}" for p in metrics.PROFILES for c in ("threshold", "ber_percent")], *BANDS]
    return _round(h.select(keep))


@query("auc_summary", with_(SCORES, *HOLDOUT, final="select pipeline, " + ", ".join(f"round_even({c}, 3) as {c}" for c in ("pr_auc", "pr_auc_ci_low", "pr_auc_ci_high", "roc_auc", "roc_auc_ci_low", "roc_auc_ci_high"))
    + " from ap join auc using (pipeline) join bands using (pipeline)"))
def _(spark, sf):
    return metrics.auc_summary(_holdout(spark, sf))


TRACKS = (
    "scores0 as (select * from scores where fold < 3)",
    "scores1 as (select * from scores where fold >= 3)",
    *[
        f"""ap{i} as (select pipeline, avg(precision_) as pr_auc from (select a.pipeline, a.id, sum(b.y_true)::double / count(*) as precision_
            from scores{i} a join scores{i} b on a.pipeline = b.pipeline and a.y_true = 1 and b.y_score >= a.y_score group by 1, 2) group by pipeline)"""
        for i in (0, 1)
    ],
)


def _track_aucs(spark, sf):
    s = _scores(spark, sf)
    return [metrics.auc_metrics(s.where(c), BY).select("pipeline", "pr_auc", "roc_auc") for c in ("fold < 3", "fold >= 3")]


@query("holdout_delta", with_(SCORES, *TRACKS, final=f"select pipeline, {sql.r6('a.pr_auc')} as interpolation, {sql.r6('b.pr_auc')} as extrapolation, {sql.r6('a.pr_auc - b.pr_auc')} as delta from ap0 a join ap1 b using (pipeline)"))
def _(spark, sf):
    a, b = _track_aucs(spark, sf)
    return _round(reporting.holdout_delta(a, b, "pr_auc"))


@query("cv_vs_holdout", with_(SCORES, *FOLD, CV, *TRACKS, final=f"select pipeline, {sql.r6('mean_pr_auc')} as mean_pr_auc_cv, {sql.r6('std_pr_auc')} as std_pr_auc_cv, {sql.r6('pr_auc')} as pr_auc_ho, row_number() over (order by pr_auc desc, pipeline)::int as place from cv join ap1 using (pipeline)"))
def _(spark, sf):
    cv = metrics.cv_leaderboard(_folds(spark, sf)).select("pipeline", "mean_pr_auc", "std_pr_auc")
    return _round(reporting.cv_vs_holdout(cv, _track_aucs(spark, sf)[1].select("pipeline", "pr_auc"), "pr_auc"))


@query("track_comparison", with_(SCORES, *FOLD, CV, *TRACKS, final="""select pipeline, 'interpolation' as track, round_even(mean_pr_auc, 3) as cv_pr_auc, round_even(pr_auc, 3) as holdout_pr_auc from cv left join ap0 using (pipeline)
   union all select pipeline, 'extrapolation', round_even(mean_pr_auc, 3), round_even(pr_auc, 3) from cv left join (select * from ap1 where pipeline <> 'beta') using (pipeline)"""))
def _(spark, sf):
    cv = metrics.cv_leaderboard(_folds(spark, sf))
    a, b = _track_aucs(spark, sf)
    return reporting.track_comparison(cv, a, b.where("pipeline <> 'beta'"))


@query("stable_sort", with_(SCORES, final="select pipeline, id, row_number() over (order by y_score desc, pipeline, id) as place from scores"))
def _(spark, sf):
    from ..operators.frame import global_row_number

    s = _scores(spark, sf).select("pipeline", "id", "y_score")
    return global_row_number(s, [F.desc("y_score"), "pipeline", "id"], "place").drop("y_score")


@query("outcome_order", with_(SCORES, f"o as (select pipeline, id, y_score, {OUTCOME} as outcome from scores)",
    final="""select pipeline, id, outcome, row_number() over (partition by pipeline order by case outcome when 'missed_fail' then 0 when 'false_alarm' then 1 when 'caught_fail' then 2 else 3 end, y_score desc, id) as place from o"""))
def _(spark, sf):
    return reporting.outcome_order(metrics.outcome_labels(_scores(spark, sf), 0.1), BY).select("pipeline", "id", "outcome", "place")


# --- grid search results -----------------------------------------------------------------------

CVR = """cvr as (select pipeline, case when fold % 2 = 0 then null else 0.5 end as l1_ratio, 0.1 * (fold // 2) as c, pr_auc as mean_pr_auc, case when fold = 3 then null else roc_auc / 10 end as std_pr_auc, balanced_accuracy as mean_balanced_accuracy from folds)"""


def _cvr(spark, sf):
    return _folds(spark, sf).select(
        "pipeline",
        F.when(F.col("fold") % 2 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.5)).alias("l1_ratio"),
        (F.lit(0.1) * F.floor(F.col("fold") / 2)).alias("c"),
        F.col("pr_auc").alias("mean_pr_auc"),
        F.when(F.col("fold") != 3, F.col("roc_auc") / 10).alias("std_pr_auc"),
        F.col("balanced_accuracy").alias("mean_balanced_accuracy"),
    )


GRIDSUM = "gs as (select pipeline, l1_ratio::double as l1_ratio, c::double as c, avg(mean_pr_auc) as mean_pr_auc, avg(coalesce(std_pr_auc, 0)) as std_pr_auc, avg(100 * (1 - mean_balanced_accuracy)) as mean_ber_percent from cvr group by 1, 2, 3)"


@query("grid_summary", with_(SCORES, *FOLD, CVR, GRIDSUM, final=f"""select pipeline, l1_ratio, {sql.r6('c')} as c, {sql.r6('mean_pr_auc')} as mean_pr_auc, {sql.r6('std_pr_auc')} as std_pr_auc, {sql.r6('mean_ber_percent')} as mean_ber_percent,
    row_number() over (partition by pipeline order by mean_pr_auc desc, std_pr_auc, l1_ratio nulls last, c nulls last)::int as place from gs"""))
def _(spark, sf):
    return _round(reporting.grid_summary(_cvr(spark, sf), ["l1_ratio", "c"], ["pipeline"]))


@query("grid_best", with_(SCORES, *FOLD, CVR, GRIDSUM, final="""select pipeline, coalesce(l1_ratio, 0.25)::double as l1_ratio, round(coalesce(c, 1), 6) as c from
    (select *, row_number() over (partition by pipeline order by mean_pr_auc desc, std_pr_auc, l1_ratio nulls last, c nulls last) as place from gs) where place = 1"""))
def _(spark, sf):
    return _round(reporting.grid_best(reporting.grid_summary(_cvr(spark, sf), ["l1_ratio", "c"], ["pipeline"]), {"l1_ratio": 0.25, "c": 1.0}, ["pipeline"]))


@query("fold_metrics_for_best", with_(SCORES, *FOLD, final=f"""select pipeline, fold::int as fold, {sql.r6('pr_auc')} as pr_auc from folds where pipeline = (select pipeline from folds group by 1 order by avg(pr_auc) desc, pipeline limit 1)"""))
def _(spark, sf):
    wide = _folds(spark, sf).groupBy("pipeline").pivot("fold", [0, 1, 2, 3, 4]).agg(F.first("pr_auc"))
    wide = wide.select("pipeline", *[F.col(str(i)).alias(f"split{i}_test_pr_auc") for i in range(5)])
    mean = sum(F.col(f"split{i}_test_pr_auc") for i in range(5)) / 5
    best = wide.withColumn("_m", mean).orderBy(F.desc("_m"), "pipeline").limit(1).select("pipeline")
    return _round(reporting.fold_metrics_for_best(wide, best, ["pipeline"], "pr_auc"))


@query("replace_by_key", with_(SCORES, final="""select pipeline, id, y_score as score from scores where pipeline <> 'beta' union all select pipeline, id, y_score * 2 from scores where pipeline = 'beta'"""))
def _(spark, sf):
    old = _scores(spark, sf).select("pipeline", "id", F.col("y_score").alias("score"))
    new = old.where("pipeline = 'beta'").withColumn("score", F.col("score") * 2)
    return reporting.replace_by_key(old, new, ["pipeline"])
