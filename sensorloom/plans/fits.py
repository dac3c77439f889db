"""Model fits over the test tables; checked against plain calculations in the unit tests."""

from __future__ import annotations

from ..functions.columns import sensor_columns
from ..operators import models, prep, split
from ..session import spool
from . import preparation as p
from .catalog import query


def _train_test(spark, sf):
    x = p._imputed(spark, sf)
    x = spool(prep.robust_scale(x, prep.fit_robust(x.where("split = 'train'"), sensor_columns(x)), 5.0).drop("measurement_ts"))
    return x.where("split = 'train'"), x.where("split = 'test'")


def _enet(rows, **params):
    return models.fit_enet(split.class_balance_weights(rows), sensor_columns(rows), params.get("c", 0.1), params.get("l1_ratio", 0.3))


def _out(scorer, test):
    return scorer.score(test).select("raw_row_id", "target", "probability")


@query("enet_fit")
def _(spark, sf):
    train, test = _train_test(spark, sf)
    return _out(_enet(train), test)


@query("rf_fit")
def _(spark, sf):
    train, test = _train_test(spark, sf)
    return _out(models.fit_rf(split.class_balance_weights(train), sensor_columns(train)), test)


@query("platt_calibrate")
def _(spark, sf):
    train, test = _train_test(spark, sf)
    return _out(models.fit_calibrated(train, _enet)[0], test)


@query("coef_draws")
def _(spark, sf):
    train, _ = _train_test(spark, sf)
    return models.coef_draws(train, sensor_columns(train), models.DRAWS, 0.05, 0.3)


@query("oof_scores")
def _(spark, sf):
    train, _ = _train_test(spark, sf)
    scored = models.enet_fold_scores(split.repeated_stratified_folds(train, 5, 2), sensor_columns(train), [{"c": 0.1, "l1_ratio": 0.3}])
    return models.last_repeat(scored)


@query("grid_search")
def _(spark, sf):
    train, _ = _train_test(spark, sf)
    return models.enet_grid_search(split.repeated_stratified_folds(train, 5, 2), sensor_columns(train), {"c": [0.01, 0.05, 0.1], "l1_ratio": [0.2, 0.3, 0.5]})


def _mart_split(spark, sf):
    """The test shape as the designs see it: raw sensors and calendar."""
    from ..operators import mart

    x = mart.cyclical_encoding(mart.calendar_features(p._split(spark, sf).drop("split")))
    x = spool(split.temporal_split(x))
    return x.where("split = 'train'"), x.where("split = 'test'")


@query("feature_design")
def _(spark, sf):
    train, test = _mart_split(spark, sf)
    d = models.fit_design(train, "rfsel", 8, 3)
    return d.apply(test).select("raw_row_id", *d.features)


@query("model_grid")
def _(spark, sf):
    train, test = _mart_split(spark, sf)
    specs = {m: {"k": 4, **({"trees": 20} if m.endswith("rf") else {})} for m in models.MODEL_GRID}
    return models.holdout_scores(train, test, specs)


@query("holdout_scores")
def _(spark, sf):
    train, test = _mart_split(spark, sf)
    return models.holdout_scores(train, test, {"pls_enet": {"k": 4, "calibrate": 3}})
