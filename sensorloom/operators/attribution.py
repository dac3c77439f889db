"""Root cause: contributions of features, back-projection to sensors, groups and fact records.

Everything is computed for all rows at once. Per-row work stays inside the row (arrays of at most
one entry per feature), so it needs no shuffle; parameter tables have one row per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import spc_vector
from .linalg import correlation_matrix, dense, vector, with_struct
from .metrics import outcome

LOCAL_TOP, GLOBAL_TOP = 5, 15
# Sensor groups shown; marks of a sensor without group and of the direction of a driver; clip of a draw's logit.
GROUPS = 8
NO_GROUP = "—"
DIRECTIONS = ("toward Fail", "toward Pass")
LOGIT_BOUND = 30.0
# Numbers that a kernel holds at once.
HELD = 4_000_000
# Widths that separate low, moderate and high uncertainty.
NARROW, WIDE = 0.10, 0.30


def _top_structs(cells: Column, k: int) -> Column:
    """The k cells `(feature, contribution, ...)` of largest magnitude, ties by name."""
    keyed = F.transform(cells, lambda c: F.struct((-F.abs(c["contribution"])).alias("m"), c["feature"].alias("f"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["c"])


def contributors(coefs: DataFrame, value: Callable[[str], Column] = F.col, k: int = LOCAL_TOP) -> Column:
    """The row's k largest products coefficient x scaled value, as an array of (feature, contribution, coefficient).

    `coefs` is `(feature, coefficient)`, one row per model input; `value` gives the scaled value of a feature.
    """
    cells = F.array(
        *[
            F.struct(F.lit(r.feature).alias("feature"), (value(r.feature) * F.lit(r.coefficient)).alias("contribution"), F.lit(r.coefficient).alias("coefficient"))
            for r in coefs.collect()
        ]
    )
    return _top_structs(cells, k)


def listed(rows: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """One row per entry of a row's array, `rank` 1 first."""
    top = rows.select(*keep, F.posexplode(array).alias("_i", "_c"))
    return top.select(*keep, (F.col("_i") + 1).alias("rank"), "_c.*")


def linear_contributions(df: DataFrame, coefs: DataFrame, keep: Sequence[str], k: int = LOCAL_TOP) -> DataFrame:
    """`contributors` as rows `(keep..., rank, feature, contribution, coefficient)`."""
    return listed(df.select(*keep, contributors(coefs, k=k).alias("_c")), "_c", keep)


def _named_cells(v: Column, names: Sequence[str]) -> Column:
    named = F.lit(np.array(list(names)))
    return F.zip_with(v, named, lambda x, n: F.struct(n.alias("feature"), x.alias("contribution")))


def local_weights(loadings: np.ndarray) -> np.ndarray:
    """Signed loadings over the component's total magnitude (p x K)."""
    total = np.abs(loadings).sum(axis=0)
    total[total == 0] = 1.0
    return loadings / total


def backproject_local(df: DataFrame, components: Sequence[str], coefs: Sequence[float], loadings: np.ndarray, sensors: Sequence[str],
                      keep: Sequence[str], k: int = LOCAL_TOP) -> DataFrame:
    """Component contributions (coefficient x score) spread to sensors; the k largest per row.

    Features that are not components do not take part.
    """
    m = (local_weights(loadings) * np.asarray(coefs, dtype=float)).T
    spread = dense(lambda s: s @ m, "array<double>")(vector(components))
    top = df.select(*keep, spread.alias("_v")).select(
        *keep, F.posexplode(_top_structs(_named_cells(F.col("_v"), sensors), k)).alias("_i", "_c")
    )
    return top.select(*keep, (F.col("_i") + 1).alias("rank"), "_c.feature", "_c.contribution")


def backproject_global(loadings: DataFrame, importance: DataFrame, signed: bool = False) -> DataFrame:
    """`(sensor, k, w)` x `(k, importance)`: sensor importance, or the signed coefficient."""
    w = F.col("w") if signed else F.abs("w")
    name = "coefficient" if signed else "importance"
    return loadings.join(importance, "k").groupBy(F.col("sensor").alias("feature")).agg(F.sum(w * F.col("importance")).alias(name))


def coef_summary(draws: DataFrame) -> DataFrame:
    """`(draw, feature, beta)` to mean, population SD and 95 % interval per feature."""
    q = F.percentile("beta", F.array(F.lit(0.025), F.lit(0.975)))  # one value per draw
    s = draws.groupBy("feature").agg(F.avg("beta").alias("mean"), F.stddev_pop("beta").alias("sd"), q.alias("_q"))
    return _interval(s.select("feature", "mean", "sd", F.col("_q")[0].alias("hdi_low"), F.col("_q")[1].alias("hdi_high")))


def _interval(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"robust": (F.col("hdi_low") > 0) | (F.col("hdi_high") < 0), "abs_mean": F.abs("mean")}
    )


def posterior_backproject(draws: DataFrame, loadings: DataFrame, top: int = GLOBAL_TOP) -> DataFrame:
    """Draws `(draw, k, beta)` through the loadings: mean and interval per sensor, the `top` by |mean|."""
    sensor_draws = draws.join(loadings, "k").groupBy("draw", F.col("sensor").alias("feature")).agg(F.sum(F.col("beta") * F.col("w")).alias("beta"))
    return coef_summary(sensor_draws).drop("sd").orderBy(F.desc("abs_mean"), "feature").limit(top)


def posterior_backproject_rows(df: DataFrame, components: Sequence[str], draws: np.ndarray, loadings: np.ndarray, sensors: Sequence[str],
                               keep: Sequence[str], top: int = LOCAL_TOP) -> DataFrame:
    """The same for every row: draws (S x K) times the row's scores, spread by the local weights."""
    weights = local_weights(loadings).T
    by_name = np.argsort(np.argsort(np.array(sensors)))
    top = min(top, len(sensors))

    def score(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 4 * top))
        mean = (x * draws.mean(axis=0)) @ weights
        at = np.lexsort((np.broadcast_to(by_name, mean.shape), -np.abs(mean)), axis=1)[:, :top]
        step = max(1, HELD // (len(draws) * top))
        for i in range(0, len(x), step):  # rows x draws x top numbers at a time, for the chosen sensors only
            part, of = x[i : i + step], at[i : i + step]
            d = np.einsum("rk,sk,krt->rst", part, draws, weights[:, of], optimize=True)
            low, high = np.quantile(d, [0.025, 0.975], axis=1)
            out[i : i + step] = np.concatenate([of, np.take_along_axis(mean[i : i + step], of, axis=1), low, high], axis=1)
        return out

    v = dense(score, "array<double>")(vector(components))
    named = F.lit(np.array(list(sensors)))

    def entry(i: Column) -> Column:
        at = [F.get(F.col("_v"), i + j * top) for j in range(4)]
        return F.struct(F.get(named, at[0].cast("int")).alias("feature"), at[1].alias("mean"), at[2].alias("hdi_low"), at[3].alias("hdi_high"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(top - 1)), entry)
    return _interval(listed(df.select(*keep, v.alias("_v")).select(*keep, cells.alias("_c")), "_c", keep))


def robust_sensor_map(loadings: DataFrame, components: DataFrame) -> DataFrame:
    """A sensor is robust when its dominant component is.

    Dominant: largest |loading| x |mean|; by |loading| alone when all products are 0; the first
    component on a tie. `components` is `(k, mean, robust)`.
    """
    j = loadings.join(components, "k").withColumns({"_s": F.abs("w") * F.abs("mean"), "_a": F.abs("w")})
    return j.groupBy("sensor").agg(
        F.when(F.max("_s") > 0, F.max_by("robust", F.struct("_s", -F.col("k"))))
        .otherwise(F.max_by("robust", F.struct("_a", -F.col("k"))))
        .alias("robust")
    )


def calibrated_interval(df: DataFrame, logits: Column, calibrators: DataFrame, keep: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """`(keep..., probability, p_low, p_high)`: each fold's draw logits through its sigmoid, pooled in the row.

    `logits` is the row's array of folds x draws, fold by fold; `calibrators` is `(fold, a, b)`: p = 1 / (1 + exp(a * base + b)).
    """
    ab = np.array([(r.a, r.b) for r in calibrators.orderBy("fold").collect()])  # one row per fold

    def pool(x: np.ndarray) -> dict:
        base = 1 / (1 + np.exp(-np.clip(x, -LOGIT_BOUND, LOGIT_BOUND))).reshape(len(x), len(ab), -1)
        p = (1 / (1 + np.exp(ab[:, 0, None] * base + ab[:, 1, None]))).reshape(len(x), -1)
        q = np.quantile(p, [low, high], axis=1)
        return {"probability": p.mean(axis=1), "p_low": q[0], "p_high": q[1]}

    return with_struct(df, dense(pool, "probability double, p_low double, p_high double")(logits)).select(*keep, "probability", "p_low", "p_high")


def global_importance(coefs: DataFrame, top: int = GLOBAL_TOP) -> DataFrame:
    return coefs.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature").limit(top)


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of average-linkage clustering by the nearest-neighbour chain; a cluster goes by its least member."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            here = chain[-1]
            near = int(np.argmin(d[here]))
            if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
                near = chain[-2]
                break
            chain.append(near)
        del chain[-2:]
        a, b = sorted((here, near))
        merges.append((a, b, float(d[a, b])))
        mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = mean, mean
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return merges


def linkage_groups(distance: np.ndarray, most: int) -> np.ndarray:
    """Group number of each item, from 1 by first member: the merges up to the least height that leaves at most `most` groups."""
    n = len(distance)
    of = np.arange(n)
    merges = sorted(average_linkage(distance), key=lambda m: m[2])
    needed = n - max(1, min(most, n))
    for k, (a, b, height) in enumerate(merges):
        if k >= needed and height > merges[needed - 1][2] if needed else True:
            break
        ra, rb = of[a], of[b]
        of[of == max(ra, rb)] = min(ra, rb)
    return np.unique(of, return_inverse=True)[1] + 1


def sensor_groups(df: DataFrame, sensors: Sequence[str], most: int = GROUPS) -> DataFrame:
    """`(sensor, group)`: average-linkage groups on 1 - |correlation| of complete columns; the rolling twin shares its group.

    The correlations come from one aggregation of the rows; the tree is built on the columns alone.
    """
    distance = np.clip(1 - np.abs(correlation_matrix(df, sensors)), 0, None)
    number = linkage_groups((distance + distance.T) / 2, most)
    rows = [(s + twin, f"G{g}") for twin in ("", "_rz") for s, g in zip(sensors, number.tolist(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "sensor string, group string")


# --- enrichment and records -------------------------------------------------------------------


def _by_sensor(table: DataFrame, value: str, kind: str) -> Callable[[Column], Column]:
    """Lookup of a value by sensor, null for others; `table` has one row per sensor."""
    found = {r["sensor"]: r[value] for r in table.select("sensor", value).collect() if r[value] is not None}
    if not found:
        return lambda feature: F.lit(None).cast(kind)
    held = F.create_map(*[F.lit(x) for kv in found.items() for x in kv])
    return lambda feature: F.try_element_at(held, feature).cast(kind)


def enrich_contributors(
    rows: DataFrame, drift: DataFrame, groups: DataFrame, spc: DataFrame, sensors: Sequence[str], array: str = "contributors", limit: float = 2.0
) -> DataFrame:
    """Add `spc_z`, `drift_shift`, `drift_flag` and `group` to each entry of the row's array; unmatched: null, null, false, "—".

    `drift` (sensor, shift), `groups` (sensor, group) and `spc` (`fit_spc`) have one row per sensor and become literals; the z
    comes from the row's own raw `sensors`, so no row moves.
    """
    shift, group = _by_sensor(drift, "shift", "double"), _by_sensor(groups, "group", "string")
    z, named = spc_vector(sensors, spc), F.lit(np.array(list(sensors)))

    def entry(c: Column) -> Column:
        s = shift(c["feature"])
        return (
            c.withField("spc_z", F.get(F.col("_z"), (F.array_position(named, c["feature"]) - 1).cast("int")))
            .withField("drift_shift", s)
            .withField("drift_flag", F.coalesce(F.abs(s) > limit, F.lit(False)))
            .withField("group", F.coalesce(group(c["feature"]), F.lit(NO_GROUP)))
        )

    return rows.withColumn("_z", z).withColumn(array, F.transform(array, entry)).drop("_z")


def annotate_robust(rows: DataFrame, robust: DataFrame, array: str = "contributors") -> DataFrame:
    """Add `robust` to each entry (one row per sensor on the right), null where unknown."""
    known = _by_sensor(robust, "robust", "boolean")
    return rows.withColumn(array, F.transform(array, lambda c: c.withField("robust", known(c["feature"]))))


def key_findings(rows: DataFrame, keep: Sequence[str], array: str = "contributors") -> DataFrame:
    """Per row with contributors: the strongest, which stands first, with direction, z and drift flag, and counts."""
    top, c = F.col(array)[0], F.col(array)

    def n(flag: str) -> Column:
        return F.size(F.filter(c, lambda e: F.coalesce(e[flag], F.lit(False)))).cast("long")

    return rows.where(F.size(array) > 0).select(
        *keep,
        top["feature"].alias("top_driver"),
        F.when(top["contribution"] > 0, DIRECTIONS[0]).otherwise(DIRECTIONS[1]).alias("top_direction"),
        top["spc_z"].alias("top_spc_z"),
        top["drift_flag"].alias("top_drifting"),
        F.size(array).cast("long").alias("n_contributors"),
        n("drift_flag").alias("n_drifting"),
        n("robust").alias("n_robust"),
    )


def verdicts(outcomes: DataFrame) -> DataFrame:
    """Words for the labels and whether they agree."""
    def word(c: str) -> Column:
        return F.when(F.col(c) == 1, "Fail").otherwise("Pass")

    return outcomes.withColumns(
        {
            "actual": word("y_true"),
            "predicted": word("y_pred"),
            "outcome": outcome(F.col("y_true"), F.col("y_pred")),
            "outcome_label": F.replace(outcome(F.col("y_true"), F.col("y_pred")), F.lit("_"), F.lit(" ")),
            "correct": F.col("y_true") == F.col("y_pred"),
        }
    )


def uncertainty(low: Column, high: Column) -> Column:
    width = high - low
    return F.when(width < NARROW, "low").when(width <= WIDE, "moderate").when(width > WIDE, "high")


def borderline(p: Column, threshold: Column) -> Column:
    """Within half to twice the threshold."""
    return (p >= 0.5 * threshold) & (p <= 2.0 * threshold)


def contributor_entry(c: Column) -> Column:
    """One contributor as a record; absent facts are null and vanish from the JSON."""
    direction = (
        F.when(c["coefficient"].isNotNull(), F.when(c["coefficient"] > 0, "positive").otherwise("negative"))
        .when(c["contribution"] > 0, "raises_fail_risk")
        .otherwise("lowers_fail_risk")
    )
    return F.struct(
        c["feature"].alias("feature"),
        F.bround(c["contribution"], 4).alias("contribution"),
        direction.alias("direction"),
        F.bround(c["spc_z"], 2).alias("spc_z"),
        c["drift_flag"].alias("drifting"),
        F.bround(c["drift_shift"], 2).alias("drift_shift"),
        c["robust"].alias("attribution_robust"),
    )


# Directions that count as raising and lowering.
RAISING, LOWERING = ("positive", "raises_fail_risk"), ("negative", "lowers_fail_risk")
CAVEAT = "associations only: no cause is proven and no tool or chamber is known"


# The spaces that contributions are told in.
SENSOR_SPACE, BACK_PROJECTED = "sensor", "sensor (PLS back-projected)"


def wafer_facts(
    outcomes: DataFrame, contrib: DataFrame, gate_facts: DataFrame | None, model_id: str, track: str, id_col: str,
    model_name: str | None = None, method: str = "", array: str = "contributors",
) -> DataFrame:
    """One fact record per row.

    `outcomes`: id, y_true, y_pred, probability, threshold, p_low, p_high. `contrib`: id and the array of enriched top
    contributors. `gate_facts`: id and a `bayes` struct. `method` names how contributions were found.
    """
    entries = contrib.select(id_col, F.transform(array, contributor_entry).alias("top_contributors"))
    out = outcomes.join(entries, id_col, "left")
    if gate_facts is not None:
        out = out.join(gate_facts.select(id_col, "bayes"), id_col, "left")
    else:
        out = out.withColumn("bayes", F.lit(None).cast("struct<out_of_control:boolean,tripped:array<string>>"))
    p, t = F.bround("probability", 4), F.bround("threshold", 4)

    def n(cond) -> Column:
        return F.coalesce(F.size(F.filter("top_contributors", cond)), F.lit(0))

    v = verdicts(out)
    interval = F.when(F.col("p_low").isNotNull(), F.array(F.bround("p_low", 4), F.bround("p_high", 4)))
    return v.select(
        id_col,
        F.struct(
            F.lit(model_id).alias("model_id"),
            F.lit(model_name or model_id).alias("model_name"),
            F.lit(track).alias("track"),
            F.lit(BACK_PROJECTED if model_id.startswith("pls_") else SENSOR_SPACE).alias("feature_space"),
            F.col(id_col).cast("string").alias("wafer_id"),
            "actual", "predicted", "outcome",
            p.alias("fail_probability"),
            t.alias("threshold"),
            borderline(p, t).alias("borderline"),
            n(lambda e: e["drifting"]).alias("n_drifting_contributors"),
            n(lambda e: e["direction"].isin(*RAISING)).alias("n_raising_contributors"),
            n(lambda e: e["direction"].isin(*LOWERING)).alias("n_lowering_contributors"),
            F.lit(method).alias("method"),
            F.coalesce("top_contributors", F.array().cast("array<struct<feature:string,contribution:double,direction:string,spc_z:double,drifting:boolean,drift_shift:double,attribution_robust:boolean>>")).alias("top_contributors"),
            F.lit(CAVEAT).alias("caveat"),
            interval.alias("fail_probability_credible_interval"),
            uncertainty(F.col("p_low"), F.col("p_high")).alias("uncertainty"),
            F.when(F.col("bayes").isNotNull(), F.struct("bayes")).alias("process_gates"),
        ).alias("facts"),
    )


def explanation_records(facts: DataFrame, id_col: str) -> DataFrame:
    """Fact records as JSON text; null facts are left out of the text."""
    return facts.select(id_col, F.to_json("facts").alias("record"))


# The statistics a record can cite, in the order they are listed. The wording is ours.
DEFINITIONS = {
    "fail_probability": "P(fail) is the calibrated chance of a fail; the decision compares it with the threshold.",
    "threshold": "The threshold is the probability from which a wafer is called Fail.",
    "fail_probability_credible_interval": "The interval holds P(fail) with 95 % credibility; a wide one means an unsure model.",
    "uncertainty": "Uncertainty names the width of the interval: low, moderate or high.",
    "borderline": "Borderline: P(fail) lies between half and twice the threshold.",
    "driver_direction": "Driver direction counts how many contributors raise and how many lower the risk.",
    "outcome_caught_fail": "Caught fail: a failing wafer that was called Fail.",
    "outcome_missed_fail": "Missed fail: a failing wafer that was called Pass, the costly error.",
    "outcome_false_alarm": "False alarm: a passing wafer that was called Fail, the cheap error.",
    "outcome_correct_pass": "Correct pass: a passing wafer that was called Pass.",
    "spc_z": "SPC z is the distance from the passing median in robust standard deviations.",
    "drifting": "Drifting: the sensor's level moved between the training and the holdout era.",
    "drift_shift": "Drift shift is that move in training standard deviations, with its sign.",
    "attribution_robust": "Robust: the 95 % interval of the effect does not contain zero.",
    "process_gate": "A process gate is a monitor fitted on passing wafers, independent of the yield model.",
    "hotelling_t2": "Hotelling T2 is the squared distance along the component directions.",
    "q_spe": "Q (SPE) is the squared residual that the components cannot rebuild.",
    "bgm_density": "Density is the log-likelihood under the mixture fitted on factor scores.",
}


def definitions_for_facts(facts: DataFrame, id_col: str) -> DataFrame:
    """Keys of the definitions a record needs, in a fixed order without duplicates."""
    f = F.col("facts")
    cs = f["top_contributors"]

    def cited(cond) -> Column:
        return F.coalesce(F.exists(cs, cond), F.lit(False))

    known = facts.schema["facts"].dataType["process_gates"].dataType.names
    gated = f["process_gates"].isNotNull()

    def gate(name: str) -> Column:
        return gated & f["process_gates"][name].isNotNull() if name in known else F.lit(False)

    outcome_key = F.concat(F.lit("outcome_"), f["outcome"])
    tests = {
        "fail_probability": f["fail_probability"].isNotNull(),
        "threshold": f["threshold"].isNotNull(),
        "fail_probability_credible_interval": f["fail_probability_credible_interval"].isNotNull(),
        "uncertainty": f["uncertainty"].isNotNull(),
        "borderline": f["borderline"].isNotNull(),
        "driver_direction": f["n_raising_contributors"].isNotNull() | f["n_lowering_contributors"].isNotNull(),
        **{k: outcome_key == k for k in DEFINITIONS if k.startswith("outcome_")},
        "spc_z": cited(lambda c: c["spc_z"].isNotNull()),
        "drifting": (f["n_drifting_contributors"] > 0) | cited(lambda c: c["drifting"]),
        "drift_shift": cited(lambda c: c["drift_shift"].isNotNull()),
        "attribution_robust": cited(lambda c: c["attribution_robust"].isNotNull()),
        "process_gate": gated,
        "hotelling_t2": gate("pca"),
        "bgm_density": gate("bayes"),
        "q_spe": gate("pca") | gate("bayes"),
    }
    keys = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()]))
    return facts.select(id_col, keys.alias("definition_keys"))


def definition_texts(keys: DataFrame, id_col: str, definitions: Mapping[str, str] = DEFINITIONS) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in definitions.items() for x in kv])
    return keys.select(id_col, F.transform("definition_keys", lambda k: F.element_at(table, k)).alias("definitions"))
