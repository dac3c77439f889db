"""Feature preparation: fit on the training rows, apply to all.

`fit_*` functions return a small table of one row per column; `apply` functions turn it into
literals of a projection, so applying never shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ID, SENSOR, TARGET, sensor_columns
from ..functions.scalar import clip
from ..session import spool
from .frame import melt, rank_dictionary, sensor_stats
from .linalg import Moments, dense, moments, records_of, summed, vector
from .profile import sensor_quantiles


def as_dict(params: DataFrame, value: str, key: str = "sensor") -> dict:
    return {r[0]: r[1] for r in params.select(key, value).collect()}


def fit_median(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """`(sensor, median)`; a sensor without any value is left out."""
    return sensor_quantiles(df, sensors, {"median": 0.5}).where("median is not null")


def median_impute(df: DataFrame, sensors: Sequence[str], params: DataFrame) -> DataFrame:
    """Fill nulls by the fitted median; sensors that had none at fit time vanish."""
    fill = as_dict(params, "median")
    gone = [c for c in sensors if c not in fill]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in sensors if c in fill}).drop(*gone)


def varying_sensors(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Sensors whose minimum and maximum differ."""
    span = sensor_stats(df, sensors, {"lo": F.min, "hi": F.max})
    return span.where(F.col("lo") != F.col("hi")).select("sensor")


def drop_constant(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    keep = {r[0] for r in varying_sensors(df, sensors).collect()}
    return df.drop(*[c for c in sensors if c not in keep])


def fit_robust(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """`(sensor, center, scale)`: median and interquartile range, 1 where the range is 0."""
    q = sensor_quantiles(df, sensors, {"q1": 0.25, "center": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("sensor", "center", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def robust_scale(df: DataFrame, params: DataFrame, bound: float | None = None) -> DataFrame:
    """(x - center) / scale, clipped to +-bound when one is given."""
    rows = {r.sensor: (r.center, r.scale) for r in params.collect()}

    def scaled(c: str) -> Column:
        x = (F.col(c) - F.lit(rows[c][0])) / F.lit(rows[c][1])
        return x if bound is None else clip(x, -bound, bound)

    return df.withColumns({c: scaled(c) for c in df.columns if c in rows})


# Entries (sensor, value, rank) of a dictionary that goes to every task, 24 bytes each; a larger one is joined.
DICTIONARY_ROWS = 2_000_000


def _lookup(names: Sequence[str], held):
    """Replace the values of the named columns by their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = held.value
        for batch in batches:
            for c in names:
                i = batch.schema.get_field_index(c)
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                has = ~np.isnan(x)
                out = np.zeros(len(x))
                out[has] = ranks[c][np.searchsorted(values[c], x[has])]
                batch = batch.set_column(i, pa.field(c, pa.float64()), pa.array(out, mask=~has))
            yield batch

    return run


def rank_columns(df: DataFrame, sensors: Sequence[str], id_col: str = ID) -> DataFrame:
    """`(id, sensors...)` with each value replaced by its average rank in the column; nulls stay.

    Ranks belong to different values, counted once and ranked in range pieces. A dictionary of up to DICTIONARY_ROWS
    entries is looked up by every task, so no cell moves; beyond, non-null cells are joined with it and put together by row.
    """
    sensors = list(sensors)
    wide = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in sensors])
    ranks = spool(rank_dictionary(melt(wide.select(*sensors), [], sensors), ["sensor"], "value", "rank"))
    if ranks.count() <= DICTIONARY_ROWS:
        t = ranks.toPandas().sort_values(["sensor", "value"])
        nothing = np.zeros(0)
        by = {s: (g["value"].to_numpy(), g["rank"].to_numpy()) for s, g in t.groupby("sensor")}
        held = df.sparkSession.sparkContext.broadcast(tuple({s: by.get(s, (nothing, nothing))[i] for s in sensors} for i in (0, 1)))
        return wide.mapInArrow(_lookup(sensors, held), wide.schema)
    cells = melt(wide, [id_col], sensors).where("value is not null").join(ranks, ["sensor", "value"])
    of = F.map_from_entries(F.collect_list(F.struct("sensor", "rank")))  # one entry a column
    rows = cells.groupBy(id_col).agg(of.alias("_r"))
    return wide.select(id_col).join(rows, id_col, "left").select(id_col, *[F.col("_r")[c].alias(c) for c in sensors])


def rank_transform(df: DataFrame, sensors: Sequence[str], id_col: str = ID) -> DataFrame:
    """Long `(id, sensor, rank)` with average ranks per sensor, null for null."""
    return melt(rank_columns(df, sensors, id_col), [id_col], sensors).withColumnRenamed("value", "rank")


def spearman_matrix(df: DataFrame, sensors: Sequence[str], id_col: str = ID) -> np.ndarray:
    """Rank correlation of complete columns: Pearson on the average ranks, whose mean is known; 0 where a column is constant."""
    ranks = rank_columns(df, sensors, id_col).select(*sensors)
    middle = (df.count() + 1) / 2

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sensors), len(sensors)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - middle
            total += x.T @ x
        yield records_of(dict(enumerate(total)))

    rows = summed(ranks, gram)
    g = np.stack([rows[i] for i in range(len(sensors))])
    sd = np.sqrt(np.diag(g))
    r = np.divide(g, np.outer(sd, sd), out=np.zeros_like(g), where=np.outer(sd, sd) > 0)
    np.fill_diagonal(r, 1.0)
    return r


def edges_from_matrix(spark, r: np.ndarray, names: Sequence[str], threshold: float) -> DataFrame:
    """Pairs a < b (by name) with |r| above the threshold."""
    i, j = np.where(np.triu(np.abs(r) > threshold, 1))
    rows = [(*sorted((names[a], names[b])), float(r[a, b])) for a, b in zip(i, j)]
    return spark.createDataFrame(rows, "a string, b string, r double")


def spearman_edges(df: DataFrame, sensors: Sequence[str], threshold: float, id_col: str = ID) -> DataFrame:
    return edges_from_matrix(df.sparkSession, spearman_matrix(df, sensors, id_col), list(sensors), threshold)


def target_priority(df: DataFrame, sensors: Sequence[str], label: str = TARGET) -> DataFrame:
    """`(feature, place)`: by falling |r| with the label, ties by name; from one scan."""
    r = sensor_stats(df, sensors, {"r": lambda c: F.corr(c, label)}, ids=[label])
    strength = F.when(F.col("r").isNull() | F.isnan("r"), F.lit(0.0)).otherwise(F.round(F.abs("r"), 12))
    w = Window.orderBy(strength.desc(), "sensor")  # one row per column
    return r.select(F.col("sensor").alias("feature"), F.row_number().over(w).alias("place"))


def walk_edges(order: Sequence[str], edges: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Leader of each feature: in order, each undecided one leads itself, and its undecided neighbours drop.

    A dropped feature goes by the first in order of the leaders next to it.
    """
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader: dict[str, str] = {}
    for f in order:
        if f not in leader:
            leader[f] = f
            for other in near.get(f, ()):
                leader.setdefault(other, f)
    return leader


def corr_prune(edges: DataFrame, priority: DataFrame) -> DataFrame:
    """`(feature, leader, kept)` of `walk_edges`; both tables are of columns, not rows, so the driver walks them."""
    order = [r[0] for r in priority.orderBy("place").select("feature").collect()]
    leader = walk_edges(order, [(r.a, r.b) for r in edges.select("a", "b").collect()])
    return edges.sparkSession.createDataFrame([(f, leader[f], leader[f] == f) for f in order], "feature string, leader string, kept boolean")


def correlation_example(df: DataFrame, pruned: DataFrame, shown: int = 6, id_col: str = ID) -> DataFrame:
    """Spearman matrix (pairs) of the first group, by leader name, with three members or more."""
    groups = pruned.groupBy("leader").agg(F.sort_array(F.collect_set("feature")).alias("m"))  # column names
    first = groups.where(F.size("m") >= 3).orderBy("leader").limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    names = first[0]["m"][:shown]
    r = spearman_matrix(df, names, id_col)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


# --- feature front-ends ----------------------------------------------------------------------


def rf_top_k(df: DataFrame, features: Sequence[str], k: int, label: str = TARGET, weight: str | None = None, trees: int = 1000, seed: int = 42) -> DataFrame:
    """Features by random-forest importance, the k best marked as selected."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=5, minInstancesPerNode=10, featureSubsetStrategy="sqrt", seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    imp = rf.fit(vec).featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-imp[i], features[i]))
    rows = [(features[i], float(imp[i]), rank + 1, rank < k) for rank, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int, selected boolean")


SMALLEST_BLOCK = 4  # rows


def _block_hsic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised HSIC of each column of x with the label inside one block of rows.

    Gaussian kernel on standardised values for x, equality kernel for the label.
    """
    n = len(y)
    center = np.eye(n) - 1.0 / n
    ly = (y[:, None] == y[None, :]) / np.where(y == 1, max((y == 1).sum(), 1), max((y != 1).sum(), 1))[:, None]
    ly = center @ ly @ center
    ny = np.linalg.norm(ly)
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        v = x[:, j]
        sd = v.std()
        if sd == 0 or ny == 0:
            continue
        d = (v[:, None] - v[None, :]) / sd
        k = center @ np.exp(-0.5 * d * d) @ center
        nk = np.linalg.norm(k)
        out[j] = (k * ly).sum() / (nk * ny) if nk > 0 else 0.0
    return out


def dependence_top_k(df: DataFrame, features: Sequence[str], k: int, block: int = 200, label: str = TARGET, id_col: str = ID) -> DataFrame:
    """Features by kernel dependence on the label, averaged over random blocks of about `block` rows.

    A block holds whole rows, so the table moves once whatever the column count, and no task
    holds more than a block.
    """
    n = df.count()
    blocks = max(1, math.ceil(n / block))
    names = list(features)
    number = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    # A block by chance too short for a kernel matrix joins the next one; one row per block goes to the driver.
    sizes = dict(df.groupBy(number.alias("b")).count().collect())
    to, short = list(range(blocks)), 0
    for i in range(blocks - 1):
        short += sizes.get(i, 0)
        if short < SMALLEST_BLOCK:
            to[i] = -1
        else:
            short = 0
    last = blocks - 1
    if short + sizes.get(last, 0) < SMALLEST_BLOCK and any(t >= 0 for t in to[:-1]):
        to[last] = max(t for t in to[:-1] if t >= 0)
    for i in range(blocks - 2, -1, -1):
        to[i] = to[i + 1] if to[i] < 0 else to[i]
    moved = {i: t for i, t in enumerate(to) if i != t}
    target = F.create_map(*[F.lit(v) for pair in moved.items() for v in pair])[number] if moved else F.lit(None).cast("int")
    rows = df.select(
        F.coalesce(target, number).alias("_block"), F.col(label).cast("int").alias("_y"), vector(names).alias("_x")
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        hsic = _block_hsic(np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy())
        return pd.DataFrame({"feature": names, "hsic": hsic, "rows": float(len(pdf))})

    parts = rows.groupBy("_block").applyInPandas(score, "feature string, hsic double, rows double")
    mean = parts.groupBy("feature").agg((F.sum(F.col("hsic") * F.col("rows")) / F.sum("rows")).alias("dependence"))
    w = Window.orderBy(F.desc("dependence"), "feature")  # one row per column
    return mean.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def hub_pairs(df: DataFrame, hubs: Sequence[str]) -> DataFrame:
    """Products of all pairs of the hub columns, as `interact_a__b`."""
    return df.withColumns({f"interact_{a}__{b}": F.col(a) * F.col(b) for a, b in combinations(hubs, 2)})


def ledoit_wolf(df: DataFrame, m: Moments) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards a multiple of the identity, and the share of the latter.

    The published estimator: the share is the mean squared error of the sample covariance over its squared distance
    from the target, both in the norm tr(A A') / p; the error is the spread of the rows' own outer products, which
    needs one more sum over the rows, of their squared lengths squared.
    """
    p = len(m.names)
    sample = m.cov * (m.n - 1) / m.n
    level = float(np.diag(sample).mean())
    target = level * np.eye(p)
    length = F.aggregate(
        F.array(*[F.pow(F.col(c) - F.lit(float(at)), 2) for c, at in zip(m.names, m.mean)]), F.lit(0.0), lambda a, x: a + x
    )
    mean_fourth = df.agg(F.avg(F.pow(length, 2))).first()[0]
    distance = float(((sample - target) ** 2).mean() * p)
    error = (mean_fourth - float((sample**2).sum())) / (p * m.n)
    share = min(error / distance, 1.0) if distance > 0 else 0.0
    return share * target + (1 - share) * sample, share


def t2_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    raw = [c for c in cols if c in set(sensor_columns(df, SENSOR))]
    return raw or list(cols)


def fit_hotelling(df: DataFrame, cols: Sequence[str], shrink: bool = True) -> tuple[Moments, np.ndarray]:
    """Means and inverse covariance of the raw sensors among `cols` (of all, if there are none)."""
    use = t2_columns(df, cols)
    m = moments(df, use)
    cov = ledoit_wolf(df, m)[0] if shrink else m.cov * (m.n - 1) / m.n
    return m, np.linalg.pinv(cov, hermitian=True)


def hotelling_t2(df: DataFrame, fitted: tuple[Moments, np.ndarray] | None, name: str = "hotelling_t2") -> DataFrame:
    """Squared Mahalanobis distance of each row; 0 when nothing was fitted."""
    if fitted is None:
        return df.withColumn(name, F.lit(0.0))
    m, inv = fitted
    mean = m.mean
    score = dense(lambda x: np.einsum("ij,jk,ik->i", x - mean, inv, x - mean, optimize=True), "double")
    return df.withColumn(name, score(vector(m.names)))


def fit_pls(df: DataFrame, cols: Sequence[str], k: int, label: str = TARGET) -> dict:
    """PLS with one response on standardised columns, from second moments alone."""
    names = list(cols)
    m = moments(df.withColumn("_y", F.col(label).cast("double")), [*names, "_y"])
    p = len(names)
    k = max(1, min(int(k), p, m.n - 1))
    sd = np.sqrt(np.diag(m.cov))
    sd[sd == 0] = 1.0
    corr = m.cov / np.outer(sd, sd) * (m.n - 1)
    xx, xy = corr[:p, :p], corr[:p, p].copy()
    rot, load = np.zeros((p, k)), np.zeros((p, k))
    for a in range(k):
        norm = np.linalg.norm(xy)
        if norm < 1e-12:
            rot, load = rot[:, :a], load[:, :a]
            break
        w = xy / norm
        w *= np.sign(w[np.argmax(np.abs(w))])
        r = w - rot[:, :a] @ (load[:, :a].T @ w)
        tt = r @ xx @ r
        load[:, a] = xx @ r / tt
        rot[:, a] = r
        xy = xy - load[:, a] * (r @ xy)
    return {"names": names, "mean": m.mean[:p], "sd": sd[:p], "rotation": rot, "loadings": load}


def pls_scores(df: DataFrame, fitted: dict) -> DataFrame:
    """Components `pls_0 ..` of each row."""
    mean, sd, rot = fitted["mean"], fitted["sd"], fitted["rotation"]
    n = rot.shape[1]
    schema = ", ".join(f"pls_{i} double" for i in range(n))

    def score(x: np.ndarray) -> dict:
        t = ((x - mean) / sd) @ rot
        return {f"pls_{i}": t[:, i] for i in range(n)}

    if n == 0:
        return df
    from .linalg import with_struct

    return with_struct(df, dense(score, schema)(vector(fitted["names"])))


def pls_score_scatter(scores: DataFrame, label: str = TARGET, id_col: str = ID) -> DataFrame:
    second = F.col("pls_1") if "pls_1" in scores.columns else F.lit(0.0)
    return scores.select(id_col, label, F.col("pls_0").alias("x"), second.alias("y"))
