from __future__ import annotations

import math
import random

from sensorloom.llm import queries, search

from ..compare import connect, mismatch
from .data import SF


def _plain(rows, asked, k, scale):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in kept:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_sql(spark):
    assert mismatch(queries.op7(spark, SF), connect(SF), queries.ORACLES["op7_top_k_search"]) is None


def test_awkward_vectors_and_ties_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 16)
    monkeypatch.setattr(search, "QUERIES", 4)
    rng = random.Random(11)
    rows = [(n, [rng.choice((0.0, 0.5, -0.25, 1.0)) for _ in range(6)]) for n in range(150)]
    rows += [(300 + n, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for n in range(60)]  # equal vectors
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan"), 1.0]), (403, [float("inf")]), (404, []), (405, [1.0]), (406, [1.0] * 9), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, qb int, code string").repartition(5)
    got = search.top_k(df, df.where("vec_id % 25 = 0"), k=7, scale=8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _plain(rows, lambda q: q % 25 == 0, 7, 8)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, search.top_k(few, few, k=10, scale=8).collect())) == _plain(rows[:4], lambda q: True, 10, 8)
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0
