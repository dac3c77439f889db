from __future__ import annotations

import re
from collections import Counter

from sensorloom.llm import mixing, queries

from ..compare import connect, mismatch
from .data import SF, awkward_documents, no_documents


def test_targets():
    assert mixing.shared_targets([("a", 100), ("b", 100), ("c", 100)], 1.5, 2.0) == [200.0, 250 / 3, 500 / 3]
    assert mixing.shared_targets([("a", 0), ("b", 10), (None, 10)], 1.5, 2.0) == [0.0, 10.0, 20.0]
    assert mixing.shared_targets([], 1.5, 2.0) == []


def test_sql(spark):
    assert mismatch(queries.op6(spark, SF), connect(SF), queries.ORACLES["op6_source_mix"]) is None


def test_takes_come_near_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    taken, most, target = Counter(), Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
        assert r.copies <= 2
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(7)).collect()}


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect() if r.doc_id is not None}
    assert all(r.size == size[r.doc_id] for r in got if r.doc_id is not None)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    seen = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert seen == +want
    assert mixing.mix_sources(no_documents(spark)).count() == 0 and mixing.mixed_documents(no_documents(spark)).count() == 0
