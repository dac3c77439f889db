from __future__ import annotations

import pytest

import corpus_pipeline
from sensorloom.llm import langid, queries
from sensorloom.llm.common import table

from .data import SF, awkward_documents, no_documents


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("make", [awkward_documents, no_documents])
def test_stages_take_awkward_rows(spark, tmp_path, make):
    docs = make(spark)
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns


def test_run_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 900


def test_language_limits_come_from_every_document(spark, monkeypatch):
    docs = table(spark, SF, "documents").where("doc_id % 4 = 0 and lang is not null and text rlike '[a-z]'")
    scored, limits = [], langid._limits
    monkeypatch.setattr(langid, "_limits", lambda scores, kinds: scored.append(scores.count()) or limits(scores, kinds))
    assert corpus_pipeline.known_language(spark, docs, SF).count() <= docs.count()
    assert scored == [docs.count()]
