from __future__ import annotations

import random

import numpy as np

from sensorloom.llm import decontam

from .data import PROSE, SF, awkward_documents, no_documents

BENCH = "item_id long, text string"


def _plain_distance(item, text):
    """Edits from the item to the best stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_against_plain():
    rng = random.Random(4)
    for _ in range(40):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 14))]
        got = decontam.edit_distance(np.array([item], np.uint64), np.array([len(item)]), np.array([text], np.uint64).reshape(1, -1))
        assert got[0] == _plain_distance(item, text)


def test_recall_at_the_limit_and_no_false_hit(spark):
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(3000)}" for _ in range(3000)] + PROSE * 20
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in [5, 8, 12, 16, 20, 30, 40, 60] * 4]
    docs, want = [], {}
    for n, item in enumerate(items * 3):
        w = list(item)
        for _ in range(int(0.2 * len(item) + 1e-9) + rng.choice((0, 0, 3))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = rng.choice(vocabulary)
            elif kind == 1 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, rng.choice(vocabulary))
        body = [rng.choice(vocabulary) for _ in range(50)] + w + [rng.choice(vocabulary) for _ in range(50)]
        docs.append((n, " ".join(body).upper()))
        want[n] = {(i, d) for i, x in enumerate(items) if (d := _plain_distance(x, body)) <= int(0.2 * len(x) + 1e-9)}
    bench = spark.createDataFrame([(i, "... ".join(x)) for i, x in enumerate(items)], BENCH)
    got = {r.doc_id: {(h.item_id, h.edits) for h in r.hits} for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert all(got[n] <= want[n] for n in want)
    found, there = sum(len(x) for x in got.values()), sum(len(x) for x in want.values())
    assert there > 50 and found >= 0.99 * there


def test_slices_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    verbatim = {(d, b.item_id) for b in bench.collect() for d, t in texts.items() if b.text in t}
    runs = []
    for words in (decontam.SLICE_WORDS, 400):
        monkeypatch.setattr(decontam, "SLICE_WORDS", words)
        rows = decontam.find_leaks(docs, bench).collect()
        runs.append({(r.doc_id, h.item_id, h.edits) for r in rows for h in r.hits})
        assert len(rows) == len(texts)
    assert runs[0] == runs[1] and {x[:2] for x in runs[0]} == verbatim


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    text = docs.where("doc_id = 4").first().text
    bench = spark.createDataFrame([(1, text), (2, None), (None, text), (3, ""), (4, "the of"), (5, text)], BENCH)
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {4}
    hits = decontam.find_leaks(docs, bench, "found").where("size(found) > 0").collect()
    assert [(r.doc_id, sorted(h.item_id for h in r.found)) for r in hits] == [(4, [1, 5])]
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontam.without_leaks(no_documents(spark), bench).count() == 0
