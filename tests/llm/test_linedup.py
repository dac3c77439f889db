from __future__ import annotations

import random
from collections import defaultdict

from sensorloom.llm import linedup, queries

from .data import PROSE, SF, awkward_documents, no_documents


def brute_force(rows, min_docs=3, similarity=0.6):
    leaves = defaultdict(lambda: defaultdict(list))
    for key in {(d, t) for d, t in rows if t is not None}:
        for n, line in enumerate(key[1].split("\n")):
            if words := linedup.masked(line):
                leaves[len(words), *words[: linedup.DEPTH]][" ".join(words)].append((key, n))
    gone = defaultdict(set)
    for lines in leaves.values():
        if len({k for places in lines.values() for k, _ in places}) < min_docs:
            continue
        order = sorted(lines, key=linedup._code)
        first, _ = linedup.templates(order, similarity)
        members = defaultdict(list)
        for line, f in zip(order, first, strict=True):
            members[f] += lines[line]
        for places in members.values():
            if len({k for k, _ in places}) >= min_docs:
                for k, n in places:
                    gone[k].add(n)
    return sorted(
        ((d, 0 if t is None else t.count("\n") + 1, len(gone[d, t]), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d, t])) for d, t in rows),
        key=str,
    )


def test_templates():
    lines = ["user <*> logged in from home today", "user <*> logged in from work today", "user root did something else than that"]
    first, text = linedup.templates(lines, 0.6)
    assert first == [0, 0, 2] and text[0] == "user <*> logged in from <*> today"


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, linedup.without_repeated_lines(docs).collect()), key=str) == brute_force(rows)


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, linedup.without_repeated_lines(docs, min_docs=2).collect()), key=str) == brute_force(rows, 2)
    assert linedup.without_repeated_lines(no_documents(spark)).count() == 0


def test_templates_of_a_large_leaf_all_meet(spark, monkeypatch):
    # 60 different lines of one leaf that no two chunks bring together by chance, and three that share a template.
    monkeypatch.setattr(linedup, "CHUNK", 4)
    lines = [f"session closed for {' '.join(a + b for b in 'pqrst')}" for a in (chr(97 + i // 8) + chr(105 + i % 8) for i in range(60))]
    docs = [(n, line) for n, line in enumerate(lines)]
    docs += [(100 + n, f"session closed for host alpha beta {w} now") for n, w in enumerate(("red", "blue", "green"))]
    got = {r.doc_id: r.n_dropped for r in linedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=3).collect()}
    assert all(got[n] == (n >= 100) for n in got) and len(got) == 63


def test_query_drops_passages_of_exactly_two_documents(spark, tmp_path):
    rng = random.Random(8)
    own = [" ".join(rng.choice(PROSE) for _ in range(30)) for _ in range(4)]
    passage = " ".join(rng.choice(PROSE) for _ in range(60))
    docs = [(n, f"{text}\n{passage}" if n < 2 else text) for n, text in enumerate(own)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op9(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(own))


def test_variable_fields_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(linedup, "CHUNK", 10)
    rng = random.Random(4)
    docs = []
    for n in range(60):
        own = " ".join(rng.choice(PROSE) for _ in range(25))
        docs.append((n, f"{own}\nPage {n} of 90 printed by {rng.choice(PROSE)} today at noon in the hall\nSession closed for host alpha {rng.choice(PROSE)} now"))
    got = {r.doc_id: r for r in linedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[n].text == t.split("\n")[0] and got[n].n_dropped == 2 for n, t in docs)
