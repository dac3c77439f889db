from __future__ import annotations

import random
import re

import numpy as np

from sensorloom.llm import neardup

from .data import SF, awkward_documents, no_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, width):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_force(rows, width, percent=80):
    """component of each place in rows: smallest id reachable."""
    sets = [_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [None if doc is None else low[find(i)] for i, (doc, _) in enumerate(rows)], [len(s) for s in sets]


def _check(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=width).collect()), key=str)
    comp, size = brute_force(rows, width)
    want = [(d, n, c, d is None or d == c) for (d, _), n, c in zip(rows, size, comp, strict=True)]
    assert got == sorted(want, key=str)


def test_chains_groups_and_border_cases(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for size in (1, 2, 3, 5, 9, 30, 120, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 2, size // 20, size // 12, size // 9, size // 8, size // 5):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w).upper() if n % 3 == 0 else "\t".join(w)))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(40):  # each like the one before, the ends unlike
        rows.append((n, " ".join(chain)))
        chain[rng.randrange(100)] = rng.choice(vocabulary)
        n += 1
    rng.shuffle(rows)
    _check(spark, rows, 2)


def test_near_similar_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{rng.randrange(9999)}" for _ in range(60)]
    rows = []
    for n in range(90):  # similar to each other at about the threshold
        w = list(base)
        for _ in range(rng.choice((0, 3, 4, 5))):
            w[rng.randrange(60)] = f"v{rng.randrange(9999)}"
        rows.append((n, " ".join(w)))
    _check(spark, rows, 2)


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=2).collect()), key=str)
    comp, size = brute_force(rows, 2)
    want = sorted(((d, n, c) for (d, _), n, c in zip(rows, size, comp, strict=True)), key=str)
    assert got == want
    left = neardup.without_copies(docs, width=5)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {0, 10, 11, 12, 15} <= set(ids) and not {13, 16} & set(ids)
    assert neardup.near_duplicates(no_documents(spark)).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp, _ = brute_force(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2).collect()}
    assert got == {d: c for (d, _), c in zip(rows, comp, strict=True)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        for n in (40, 300, 5000):
            errors = []
            for _ in range(30):
                pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
                both = round(2 * n * share / (1 + share))
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
                r = neardup.hyper_registers([a, b])
                true = both / (2 * n - both)
                errors.append(neardup.estimate(np.array([(r[0] == r[1]).sum()]), np.array([n]), np.array([n]))[0] - true)
            assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e if find(x) != x}
