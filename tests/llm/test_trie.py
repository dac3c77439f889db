from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import pytest

from sensorloom.llm import queries, trie

from ..compare import connect, mismatch
from .data import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth int, m string, place int, x1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", 2, "x") for r in rows], SCHEMA).repartition(4)


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
            if d:
                kids[built[c][: d - 1]].add(built[c][:d])
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(out[k][5] for k in kids[p]) if kids[p] else 1
        saved = (len(m) - 1) * words + sum(out[k][6] for k in kids[p])
        ends = ",".join(str(c) for c in m if built[c] == p)
        out[p] = (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves, saved, sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def got(df, **sizes):
    return sorted([tuple(r)[:8] for r in trie.prefix_trie(df, **sizes).collect()], key=str)


def test_sql(spark):
    assert mismatch(queries.op11(spark, SF), connect(SF), queries.ORACLES["op11_prefix_trie"]) is None


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "most": 7, "small": 5}])
def test_random_conversations(spark, sizes):
    """Small sizes take blocks of conversations, several rounds of neighbours and coins, and their way back."""
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(-300, 10_000), 150):
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", ""])))
    assert got(table(spark, rows), **sizes) == by_hand(rows)


def test_long_and_common_conversations(spark):
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(700)]  # most of all turns
    rows += [(c, t, "user", f"same {t}") for c in range(100, 260) for t in range(2)]  # copies
    rows += [(c, 0, "user", "same 0") for c in range(1000, 1040)]
    assert got(table(spark, rows), block=64, most=100, small=50) == by_hand(rows)


def test_awkward_rows(spark):
    rows = [(0, None, "user", "first"), (0, 3, None, None), (0, 3, "user", "x  y"), (0, 3, "user", "x  y"), (1, 1, "user", None), (None, 1, "user", "lost"),
            (-21, 0, "a", "b"), (-21, 1, "ab", ""), (21, 0, "a", "b"), (37, 5, "", "é \U0001f600 \x00"), (38, 2, None, "w " * 100_000), (2**63 - 1, 0, "user", "z"),
            (-(2**63), 0, "user", "z"), (5, 0, "user", "only"), (25, 0, "user", "only")]
    assert got(table(spark, rows)) == by_hand(rows)
    assert got(table(spark, rows), block=1, most=3, small=2) == by_hand(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    assert got(table(spark, [(None, 0, "user", "x")])) == []
