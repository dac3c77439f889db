from __future__ import annotations

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from sensorloom.llm import merkle, queries
from sensorloom.llm.common import crc_mod

from ..compare import connect, mismatch
from .data import SF, awkward_documents, no_documents


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **changed) -> str:
    values = {f: row[f] for f in merkle.FIELDS} | changed
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values.values()])


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(levels: list[list[str]], place: int) -> list[tuple[str | None, int]]:
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other] if other < len(level) else None, place & 1))
        place >>= 1
    return out


def climbed(node: str, path) -> str:
    for other, right in path:
        node = H(node) if other is None else H(other, node) if right else H(node, other)
    return node


def by_hand(rows) -> list[tuple]:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: levels_of([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    top = levels_of([built[k][-1][0] for k in order])
    out = []
    for t, k in enumerate(order):
        for place, (known, _, leaf, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            path = path_of(built[k], place) + path_of(top, t)
            found = leaf
            if known and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None:
                found = leaf_of(r, n_chars=r.n_chars + 1)
            root = climbed(found, path)
            proof = sha256("".join(s for s, _ in path if s).encode()).hexdigest()
            out.append((r.doc_id, leaf, built[k][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return out


def _got(docs, **sizes):
    later = crc_mod(F.col("doc_id"), 7) == 0, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    rows = merkle.verify(merkle.manifest(docs, altered=later, **sizes))
    return [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.collect()]


def test_sql(spark):
    assert mismatch(queries.op12(spark, SF), connect(SF), queries.ORACLES["op12_merkle_manifest"]) is None


def test_every_shape_of_tree(spark):
    # Blocks of two and rounds of two to four: up to five rounds, ragged last subtrees, listeners.
    for n, block, fanout in ((1, 2, 2), (2, 2, 2), (3, 2, 2), (9, 2, 2), (33, 2, 2), (67, 2, 4), (130, 2, 4)):
        rows = [(i, f"t{i}", lang, None, i) for lang, m in (("en", n), (None, n // 2 + 1), ("é", 1)) for i in range(m)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(_got(docs, block=block, fanout=fanout), key=str) == sorted(by_hand(docs.collect()), key=str), (n, block, fanout)


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    assert sorted(_got(docs), key=str) == sorted(by_hand(docs.collect()), key=str)
    assert _got(no_documents(spark)) == []


def test_largest_count_can_be_altered(spark):
    docs = spark.createDataFrame([(i, "a", "en", "s", 2**63 - 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(_got(docs), key=str) == sorted(by_hand(docs.collect()), key=str)
