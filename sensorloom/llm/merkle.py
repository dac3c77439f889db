"""Operator 12: Merkle manifest of a table by butterfly exchange.

Each row is a leaf, the SHA-256 of its fields; the leaves of a tree (rows of one key, by id) are hashed in pairs up to the
tree's root, the trees' roots likewise up to one root. A row's proof is the siblings of its path, bottom up.

Leaves are numbered per tree and cut into aligned blocks of BLOCK leaves; a block is a subtree that one task hashes. Above,
blocks exchange subtree roots as in a butterfly network: in round t the blocks whose numbers differ only in digit t (base
FANOUT) meet, at most FANOUT of them; each receives the roots of the others, hashes the ancestors that they share and takes
its own siblings from them. Every member hashes the same ancestors again, so after the last round each block holds its
upper proof and the root, and nothing has to be sent down. A ragged last subtree has fewer blocks than others have places;
there, listeners (block numbers without leaves, at most as many as blocks) take part, so that each place finds a block that
knows the subtree's root. Groups never exceed FANOUT rows, blocks BLOCK leaves, whatever a key holds.

A lone last node of a level is hashed alone; a lone leaf is its tree's root. All digests are hashed as lowercase hex.

Cases: a null field is hashed as `-`, others as their UTF-8 length, a colon and the value, so null, empty and joined fields
differ; a null key is a tree of its own, first in order; rows of one id are ordered by their digest, a null id comes first;
repeated rows are leaves each; an empty table gives no rows. Extra columns are neither read nor hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import join_counted
from sensorloom.llm.ordered import number_within, same_keys
from sensorloom.session import spool

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Leaves of a block and subtree roots that meet in a round; both powers of two.
BLOCK = 1024
FANOUT = 64


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of a row's fields, each with its length in bytes, as 32 bytes."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def height(nodes: int) -> int:
    """Levels above `nodes` nodes until one is left."""
    return (nodes - 1).bit_length()


def climb(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and `levels` levels above them, as hex text."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha256(b"".join(below[i : i + 2])).hexdigest().encode() for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[bytes]], place: int) -> bytes:
    """Siblings of the node at `place` on all but the last of `levels`, 32 bytes each."""
    return b"".join(bytes.fromhex(levels[k][p].decode()) for k in range(len(levels) - 1) if (p := (place >> k) ^ 1) < len(levels[k]))


def fold(leaf: bytes, proof: bytes, places: Sequence[tuple[int, int]]) -> str:
    """Root that a leaf and a proof give; `places` has the place and the number of nodes of each tree, bottom up."""
    node, at = leaf.hex().encode(), 0
    for place, nodes in places:
        while nodes > 1:
            if place ^ 1 < nodes:
                other = proof[at : at + 32].hex().encode()
                at += 32
                node = other + node if place & 1 else node + other
            node = sha256(node).hexdigest().encode()
            place, nodes = place >> 1, (nodes + 1) >> 1
    return node.decode()


def _runs(batches: Iterator[pa.RecordBatch], begins) -> Iterator[list[dict]]:
    """Rows of sorted batches in runs; `begins` tells whether a row is the first of its run."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and begins(row):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _block_roots(block: int):
    schema = pa.schema([("tree", pa.string()), ("total", pa.int64()), ("block", pa.int64()), ("node", pa.binary())])

    def roots(batches):
        def rows():
            for run in _runs(batches, lambda r: r["place"] % block == 0):
                top = climb([r["leaf"].hex().encode() for r in run], min(height(block), height(run[0]["total"])))[-1]
                yield run[0]["tree"], run[0]["total"], run[0]["place"] // block, bytes.fromhex(top[0].decode())

        return _batched(rows(), schema)

    return roots


def _meet(levels_done: int, fanout: int, block: int):
    """One round: each run holds the blocks that differ in one digit; each member leaves with the root that they share."""
    schema = pa.schema([("tree", pa.string()), ("total", pa.int64()), ("block", pa.int64()), ("node", pa.binary()), ("proof", pa.binary())])

    def meet(batches):
        def rows():
            for run in _runs(batches, lambda r: r["digit"] == 0):
                blocks = -(-run[0]["total"] // block)
                known = [r["node"].hex().encode() for r in run if r["node"] is not None]
                if not known:  # listeners beyond the last subtree
                    yield from ((r["tree"], r["total"], r["block"], None, b"") for r in run)
                    continue
                levels = climb(known, max(0, min(height(fanout), height(blocks) - levels_done)))
                root = bytes.fromhex(levels[-1][0].decode())
                for r in run:
                    own = siblings(levels, r["digit"]) if r["node"] is not None else b""
                    yield r["tree"], r["total"], r["block"], root, r["proof"] + own

        return _batched(rows(), schema)

    return meet


def exchange(roots: DataFrame, block: int, fanout: int) -> DataFrame:
    """Upper proof and root of each block: (tree, total, block, node, proof); `roots` has (tree, total, block, node)."""
    roots = spool(roots)
    blocks = F.expr(f"(total + {block - 1}) div {block}")
    trees = roots.where("block = 0").select("tree", "total", blocks.alias("blocks"))
    most = trees.agg(F.max("blocks")).first()[0] or 0
    rounds, stride = 0, 1
    while stride < most:
        rounds, stride = rounds + 1, stride * fanout
    # Listeners fill the last subtree of a tree up to a whole number of its longest stride.
    full = F.lit(1).cast("long")
    for t in range(1, rounds):
        full = F.when(F.col("blocks") > fanout**t, F.lit(fanout**t).cast("long")).otherwise(full)
    padded = F.col("blocks") + F.pmod(-F.col("blocks"), full)
    extra = F.explode(F.sequence(F.col("blocks"), padded - 1)).alias("block")
    listeners = trees.where(padded > F.col("blocks")).select("tree", "total", extra, F.lit(None).cast("binary").alias("node"))
    state = roots.unionByName(listeners).withColumn("proof", F.lit(b""))
    for t in range(rounds):
        stride = fanout**t
        digits = state.selectExpr("*", f"block div {stride * fanout} as high", f"block % {stride} as low", f"block div {stride} % {fanout} as digit")
        dealt = digits.repartition("tree", "high", "low").sortWithinPartitions("tree", "high", "low", "digit")
        met = dealt.select("tree", "total", "block", "node", "proof", "digit").mapInArrow(
            _meet(t * height(fanout), fanout, block), "tree string, total long, block long, node binary, proof binary"
        )
        state = spool(met)
    return state.where(F.col("block") < blocks)


def _leaf_proofs(block: int):
    schema = pa.schema([("id", pa.int64()), ("tree", pa.string()), ("place", pa.int64()), ("total", pa.int64()), ("leaf", pa.binary()),
                        ("altered", pa.binary()), ("subroot", pa.binary()), ("proof", pa.binary())])

    def proofs(batches):
        def rows():
            for run in _runs(batches, lambda r: r["kind"] == 0):
                top, leaves = run[0], run[1:]
                levels = climb([r["leaf"].hex().encode() for r in leaves], min(height(block), height(top["total"])))
                for k, r in enumerate(leaves):
                    yield r["id"], r["tree"], r["place"], r["total"], r["leaf"], r["altered"], top["leaf"], siblings(levels, k) + top["proof"]

        return _batched(rows(), schema)

    return proofs


def tree_proofs(leaves: DataFrame, *, block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """Trees over stored leaves (tree string, id long, leaf and altered binary): each leaf with place, total, subroot, proof.

    `altered` comes along untouched; `subroot` is the root of the leaf's tree, `proof` the siblings up to it.
    """
    numbered = spool(number_within(leaves, ["tree"], ["id", "leaf"]).selectExpr("*", f"place div {block} as block"))
    dealt = numbered.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").select("tree", "total", "place", "leaf")
    roots = dealt.mapInArrow(_block_roots(block), "tree string, total long, block long, node binary")
    upper = exchange(roots, block, fanout)
    columns = ["tree", "total", "block", "kind", "place", "id", "leaf", "altered", "proof"]
    nothing = F.lit(None).cast("binary")
    tops = upper.select("tree", "total", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"),
                        F.lit(None).cast("long").alias("id"), F.col("node").alias("leaf"), nothing.alias("altered"), "proof")
    rows = numbered.withColumns({"kind": F.lit(1), "proof": nothing}).select(columns)
    both = tops.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "place")
    out = "id long, tree string, place long, total long, leaf binary, altered binary, subroot binary, proof binary"
    return both.mapInArrow(_leaf_proofs(block), out)


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    *,
    tree: str = "lang",
    id_col: str = "doc_id",
    altered: tuple[Column, Mapping[str, Column]] | None = None,
    block: int = BLOCK,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row: id, tree, place, total, leaf, altered, subroot, proof (up to the tree's root), tree_place, trees,
    tree_proof (from there to the root), root; digests are binary, proofs 32 bytes a sibling.

    `altered` is a condition and the fields that differ where it holds: the digest of such a row as found later.
    """
    mine = [F.col(f) for f in fields]
    when, changed = altered or (F.lit(False), {})
    later = F.when(when, digest([changed.get(f, F.col(f)) for f in fields]))
    leaves = spool(rows.select(F.col(tree).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), digest(mine).alias("leaf"), later.alias("altered")))
    proofs = spool(tree_proofs(leaves, block=block, fanout=fanout))
    # The trees' roots are the leaves of one more tree, in order of the key.
    subroots = spool(proofs.where("place = 0").select("tree", "subroot"))
    ranked = number_within(subroots, [], ["tree"])
    nodes = spool(ranked.select(F.lit("").alias("tree"), F.col("place").alias("id"), F.col("subroot").alias("leaf"), F.col("tree").cast("binary").alias("altered")))
    over = tree_proofs(nodes, block=block, fanout=fanout)
    over = spool(
        over.select(F.col("altered").cast("string").alias("tree"), F.col("place").alias("tree_place"), F.col("total").alias("trees"),
                    F.col("proof").alias("tree_proof"), F.col("subroot").alias("root"))
    )
    return join_counted(proofs.alias("a"), over.alias("b"), same_keys("a", "b", ["tree"]), "inner").select("a.*", "tree_place", "trees", "tree_proof", "root")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("tree", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                proof = r["proof"] + r["tree_proof"]
                root = r["root"].hex()
                found = r["leaf"] if r["altered"] is None else r["altered"]
                folded = fold(found, proof, [(r["place"], r["total"]), (r["tree_place"], r["trees"])])
                yield r["id"], r["tree"], r["leaf"].hex(), r["subroot"].hex(), root, sha256(proof.hex().encode()).hexdigest(), folded, folded == root

    return _batched(rows(), schema)


def verify(proofs: DataFrame) -> DataFrame:
    """Fold each row's digest as found (`altered`, else its leaf) with its proof, and compare with the root."""
    out = "id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs.mapInArrow(_check, out)
