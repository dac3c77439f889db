"""Operator 11: prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of the first d turns; it is named by its smallest member and d. Prefixes are compared by two
64-bit sums (exclusive or) of hashes of (place, turn), taken from running sums in blocks of a conversation, so a conversation
of any length is spread over tasks, and a group of equal prefixes is reduced before it is shuffled.

Each node has an arc that enters it and one that leaves it. One pass over nodes and children, range-partitioned by the
prefix they belong to, gives each arc its successor: the first child or the own exit after an entry, the next sibling's entry
or the parent's exit after an exit. Children of one node are spread over tasks as its records are; the first and last row of
each partition carry what crosses a border. The list of arcs is ranked by contraction: partitions of neighbouring arcs join
their stretches, and where that gains little, arcs with a head on a tossed coin absorb a following arc with a tail, until at
most SMALL stretches are left for one task; then the sums go back, round by round. What is summed along the tour are places,
leaves and savings, so a subtree's figures are the difference between a node's exit and its entry.

Cases: null role or text is empty; turns go null first, rows of one turn by the MD5 of role and text; repeated rows are
turns each; rows without conv_id take no part; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import WORD, join_counted
from sensorloom.llm.ordered import number_within
from sensorloom.session import spool

# Conversations share the first turns of the one whose id ends a run of so many; at most MOST_SHARED turns.
RUN_OF_IDS = 20
MOST_SHARED = 3

# Turns of a block of a conversation, arcs that a task joins at once, stretches left for one task.
BLOCK = 4096
ARCS = 1 << 18
SMALL = 20_000

_NAME = ["m", "d", "k"]  # smallest member, depth, 0 for entry and 1 for exit
_NEXT = ["nm", "nd", "nk"]
_SUMS = ["place", "leaves", "saved"]


def rebuilt_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Prefixes of the rebuilt conversations, the empty one included: (conv_id, depth, x1, x2, p1, p2, words, ends).

    (x1, x2) stands for the turns so far, (p1, p2) for those without the last; `ends` marks the whole conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    turns = spool(number_within(spool(slim), ["conv_id"], ["turn", "digest"]).drop("turn"))

    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    first = turns.where(f"conv_id % {RUN_OF_IDS} = 0 and place < {MOST_SHARED}").groupBy("conv_id")
    first = first.agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("lead"))  # three at most
    convs = turns.where("place = 0").select("conv_id", "total", shared.alias("h"), F.expr(f"conv_id - conv_id % {RUN_OF_IDS}").alias("base"))
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h").cast("int")), F.expr("array()"))
    convs = spool(convs.select("conv_id", "total", "h", lead.alias("lead"), F.size(lead).cast("long").alias("n")))

    def marks(place: Column, digest: Column) -> tuple[Column, Column]:
        return F.xxhash64(place, digest), F.xxhash64(digest, place, F.lit(20))

    def of_lead(side: int, upto: Column) -> Column:
        head = F.slice("lead", F.lit(1), upto.cast("int"))
        return F.aggregate(head, F.lit(0).cast("long"), lambda sofar, t: sofar.bitwiseXOR(marks(t["place"] + 1, t["digest"])[side]))

    depth, n = F.col("depth"), F.col("n")
    own_left = F.col("total") > F.col("h")
    from_base = convs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("depth"))
    before = F.greatest(depth - 1, F.lit(0))
    from_base = from_base.select(
        "conv_id", "depth", of_lead(0, depth).alias("x1"), of_lead(1, depth).alias("x2"), of_lead(0, before).alias("p1"), of_lead(1, before).alias("p2"),
        F.coalesce(F.get(F.col("lead.words"), (depth - 1).cast("int")), F.lit(0).cast("long")).alias("words"), ((depth == n) & ~own_left).alias("ends"),
    )

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {block}"))).alias("block")
    infos = convs.where(own_left).select("conv_id", "h", "n", of_lead(0, n).alias("b1"), of_lead(1, n).alias("b2"), blocks)
    own = turns.withColumn("block", F.expr(f"place div {block}")).join(infos, ["conv_id", "block"]).where("place >= h")
    own = own.withColumn("depth", F.col("place") - F.col("h") + n + 1)
    f1, f2 = marks(depth, F.col("digest"))
    own = own.withColumn("f1", f1).withColumn("f2", f2)
    # Conversations of several blocks: what the blocks before add, one row a block.
    totals = own.where(F.col("total") > block).groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("t1"), F.bit_xor("f2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = spool(totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(t).over(earlier), zero).alias(t) for t in ("t1", "t2")]))
    sofar = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("x1", F.bit_xor("f1").over(sofar)).withColumn("x2", F.bit_xor("f2").over(sofar))
    own = join_counted(own, carried, ["conv_id", "block"])
    for s in ("1", "2"):
        own = own.withColumn(f"x{s}", F.col(f"x{s}").bitwiseXOR(F.col(f"b{s}")).bitwiseXOR(F.coalesce(F.col(f"t{s}"), zero)))
    own = own.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("f1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("f2")).alias("p2"),
                     "words", (F.col("place") == F.col("total") - 1).alias("ends"))
    return spool(from_base.unionByName(own))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one prefix joined by commas, per batch of sorted rows."""
    for b in batches:
        if not b.num_rows:
            continue
        x1, x2, depth, ids = (b[c].to_numpy() for c in ("x1", "x2", "depth", "conv_id"))
        cuts = np.flatnonzero(np.r_[True, (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1]) | (depth[1:] != depth[:-1])])
        text = [",".join(map(str, g.tolist())) for g in np.split(ids, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[cuts]) for a in (x1, x2, depth, ids)] + [pa.array(text, pa.string())], ["x1", "x2", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each prefix's pieces, which come in order; one piece is held at a time."""
    schema = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    now, state, done = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for top in range(0, b.num_rows, 256):
            for r in b.slice(top, 256).to_pylist():
                key = (r["x1"], r["x2"], r["depth"])
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, sha256()
                state.update(r["ids"].encode())
        if done:
            yield batch()
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
        yield batch()


def nodes_of(steps: DataFrame) -> DataFrame:
    """Nodes of the trie: (x1, x2, depth, p1, p2, m, n_convs, words, ends_sha256)."""
    parts = max(1, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["x1", "x2", "depth"]
    nodes = steps.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("p1", "p2", "words")], F.min("conv_id").alias("m"), F.count("*").alias("n_convs"))
    ends = steps.where("ends").select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = ends.mapInArrow(_pieces, "x1 long, x2 long, depth long, first long, ids string")
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    shas = pieces.mapInArrow(_digests, "x1 long, x2 long, depth long, ends_sha256 string")
    return spool(nodes.join(shas, key, "left").fillna({"ends_sha256": sha256(b"").hexdigest()}))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Following record of the same prefix, and the parent, for sorted records; what lies beyond the partition stays open."""
    part = TaskContext.get().partitionId()
    held: dict[str, np.ndarray] | None = None
    parent: tuple | None = None  # of the last record with kind 0
    first = True
    names = ["k1", "k2", "kd", "kind", "m", "saved"]

    def out(rows: dict[str, np.ndarray], upto: int, last: bool) -> pa.RecordBatch:
        nonlocal parent, first
        n = len(rows["m"])
        same = np.zeros(n, bool)
        same[:-1] = (rows["k1"][1:] == rows["k1"][:-1]) & (rows["k2"][1:] == rows["k2"][:-1]) & (rows["kd"][1:] == rows["kd"][:-1])
        following = np.append(rows["m"][1:], 0)
        at = np.maximum.accumulate(np.where(rows["kind"] == 0, np.arange(n), -1))
        above = np.where(at >= 0, rows["m"][at], parent if parent is not None else 0)
        known = (at >= 0) | (parent is not None)
        begins, closes = np.zeros(n, bool), np.zeros(n, bool)
        begins[0], closes[-1] = first, last
        if upto:
            first = False
            if at[upto - 1] >= 0:
                parent = rows["m"][at[upto - 1]]
        cut = slice(0, upto)
        cols = [pa.array(rows[c][cut]) for c in names]
        cols += [pa.array(same[cut]), pa.array(following[cut]), pa.array(above[cut], mask=~known[cut]), pa.array(begins[cut]), pa.array(closes[cut])]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(upto, part, np.int32))], [*names, "same", "following", "above", "begins", "closes", "part"])

    for b in batches:
        if not b.num_rows:
            continue
        new = {c: b[c].to_numpy(zero_copy_only=False) for c in names}
        rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
        yield out(rows, len(rows["m"]) - 1, False)
        held = {c: rows[c][-1:] for c in names}
    if held is not None:
        yield out(held, 1, True)


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs with successor and what they add to the sums, and the parent of each node but the root; both stored."""
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    saved = (F.col("n_convs") - 1) * F.col("words")
    own = nodes.select(F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.col("depth").alias("kd"), F.lit(0).alias("kind"), "m", saved.alias("saved"))
    child = nodes.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("kd"), F.lit(1).alias("kind"), "m", F.lit(0).cast("long").alias("saved"))
    keys = ["k1", "k2", "kd", "kind", "m"]
    dealt = own.unionByName(child).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    shape = "k1 long, k2 long, kd long, kind int, m long, saved long, same boolean, following long, above long, begins boolean, closes boolean, part int"
    links = spool(dealt.mapInArrow(_links, shape))

    # Two rows a partition tell what crosses the borders.
    edge = links.where("begins or closes").select("part", "k1", "k2", "kd", "m", "kind", "above", "begins", "closes").collect()
    firsts, lasts = {r.part: r for r in edge if r.begins}, {r.part: r for r in edge if r.closes}
    order, fixes, above = sorted(firsts), [], None
    for i, p in enumerate(order):
        here, then = lasts[p], firsts[order[i + 1]] if i + 1 < len(order) else None
        same = then is not None and (here.k1, here.k2, here.kd) == (then.k1, then.k2, then.kd)
        fixes.append((p, above, same, then.m if same else None))
        above = here.above if here.above is not None else above
    fix = F.broadcast(spark.createDataFrame(fixes, "part int, carried long, goes_on boolean, next_m long"))
    links = links.join(fix, "part").select(
        "kind", "m", F.when(F.col("kind") == 0, F.col("kd")).otherwise(F.col("kd") + 1).alias("d"), "saved",
        F.when(F.col("closes"), F.col("goes_on")).otherwise(F.col("same")).alias("same"),
        F.when(F.col("closes"), F.col("next_m")).otherwise(F.col("following")).alias("following"),
        F.coalesce("above", "carried").alias("parent"),
    )
    enters, zero = F.col("kind") == 0, F.lit(0).cast("long")
    same, d = F.col("same"), F.col("d")
    successor = F.when(same, F.struct(F.col("following").alias("nm"), F.when(enters, d + 1).otherwise(d).alias("nd"), F.lit(0).alias("nk"))).otherwise(
        F.struct(F.when(enters, F.col("m")).otherwise(F.col("parent")).alias("nm"), F.when(enters, d).otherwise(d - 1).alias("nd"), F.lit(1).alias("nk"))
    )
    arcs = links.select("m", "d", F.col("kind").alias("k"), successor.alias("next"), F.when(enters & ~same, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    arcs = arcs.select("m", "d", "k", "next.*", F.lit(1).cast("long").alias("place"), "leaves", "saved")
    root = nodes.where("depth = 0").select(
        "m", zero.alias("d"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("nm"), F.lit(None).cast("long").alias("nd"), F.lit(None).cast("int").alias("nk"),
        F.lit(1).cast("long").alias("place"), zero.alias("leaves"), zero.alias("saved"),
    )
    return spool(arcs.unionByName(root)), links.where("kind = 1").select("m", "d", "parent")


def _join_stretches(most: int):
    """Join the stretches of the list that lie in a run of `most` arcs: each arc's head and sums since it; the tail's rest."""

    def joined(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([(c, "ascending") for c in _NAME]).combine_chunks()
        m, d, k = (rows[c].to_numpy().astype(np.int64) for c in _NAME)
        nm, nd, nk = (rows[c].fill_null(-1).to_numpy().astype(np.int64) for c in _NEXT)
        more = rows["nk"].is_valid().to_numpy()
        weight = np.stack([rows[c].to_numpy() for c in _SUMS], axis=1)
        n, ids, deepest = len(m), np.unique(m), int(d.max()) + 1
        code = (np.searchsorted(ids, m) * deepest + d) * 2 + k
        at = np.searchsorted(ids, nm)
        here = more & (at < len(ids)) & (nd < deepest)
        here[here] = ids[at[here]] == nm[here]
        wanted = np.where(here, (at * deepest + nd) * 2 + nk, -1)
        place = np.minimum(np.searchsorted(code, wanted), n - 1)
        inside = here & (code[place] == wanted)
        head = np.arange(n)
        head[place[inside]] = np.flatnonzero(inside)
        since = np.where((head != np.arange(n))[:, None], weight[head], 0)
        while True:
            further = head[head]
            if np.array_equal(further, head):
                break
            since += since[head]
            head = further
        total = since + weight
        cols = [pa.array(m), pa.array(d), pa.array(k.astype(np.int32)), pa.array(m[head]), pa.array(d[head]), pa.array(k[head].astype(np.int32))]
        cols += [pa.array(since[:, i]) for i in range(3)]
        gone = ~more
        cols += [pa.array(~inside), pa.array(nm, mask=gone), pa.array(nd, mask=gone), pa.array(nk.astype(np.int32), mask=gone)]
        cols += [pa.array(total[:, i]) for i in range(3)]
        return pa.RecordBatch.from_arrays(cols, [*_NAME, "hm", "hd", "hk", *_SUMS, "tail", *_NEXT, *[f"t_{c}" for c in _SUMS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= most:
                yield joined(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


_STRETCH = "m long, d long, k int, hm long, hd long, hk int, place long, leaves long, saved long, tail boolean, nm long, nd long, nk int, t_place long, t_leaves long, t_saved long"


def _neighbours(arcs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Shorter list, and each arc's head and sums since it, from arcs dealt by name."""
    parts = max(1, int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = arcs.repartitionByRange(parts, *_NAME).sortWithinPartitions(*_NAME)
    found = spool(dealt.mapInArrow(_join_stretches(most), _STRETCH))
    left = found.where("tail").select(F.col("hm").alias("m"), F.col("hd").alias("d"), F.col("hk").alias("k"), *_NEXT, *[F.col(f"t_{c}").alias(c) for c in _SUMS])
    return left, found.select(*_NAME, "hm", "hd", "hk", *_SUMS)


def _coins(arcs: DataFrame, toss: int) -> tuple[DataFrame, DataFrame]:
    """Shorter list, and head and sums of every arc, where arcs with a head absorb a following arc with a tail."""

    def heads(names: list[str]) -> Column:
        return F.xxhash64(*names, F.lit(toss)).bitwiseAND(F.lit(1)) == 1

    more = F.col("nk").isNotNull()
    takes = heads(_NAME) & more & ~heads(_NEXT)
    takers = arcs.where(takes).select(*[F.col(c).alias(f"h{c}") for c in _NAME], *[F.col(n).alias(c) for n, c in zip(_NEXT, _NAME, strict=True)], *[F.col(c).alias(f"h_{c}") for c in _SUMS])
    met = spool(arcs.where(~heads(_NAME)).join(takers, _NAME, "left"))
    taken = F.col("hk").isNotNull()
    name = [F.coalesce(f"h{c}", c).alias(c) for c in _NAME]
    merged = met.select(*name, *_NEXT, *[(F.col(c) + F.coalesce(f"h_{c}", F.lit(0))).alias(c) for c in _SUMS])
    rest = arcs.where(heads(_NAME) & ~takes)
    zero = F.lit(0).cast("long")
    itself = [F.col(c).alias(f"h{c}") for c in _NAME]
    within = met.where(taken).select(*_NAME, *[f"h{c}" for c in _NAME], *[F.col(f"h_{c}").alias(c) for c in _SUMS])
    stay = merged.unionByName(rest.select(merged.columns))
    return stay, within.unionByName(stay.select(*_NAME, *itself, *[zero.alias(c) for c in _SUMS]))


def list_sums(arcs: DataFrame, *, most: int = ARCS, small: int = SMALL) -> DataFrame:
    """Sums of all arcs before each arc of a stored list: (m, d, k, place, leaves, saved).

    `arcs` has a name (m, d, k), the next arc's name (null for the last) and what the arc adds.
    """
    rounds, left, coins = [], arcs, 0
    n = left.count()
    gained = True
    while n > small:
        left, within = _neighbours(left, most) if gained else _coins(left, coins)
        coins += not gained
        rounds.append(within)
        left, before = spool(left), n
        n = left.count()
        gained = n <= before // 2 if gained else coins % 4 == 0
    # At most `small` arcs: one task joins them to the one stretch that they are.
    ranks = spool(left.coalesce(1).mapInArrow(_join_stretches(small + 1), _STRETCH).select(*_NAME, *_SUMS))
    for within in reversed(rounds):
        heads = ranks.select(*[F.col(c).alias(f"h{c}") for c in _NAME], *[F.col(c).alias(f"h_{c}") for c in _SUMS])
        both = join_counted(within, heads, ["hm", "hd", "hk"], "inner")
        ranks = spool(both.select(*_NAME, *[(F.col(c) + F.col(f"h_{c}")).alias(c) for c in _SUMS]))
    return ranks


def prefix_trie(conversations: DataFrame, *, block: int = BLOCK, most: int = ARCS, small: int = SMALL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enters, exits.

    `enters` and `exits` are the places of the node's arcs in the tour.
    """
    nodes = nodes_of(rebuilt_turns(conversations, block))
    arcs, parents = tour(nodes)
    sums = list_sums(arcs, most=most, small=small)
    # Everything known of a node, one row a fact, meets by the node's name.
    facts = {"parent": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved": "long", "enters": "long", "exits": "long", "ends_sha256": "string"}

    def said(rows: DataFrame, m: str, d: Column, **known: Column) -> DataFrame:
        return rows.select(F.col(m).alias("m"), d.alias("d"), *[known.get(f, F.lit(None)).cast(t).alias(f) for f, t in facts.items()])

    sign = F.when(F.col("k") == 1, 1).otherwise(-1)
    entry, way_out = F.when(F.col("k") == 0, F.col("place")), F.when(F.col("k") == 1, F.col("place"))
    told = [
        said(nodes, "m", F.col("depth"), n_convs=F.col("n_convs"), ends_sha256=F.col("ends_sha256")),
        said(sums, "m", F.col("d"), n_leaves=sign * F.col("leaves"), saved=sign * F.col("saved"), enters=entry, exits=way_out),
        said(parents, "m", F.col("d"), parent=F.col("parent")),
        said(parents, "parent", F.col("d") - 1, n_children=F.lit(1)),
    ]
    both = told[0]
    for more in told[1:]:
        both = both.unionByName(more)
    summed = [F.sum(c).alias(c) for c in ("n_leaves", "saved")]
    one = [F.max(c).alias(c) for c in ("parent", "n_convs", "enters", "exits", "ends_sha256")]
    out = both.groupBy("m", "d").agg(*one, *summed, F.coalesce(F.sum("n_children"), F.lit(0).cast("long")).alias("n_children"))
    return out.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), "ends_sha256", "enters", "exits")
