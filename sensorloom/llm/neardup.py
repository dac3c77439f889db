"""Operator 3: near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed to 64 bits. The hash range is cut into REGISTERS buckets; a register holds
the number of leading zeros and the first MANTISSA bits after them of the smallest hash in its bucket. Empty registers
borrow from full ones by a fixed probing sequence, so registers of two sets are equal with a chance of about their
Jaccard similarity, also for short documents.

1. Documents with equal sets form a class (128-bit digest of the set); from here on there is one row per class.
2. Bands of registers give buckets. Each class is paired with the first class of each of its buckets; of these pairs,
   that with the highest estimate (share of equal registers less the expected chance collisions) is verified on the full
   sets, and verified pairs are joined to components.
3. In a bucket that still holds several components, the classes outside its largest component visit that component: each
   is verified against the full sets of all its members. Pairs of such classes are estimated, in their first common bucket,
   and verified if within the error of the estimate. Both go in blocks of bounded size on both sides. Thus every pair that
   shares a bucket is in one component, or was decided on its full sets or by its estimate.

With 40 bands of 6, a pair of similarity 0.8 shares no bucket with a chance of 5e-6; the estimate is cut 4.5 standard
errors below the threshold.

Cases: null and empty texts have an empty set and are linked with nothing; with fewer words than a shingle has, the whole
sequence is one shingle; a null id takes no part in links and is kept; rows that repeat an id are linked each by its text;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import ascii_lower, join_counted, mix, pair_hash, sorted_lookup, space_table, text_batches, words_of
from sensorloom.session import spool

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 4.5
# Classes, and shingles, of one side of a group of blocks; both only set how work is cut.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
EDGE_ROWS = 100_000
# Fixed value of the published collision estimate of HyperMinHash.
COLLISION = 0.169919487159739093975315012348

_EDGES = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], np.uint64)
_PROBES = np.random.default_rng(2018).integers(0, REGISTERS, (64, REGISTERS))
_GAP, _LOWER = space_table(), ascii_lower()


def shingle_sets(run: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = words_of(run, _GAP, _LOWER)
    rolled = words
    for k in range(1, width):
        rolled = pair_hash(rolled[: max(0, len(words) - k)], words[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for w in words[a + 1 : b]:
                whole = pair_hash(whole, np.array([w]))
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def hyper_registers(sets: list[np.ndarray]) -> np.ndarray:
    """REGISTERS 16-bit registers of each non-empty set."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    at = np.empty((len(sets), REGISTERS + 1), np.int64)
    shift = 0
    for row, s in zip(at, sets, strict=True):
        row[:-1] = np.searchsorted(s, _EDGES)
        row[-1] = len(s)
        row += shift
        shift += len(s)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    full = at[:, :-1] < at[:, 1:]
    rest = (flat[at[:, :-1]] - _EDGES) * np.uint64(REGISTERS)
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62) + 1
    bits = np.clip((mantissa * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    own = ((zeros << MANTISSA) | bits).astype(np.uint16)
    out, done = np.where(full, own, 0).astype(np.uint16), full.copy()
    for probe in _PROBES:
        row, col = np.nonzero(~done)
        if not len(row):
            return out
        src = probe[col]
        ok = full[row, src]
        out[row[ok], col[ok]] = own[row[ok], src[ok]]
        done[row[ok], col[ok]] = True
    for row in np.unique(np.nonzero(~done)[0]):  # the next full register to the right
        there = np.flatnonzero(full[row])
        miss = np.flatnonzero(~done[row])
        out[row, miss] = own[row, there[np.searchsorted(there, miss) % len(there)]]
    return out


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the expected number of chance collisions."""
    big, small = np.maximum(n_a, n_b) / REGISTERS, np.minimum(n_a, n_b) / REGISTERS
    ratio = 4 * small / np.maximum(big, 1e-9) / (1 + small / np.maximum(big, 1e-9)) ** 2
    chance = COLLISION * REGISTERS * 2.0**-MANTISSA * ratio
    return np.clip((equal - chance) / (REGISTERS - chance), 0.0, 1.0)


def _sketcher(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, run in text_batches(batch["text"]):
                sets = shingle_sets(run, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((2, len(sets)), np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum(sizes[some]) - sizes[some]
                    keys[0, some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    keys[1, some] = np.add.reduceat(mix(flat + np.uint64(0x51ED270B5A5A5A5B)), starts)
                registers: list[bytes | None] = [None] * len(sets)
                for i, r in zip(some, hyper_registers([sets[i] for i in some]), strict=True):
                    registers[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][begin : begin + len(run)],
                        pa.array(sizes),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.array(registers, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "registers"],
                )

    return sketch


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = _stack(batch["registers"]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
            for k in range(ROWS):
                key = pair_hash(key, rows[:, :, k])
            band = np.broadcast_to(np.arange(BANDS, dtype=np.int32), key.shape)
            ids = np.repeat(batch["cls"].to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(band.reshape(-1)), pa.array(key.view(np.int64).reshape(-1))], ["cls", "band", "key"]
            )


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            equal = (_stack(batch["ra"]) == _stack(batch["rb"])).sum(1)
            est = estimate(equal, batch["na"].to_numpy(), batch["nb"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(est)], ["a", "b", "est"])


def _verifier(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            known: dict[int, np.ndarray] = {}
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if a not in known and len(known) > 64:
                    known.clear()
                for i, t in ((a, ta), (b, tb)):
                    if i not in known:
                        known[i] = shingle_sets([(t or "").encode("utf-8", "surrogatepass")], width)[0]
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
            )

    return verify


def _across(percent: int):
    """Pairs of one group of two blocks that lie in different components and may be similar enough."""

    def pairs(group: pa.Table) -> pa.Table:
        cls, root = group["cls"].to_numpy(), group["root"].to_numpy()
        side, size = group["side"].to_numpy(), group["n_shingles"].to_numpy()
        band, same = group["band"][0].as_py(), group["same"][0].as_py()
        regs = _stack(group["registers"])
        right = np.flatnonzero(side == 0)
        left = right if same else np.flatnonzero(side == 1)
        floor = percent / 100 - SIGMAS * np.sqrt(0.16 / REGISTERS)
        found: list[list[np.ndarray]] = [[], [], []]
        for i in left:
            js = right[(root[right] != root[i]) & ((cls[right] > cls[i]) if same else True)]
            low, high = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
            js = js[100 * low >= percent * high]
            if not len(js):
                continue
            equal = regs[js] == regs[i]
            est = estimate(equal.sum(1), size[js], np.full(len(js), size[i]))
            first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            # A short set gives few independent registers: all its pairs are verified.
            good = first & ((est >= floor) | (np.minimum(size[js], size[i]) < REGISTERS // 4))
            js, est = js[good], est[good]
            found[0].append(np.minimum(cls[js], cls[i]))
            found[1].append(np.maximum(cls[js], cls[i]))
            found[2].append(est)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(np.concatenate(x) if x else [], k) for x, k in zip(found, kinds, strict=True)]
        return pa.table(dict(zip(("a", "b", "est"), arrays, strict=True)))

    return pairs


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node of `edges` (a, b) but the roots, by alternating star contraction.

    Each round is written to the shared folder, in files of about EDGE_ROWS; rounds end when only stars are left.
    """
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    files = max(1, -(-now.count() // EDGE_ROWS))

    def keep(df: DataFrame) -> DataFrame:
        return spool(df.coalesce(files))

    while True:
        # A star: every node has one edge to a smaller node, which has none itself.
        ends = now.select("u", F.lit(1).alias("n"), F.lit(0).alias("root")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n + root > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select("v", "u"))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = join_counted(both.where("v > u"), low, "u", "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.distinct())
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join_counted(large, low, "u", "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets are similar enough; only texts of their documents move."""
    ids = spool(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = spool(join_counted(docs.select(F.col("doc_id").alias("id"), "text"), ids, "id", "left_semi"))
    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    held = pairs.select("a", "b").join(a, "a").join(b, "b")
    return spool(held.mapInArrow(_verifier(width, percent), "a long, b long").distinct())


def _visits(width: int, percent: int):
    """The links between the visitors (side 1) and the members (side 0) of one group, one for each visitor."""

    def visit(group: pa.Table) -> pa.Table:
        cls, side = group["cls"].to_numpy(), group["side"].to_numpy()
        sets = [s for _, run in text_batches(group["text"]) for s in shingle_sets(run, width)]
        there = np.array([len(s) > 0 for s in sets], bool)
        members = np.flatnonzero((side == 0) & there)
        links = []
        if len(members):
            flat = np.concatenate([sets[i] for i in members])
            size = np.array([len(sets[i]) for i in members])
            starts = np.cumsum(size) - size
            for v in np.flatnonzero((side == 1) & there):
                mine = sets[v]
                both = np.add.reduceat(sorted_lookup(mine, flat) >= 0, starts, dtype=np.int64)
                ok = np.flatnonzero(100 * both >= percent * (size + len(mine) - both))
                if len(ok):
                    links.append(sorted((int(cls[v]), int(cls[members[ok[0]]]))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return visit


def _blocks(n):
    return F.ceil(n / BLOCK).cast("int")


def _dealt(n):
    return F.pmod(F.xxhash64("cls"), n).cast("int")


def _upto(n):
    return F.sequence(F.lit(0), n - 1)


def _across_components(rows: DataFrame, sketches: DataFrame, roots: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket (`rows`: cls, band, key) that lie in different components."""
    named = roots.withColumnRenamed("node", "cls")
    held = spool(join_counted(rows, named, "cls").select("cls", "band", "key", F.coalesce("root", "cls").alias("root")))
    sizes = held.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("band", "key").agg(F.max_by("root", F.struct("n", "root")).alias("mass"), F.max("n").alias("n_mass"), F.sum("n").alias("n_all"))
    mixed = spool(parts.where("n_all > n_mass").selectExpr("band", "key", "mass", "n_all - n_mass as strays"))
    strays = spool(join_counted(held, mixed, ["band", "key"], "inner").where("root <> mass"))

    # Visitors against all members of the component.
    visitors = spool(strays.select(F.col("mass").alias("of"), "cls").distinct())
    masses = spool(visitors.select("of").distinct())
    members = join_counted(named.select(F.col("root").alias("of"), "cls"), masses, "of", "left_semi").union(masses.select("of", F.col("of").alias("cls")))
    party = members.select("of", "cls", F.lit(0).alias("side")).union(visitors.select("of", "cls", F.lit(1)))
    party = spool(party.join(sketches.select("cls", "n_shingles"), "cls"))
    sizes = party.groupBy("of", "side").agg(F.greatest(_blocks(F.count("*")), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int")).alias("n"))
    counts = spool(sizes.groupBy("of").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("mb"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("vb")))
    ids = spool(party.select(F.col("cls").alias("id")).distinct())
    texts = spool(join_counted(docs.select(F.col("doc_id").alias("id"), "text"), ids, "id", "left_semi").select(F.col("id").alias("cls"), "text"))
    party = join_counted(party, counts, "of", "inner").join(texts, "cls")
    place = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    as_member = F.transform(_upto(F.col("vb")), lambda y: place(_dealt(F.col("mb")), y))
    as_visitor = F.transform(_upto(F.col("mb")), lambda x: place(x, _dealt(F.col("vb"))))
    places = F.explode(F.when(F.col("side") == 0, as_member).otherwise(as_visitor)).alias("to")
    visits = party.select("of", "cls", "side", "text", places).select("of", "to.*", "cls", "side", "text")
    links = spool(visits.groupBy("of", "x", "y").applyInArrow(_visits(width, percent), "a long, b long"))

    # The others among themselves.
    several = strays.where("strays > 1").join(sketches, "cls").withColumn("sb", _blocks(F.col("strays")))
    me = _dealt(F.col("sb"))
    spot = lambda side, same, x, y: F.struct(side.alias("side"), F.lit(same).alias("same"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    others = F.transform(F.filter(_upto(F.col("sb")), lambda o: o != me), lambda o: spot(F.when(me < o, 0).otherwise(1), False, F.least(me, o), F.greatest(me, o)))
    places = F.explode(F.concat(others, F.array(spot(F.lit(0), True, me, me)))).alias("to")
    common = ["band", "key", "cls", "root", "n_shingles", "registers"]
    near = several.select(*common, places).select(*common, "to.*").groupBy("band", "key", "x", "y").applyInArrow(_across(percent), "a long, b long, est double")
    return links.union(_verified(spool(near.select("a", "b").distinct()), docs, width, percent))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, of every row of `docs` (doc_id, text)."""
    every = spool(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketcher(width), "doc_id long, n_shingles long, k1 long, k2 long, registers binary"))
    taking = every.where("n_shingles > 0 and doc_id is not null")
    groups = taking.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = spool(groups)

    bands = classes.select("cls", "registers").mapInArrow(_bands, "cls long, band int, key long")
    shared = spool(bands.groupBy("band", "key").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = spool(join_counted(bands, shared, ["band", "key"], "inner"))

    # First pass: of each class, the most similar of the heads of its buckets.
    pairs = rows.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    active = spool(rows.select("cls").distinct())
    sketches = spool(join_counted(classes.select("cls", "n_shingles", "registers"), active, "cls", "left_semi"))
    one = lambda x: sketches.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    guessed = spool(spool(pairs).join(one("a"), "a").join(one("b"), "b").mapInArrow(_estimates, "a long, b long, est double"))
    best = spool(guessed.groupBy("b").agg(F.max_by("a", "est").alias("a")).select("a", "b"))
    links = _verified(best, docs, width, percent)
    roots = components(links)

    # Second pass: across the components that share a bucket.
    late = _across_components(rows, sketches, roots, docs, width, percent)
    roots = components(links.union(late)).withColumnRenamed("node", "cls")

    named = join_counted(classes.select("k1", "k2", "cls"), roots, "cls").select("k1", "k2", F.coalesce("root", "cls").alias("root"))
    out = join_counted(every.select("doc_id", "n_shingles", "k1", "k2"), spool(named), ["k1", "k2"])
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that stay: one document of each component, each id once."""
    gone = spool(near_duplicates(docs, **how).where("not kept").select("doc_id").distinct())
    left = join_counted(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    again = spool(left.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return left
    once = join_counted(left, again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return join_counted(left, again, "doc_id", "left_anti").unionByName(once)
