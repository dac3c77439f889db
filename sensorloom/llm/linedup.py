"""Operator 9: line deduplication by a log-template tree.

Lines are cut into words; words with a digit are variable fields. A tree of fixed depth sends a line to a leaf by its
number of words and its leading words. Inside a leaf, lines meet templates one by one: a line joins the template that
agrees with it in most places, if these are `similarity` of all, and places that differ become variable; otherwise it
begins a template. Lines of a template that occurs in `min_docs` documents or more are dropped, in all of them.

Only different lines of leaves that several documents share are held against templates, in chunks of bounded size; where
a leaf has several chunks, their templates are merged in the same way until one chunk holds them, or nothing merges. Then
every pair of its chunks meets; templates that match one of a smaller code join it, and the rest meets again, until no two
templates of a leaf match.

Documents that are copies share all their lines: remove copies first where one of them should stay whole.

Cases: null texts stay null, with no lines; empty and white lines are never dropped; rows equal in id and text count as
one document and are cleaned alike; null ids are ids like others; an empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import hash_words, join_counted, space_table
from sensorloom.session import spool

DEPTH = 3
CHUNK = 2_000
FIELD = "<*>"

_DIGIT = re.compile(r"[0-9]")
_GAP, _SAME = space_table(), np.arange(256, dtype=np.uint8)
_FIELD_HASH = hash_words(np.frombuffer(FIELD.encode(), np.uint8), _GAP, _SAME)[1][0]


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def masked(line: str) -> list[str]:
    """The words of a line, variable fields replaced."""
    words = line.split()
    return [FIELD if _DIGIT.search(w) else w for w in words] if _DIGIT.search(line) else words


def _split(depth: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["id", "hash", "line", "leaf", "code", "words"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for doc, code, text in zip(*(batch[c].to_pylist() for c in ("id", "hash", "text")), strict=True):
                for n, line in enumerate((text or "").split("\n")):
                    words = masked(line)
                    if words:
                        whole = " ".join(words)
                        rows.append((doc, code, n, _code(f"{len(words)} {' '.join(words[:depth])}"), _code(whole), whole))
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return split


def templates(lines: list[str], similarity: float) -> tuple[list[int], list[str]]:
    """For each line (of equally many words) the first line of its template, and the template."""
    words = [line.split(" ") for line in lines]
    flat = hash_words(np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), np.uint8), _GAP, _SAME)[1]
    rows = flat.reshape(len(lines), -1)
    fixed = rows != _FIELD_HASH
    made = np.zeros_like(rows)
    firsts: list[int] = []
    of: list[int] = []
    for i, row in enumerate(rows):
        n = len(firsts)
        if n:
            equal = ((made[:n] == row) & fixed[i]).sum(1)
            best = int(equal.argmax())
            if equal[best] >= similarity * rows.shape[1]:
                made[best][made[best] != row] = _FIELD_HASH
                of.append(best)
                continue
        made[n] = row
        firsts.append(i)
        of.append(n)
    text = [" ".join(w if m != _FIELD_HASH else FIELD for w, m in zip(words[f], made[t], strict=True)) for t, f in enumerate(firsts)]
    return [firsts[t] for t in of], [text[t] for t in of]


def _clusters(similarity: float):
    """Groups of rows with one (leaf, chunk), read from sorted partitions."""

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "code", "template", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        group: list[tuple[int, str]] = []
        key, done = None, []

        def close():
            if not group:
                return
            first, text = templates([w for _, w in group], similarity)
            done.extend((key[0], c, group[f][0], t) for (c, _), f, t in zip(group, first, text, strict=True))
            group.clear()

        def out():
            full = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return full

        for batch in batches:
            for leaf, chunk, code, words in zip(*(batch[c].to_pylist() for c in ("leaf", "chunk", "code", "words")), strict=True):
                if (leaf, chunk) != key:
                    close()
                    key = leaf, chunk
                    if len(done) >= 5000:
                        yield out()
                group.append((code, words))
        close()
        if done:
            yield out()

    return cluster


def _meetings(similarity: float):
    """Pairs of templates that match, from sorted partitions of rows with one (leaf, chunk, chunk)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close():
            if not group:
                return None
            side, codes, words = zip(*group, strict=True)
            side, codes = np.array(side), np.array(codes, np.int64)
            rows = hash_words(np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8), _GAP, _SAME)[1].reshape(len(words), -1)
            inside = key[1] == key[2]  # a chunk with itself: each with those behind it
            a, b = np.flatnonzero(side == 0), np.flatnonzero((side == 1) | inside)
            low, high = [], []
            for i in a:
                j = b[((rows[b] == rows[i]) & (rows[i] != _FIELD_HASH)).sum(1) >= similarity * rows.shape[1]]
                j = j[j > i] if inside else j
                low.append(np.minimum(codes[i], codes[j]))
                high.append(np.maximum(codes[i], codes[j]))
            low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high))
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), key[0])), pa.array(low), pa.array(high)], ["leaf", "low", "high"])

        for batch in batches:
            for leaf, a, b, side, code, words in zip(*(batch[c].to_pylist() for c in ("leaf", "a", "b", "side", "code", "words")), strict=True):
                if (leaf, a, b) != key:
                    if (done := close()) is not None:
                        yield done
                    key = leaf, a, b
                group.append((side, code, words))
        if (done := close()) is not None:
            yield done

    return meet


def _linked(of: DataFrame, step: DataFrame) -> DataFrame:
    """`of` (leaf, code, template) after a further step for its templates."""
    step = step.select("leaf", F.col("code").alias("template"), F.col("template").alias("next"))
    return spool(of.join(step, ["leaf", "template"], "left").select("leaf", "code", F.coalesce("next", "template").alias("template")))


def _merge_pairs(lines: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """`of` after all pairs of templates in `lines` (leaf, code, words) were compared, in leaves of several chunks."""
    several = spool(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("leaf"))
    lines = join_counted(lines, several, "leaf", "left_semi")
    while True:
        sizes = lines.groupBy("leaf").agg(F.count("*").alias("n"))
        top = spool(sizes.select("leaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
        mine = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
        dealt = join_counted(lines, top, "leaf", "inner").select("leaf", "code", "words", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        dealt = dealt.select("leaf", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "code", "words")
        dealt = dealt.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "code")
        matches = spool(dealt.mapInArrow(_meetings(similarity), "leaf long, low long, high long"))
        if not matches.count():
            return of
        # A template without a smaller match keeps its code; others join the smallest such template they match, if any.
        later = matches.select("leaf", F.col("high").alias("low")).distinct()
        joins = matches.join(later, ["leaf", "low"], "left_anti").groupBy("leaf", F.col("high").alias("code")).agg(F.min("low").alias("chunk"))
        named = lines.join(joins, ["leaf", "code"], "left").select("leaf", F.coalesce("chunk", "code").alias("chunk"), "code", "words")
        named = named.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "code")
        made = spool(named.mapInArrow(_clusters(similarity), "leaf long, code long, template long, words string"))
        of = _linked(of, made)
        lines = spool(made.where("code = template").select("leaf", "code", "words"))


def _merge(lines: DataFrame, similarity: float) -> DataFrame:
    """leaf, code, template for all different lines (leaf, code, words)."""
    of, state = None, None
    while True:
        sizes = lines.groupBy("leaf").agg(F.count("*").alias("n"))
        top = spool(sizes.select("leaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
        totals = top.agg(F.coalesce(F.max("chunks"), F.lit(1))).first()[0], lines.count()
        chunk = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
        dealt = join_counted(lines, top, "leaf", "inner").select("leaf", chunk.alias("chunk"), "code", "words")
        dealt = dealt.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "code")
        made = spool(dealt.mapInArrow(_clusters(similarity), "leaf long, code long, template long, words string"))
        step = made.select("leaf", "code", "template")
        if of is None:
            of = step
        else:
            of = _linked(of, step)
        if totals[0] == 1:
            return of
        lines = spool(made.where("code = template").select("leaf", "code", "words"))
        if totals[1] == state:
            return _merge_pairs(lines, of, similarity)
        state = totals[1]


def dropped_lines(docs: DataFrame, *, min_docs: int = 3, similarity: float = 0.6, depth: int = DEPTH) -> DataFrame:
    """id, hash (of the text) and the numbers of the lines to drop, for documents (doc_id, text) that lose any."""
    keyed = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    lines = spool(keyed.mapInArrow(_split(depth), "id long, hash long, line int, leaf long, code long, words string"))
    leaves = lines.groupBy("leaf", "id", "hash").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n"))
    shared = spool(leaves.where(F.col("n") >= min_docs).select("leaf"))
    held = join_counted(lines, shared, "leaf", "left_semi")
    different = spool(held.groupBy("leaf", "code").agg(F.first("words").alias("words")))
    of = spool(_merge(different, similarity))
    # Each different line with the number of its documents; a template's documents are counted once each.
    places = held.select("id", "hash", "leaf", "code").distinct()
    named = join_counted(places, of, ["leaf", "code"], "inner").select("id", "hash", "leaf", "template").distinct()
    often = spool(named.groupBy("leaf", "template").count().where(F.col("count") >= min_docs).select("leaf", "template"))
    gone = spool(join_counted(of, often, ["leaf", "template"], "left_semi").select("leaf", "code"))
    lost = join_counted(lines.select("id", "hash", "line", "leaf", "code"), gone, ["leaf", "code"], "left_semi")
    return spool(lost.groupBy("id", "hash").agg(F.array_sort(F.collect_set("line")).alias("lines")))


def without_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left of each row of `docs` (doc_id, text)."""
    gone = dropped_lines(docs, **how)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("hash"))
    both = join_counted(keyed, gone, ["id", "hash"])
    cut = F.split("text", "\n", -1)
    left = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("lines", i)), "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(cut))
    return both.select(
        "doc_id",
        count.cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
