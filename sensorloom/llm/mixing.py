"""Operator 6: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Along the documents of a
source, ordered by size, these are summed up; one random offset per source shifts the sums, and a document is emitted
once for each integer that its stretch crosses. Ordering by size spreads the takes evenly over short and long documents,
so the words taken differ from the target by about one document of the largest size.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of equal size are ordered
by id and then by a hash of the text, so repeated rows are counted each; a source whose size is 0 takes nothing; an empty
table gives no rows. Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import WORD, join_counted
from sensorloom.session import spool

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source and seed, the same in every run."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("\u0000")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def shared_targets(sizes: list[tuple[str | None, int]], share: float, most: float, weights=WEIGHTS) -> list[float]:
    """Targets by weight, each at most `most` times its source's size; what lies above is shared anew by weight.

    `sizes` has one (source, size) per source, in order. A list of sources is small beside any table of documents.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    top = [most * size for _, size in sizes]
    target = [0.0] * len(sizes)
    rest, free = share * sum(size for _, size in sizes), set(range(len(sizes)))
    while free:
        unit = rest / sum(weight[i] for i in free)
        over = {i for i in free if unit * weight[i] > top[i]}
        if not over:
            for i in free:
                target[i] = unit * weight[i]
            break
        for i in over:
            target[i] = top[i]
            rest -= top[i]
        free -= over
    return target


def mix_sources(
    docs: DataFrame, *, share: float = SHARE, most_copies: float = MOST_COPIES, seed: int = 7, weights=WEIGHTS, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies.

    Columns named in `carry` come along. Ranks come from a range partition by (source, size, id): each task numbers its own
    rows, and only one count per source and partition is summed up, so a source of any size is spread over many tasks.
    """
    spark = docs.sparkSession
    mine = [F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size")]
    slim = docs.select(*mine, *carry)
    order = ["source", "size", "doc_id", "text_hash"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    ranked = spool(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place))
    ranked = ranked.withColumn("part", F.shiftright("place", 33))
    cells = ranked.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = spool(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))

    sums = cells.groupBy("source").agg(F.sum("words").alias("words")).collect()
    sizes = sorted(((r.source, r.words) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(s, n, t) for (s, n), t in zip(sizes, shared_targets(sizes, share, most_copies, weights), strict=True)]
    targets = spark.createDataFrame(rows, "source string, source_size long, target double")

    a, b = ranked.alias("a"), cells.select("source", "part", "first", "before").alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part"))
    out = join_counted(a, b, same, "inner").select("a.*", (F.col("place") - F.col("first") + F.col("before")).alias("rank"))
    out = out.alias("a").join(F.broadcast(targets.alias("t")), F.col("a.source").eqNullSafe(F.col("t.source")), "inner")
    out = out.select("a.*", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = random_offset(F.col("source"), seed)
    copies = F.floor(start + (F.col("rank") + 1) * rate) - F.floor(start + F.col("rank") * rate)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *carry)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns only.

    Rows are stored with a number; only the number is ranked, and whole rows meet their copies by it.
    """
    stored = spool(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    slim = stored.select("doc.doc_id", "doc.source", "doc.text", "row")
    takes = spool(mix_sources(slim, carry=["row"], **how).where("copies > 0").select("row", "copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return join_counted(stored, takes, "row", "inner").select("doc", copy.alias("copy")).select("doc.*")
