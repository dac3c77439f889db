"""Operator 7: exact top-k search by inner product, term at a time.

A vector is a sparse row over its components (the terms). Candidates are cut into blocks; a block holds one posting
list per term, (places, weights). A query scatters each of its non-zero terms, weighted, into a dense array with one
score per candidate of the block; a partition selection keeps the block's best k; the lists of all blocks are merged.
Query blocks meet candidate blocks as grouped rows, so neither side has to fit into one task. Scores are whole numbers.

Cases: a vector that is null, or holds a null or non-finite component, takes no part; vectors of different length meet
in the terms they share; a null id takes no part; rows that repeat an id are candidates each, but never of their own
id's query, and a repeated query id is asked once for each distinct vector; ties go to the smaller id. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import spool

# Rows of a candidate block and of a query block; both only set how work is cut.
CANDIDATES = 4096
QUERIES = 1024

_RESULT = "query_id long, vec_id long, score long, query_hash long"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and whole-number components `v` of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, padded by zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _block_top(k: int):
    def top(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "query_hash"]
        found: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            ids = candidates["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], _matrix(candidates["v"])[order]
            postings = []
            for term in rows.T:
                at = np.flatnonzero(term)
                postings.append((at if len(at) < len(term) else slice(None), term[at]))
            shift = len(ids)
            for qid, code, row in zip(queries["vec_id"].to_pylist(), queries["code"].to_pylist(), _matrix(queries["v"]), strict=True):
                score = np.zeros(len(ids), np.int64)
                for term in np.flatnonzero(row[: len(postings)]):
                    at, weight = postings[term]
                    score[at] += row[term] * weight
                # Higher score first, then smaller id: one whole number orders both.
                rank = score * shift + (shift - 1 - np.arange(shift))
                rank[ids == qid] = np.iinfo(np.int64).min
                best = np.argpartition(rank, -k)[-k:] if len(rank) > k else np.arange(len(rank))
                best = best[ids[best] != qid]
                for out, values in zip(found, (np.full(len(best), qid), ids[best], score[best], np.full(len(best), code)), strict=True):
                    out.append(values)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(names, found, strict=True)})

    return top


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best of `vectors` for each row of `queries`: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    all_rows = quantised(vectors, scale)
    asked = spool(quantised(queries, scale).withColumn("code", F.xxhash64("v")).dropDuplicates(["vec_id", "code"]))
    n_asked, n_all = asked.count(), all_rows.count()
    q_blocks, c_blocks = max(1, -(-n_asked // QUERIES)), max(1, -(-n_all // CANDIDATES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("vec_id", "v", "code", block(q_blocks).alias("qb"), spread(c_blocks, "cb"))
    # Rows that repeat one id are dealt by their place too, so that no block grows with them.
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")
    right = all_rows.select("vec_id", "v", dealt.alias("cb"), spread(q_blocks, "qb"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(q_blocks * c_blocks, 10_000))
    left, right = left.repartition(parts, "qb", "cb"), right.repartition(parts, "qb", "cb")
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_block_top(k), _RESULT)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
