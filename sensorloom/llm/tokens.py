"""Operator 2: token ids in Parquet list columns, for selective reads.

Documents are range-partitioned and sorted by id, encoded, and written as one Parquet row each: doc_id, part, start of
the document within its part, number of tokens, ids. The writer is Spark's own, with the second data page version (delta
encoding of the integer columns, dictionary encoding of the ids), row groups and pages of given size, and page indexes,
so that a filter on doc_id reads few pages and a read of the counts touches no ids. Global starts are the starts within
a part plus the totals of the parts before; one number per part is all that is summed centrally.

A text is cut before each blank that a visible character follows and around each line break; the vocabulary's own
splitting rule also cuts there, so the pieces are encoded apart, each once for all its occurrences in a worker: pieces are
found by hashes taken from running sums over the bytes, and ids are gathered, without a Python object per piece. Texts with
other or repeated white space are encoded whole.

Cases: a null text is empty and has only the end id; rows that repeat an id are ordered by a hash of the text; a null id
comes first; an empty table gives no rows. Extra columns are not written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import _Powers, give_back, mix, text_slices
from sensorloom.session import spool_root

# Pieces whose ids a worker remembers, about 40 bytes each; beyond, those of the last runs stay. It only saves work.
MEMORY = 1_500_000

# Characters that are encoded at a time, of several texts or of a longer one, and rows that reach a worker at once.
RUN = LONG = 500_000
ROWS = 2_000

# Stretches of ids that are put together at a time.
GATHERED = 1 << 16

# Texts with any of these are encoded whole: repeated white space, white space but blank and line break, and the mark.
_ODD = ["  ", " \n", "\n ", "\n\n", "\x00", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")]
_workers: dict[str, Pieces] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of the pieces met so far, found by 96 bits of hash: sorted arrays, without a Python object per piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tiers = [self._tier(), self._tier()]  # all but the newest pieces, and the newest

    @staticmethod
    def _tier(keys=(), check=(), counts=(), ids=()) -> dict[str, np.ndarray]:
        counts = np.asarray(counts, np.int64)
        begin = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=begin[1:])
        return {"keys": np.asarray(keys, np.uint64), "check": np.asarray(check, np.uint32), "begin": begin, "ids": np.asarray(ids, "<u4")}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids_of(self, keys: np.ndarray, check: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after another, and where each begins; `text_of` gives the text of the k-th."""
        tier, at = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for t, held in enumerate(self.tiers):
            if len(held["keys"]):
                place = np.minimum(np.searchsorted(held["keys"], keys), len(held["keys"]) - 1)
                hit = (held["keys"][place] == keys) & (held["check"][place] == check)
                tier[hit], at[hit] = t, place[hit]
        new = np.flatnonzero(tier < 0)
        if len(new):
            told = self.tokenizer.encode_batch_fast([text_of(k) for k in new.tolist()], add_special_tokens=False)
            lists = [t.ids for t in told]
            fresh = self._tier(keys[new], check[new], [len(x) for x in lists], np.fromiter(chain.from_iterable(lists), "<u4"))
            tier[new], at[new] = 2, np.arange(len(new))
        else:
            fresh = self._tier()
        tiers = [*self.tiers, fresh]
        base = np.concatenate([[0], np.cumsum([len(t["ids"]) for t in tiers])])
        begin, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for t, held in enumerate(tiers):
            mine = np.flatnonzero(tier == t)
            begin[mine], counts[mine] = base[t] + held["begin"][at[mine]], np.diff(held["begin"])[at[mine]]
        out = [np.concatenate([t["ids"] for t in tiers]), begin, counts]
        if len(new):
            self._remember(fresh)
        return out

    def _remember(self, fresh: dict[str, np.ndarray]) -> None:
        old, newest = self.tiers
        if len(old["keys"]) + len(newest["keys"]) + len(fresh["keys"]) > MEMORY:
            old = self._tier()
        newest = self._merged(newest, fresh)
        if 4 * len(newest["keys"]) > len(old["keys"]):
            old, newest = self._merged(old, newest), self._tier()
        self.tiers = [old, newest]

    def _merged(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Both in order of key; a key that two pieces share is kept once, so the other is encoded anew when met."""
        keys = np.concatenate([a["keys"], b["keys"]])
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(keys) else order
        begin = np.concatenate([a["begin"][:-1], b["begin"][:-1] + len(a["ids"])])[order]
        counts = np.concatenate([np.diff(a["begin"]), np.diff(b["begin"])])[order]
        ids = gathered(np.concatenate([a["ids"], b["ids"]]), begin, counts)
        return self._tier(keys[order], np.concatenate([a["check"], b["check"]])[order], counts, ids)


def gathered(values: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches values[begin : begin + count], one after another."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(ends[-1]), values.dtype)
    for at in range(0, len(counts), GATHERED):  # the places are eight bytes an id, so only some are held at a time
        some, low = counts[at : at + GATHERED], int(ends[at])
        high = int(ends[at + len(some)])
        out[low:high] = values[np.repeat(begin[at : at + GATHERED] - ends[at : at + len(some)], some) + np.arange(low, high)]
    return out


def _pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


# Second hash: another number for each byte value.
_OTHER = np.random.default_rng(2).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def _stretches(text: str) -> Iterator[str]:
    """A long text in stretches of about LONG characters that begin with a piece."""
    at = 0
    while len(text) - at > LONG:
        cut = max(text.rfind(" ", at + 1, at + LONG), text.rfind("\n", at + 1, at + LONG))
        if cut < 0:
            found = [c for c in (text.find(" ", at + LONG), text.find("\n", at + LONG)) if c > 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _encode_texts(pieces: Pieces, texts: list[str], end_id: int) -> list[np.ndarray]:
    """Ids of each text and the end id."""
    apart = {i: t for i, t in enumerate(texts) if len(t) > LONG or any(x in t for x in _ODD)}
    data = "".join([("" if i in apart else t) + "\n" for i, t in enumerate(texts)]).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    line = raw == 0x0A
    starts = (raw == 0x20) | line
    starts[1:] |= line[:-1]
    starts[0] = True
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(raw))
    # The line break after each text stands for its end.
    size = np.array([1 if i in apart else len(t.encode("utf-8", "surrogatepass")) + 1 for i, t in enumerate(texts)], np.int64)
    last = np.searchsorted(at, np.cumsum(size) - 1)
    inside = np.ones(len(at), bool)
    inside[last] = False

    def polynomial(numbers: np.ndarray) -> np.ndarray:
        up, down = _Powers.upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(numbers * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[at]) * down[at] + (ends - at).astype(np.uint64))

    keys = polynomial(raw.astype(np.uint64) + np.uint64(1))[inside]
    check = (polynomial(_OTHER[raw]) >> np.uint64(32)).astype(np.uint32)[inside]
    _, one, of = np.unique(keys, return_index=True, return_inverse=True)
    if (check[one][of] != check).any():  # two pieces share a key: tell them apart by both hashes
        both = np.stack([keys, check.astype(np.uint64)], axis=1)
        _, one, of = np.unique(both, axis=0, return_index=True, return_inverse=True)
    begin_at, end_at = at[inside][one], ends[inside][one]
    ids, begin, counts = pieces.ids_of(keys[one], check[one], lambda k: data[begin_at[k] : end_at[k]].decode("utf-8", "surrogatepass"))
    each_begin, each = np.full(len(at), len(ids), np.int64), np.ones(len(at), np.int64)
    each_begin[inside], each[inside] = begin[of], counts[of]
    flat = gathered(np.append(ids, np.uint32(end_id)), each_begin, each)
    bounds = np.cumsum(each)[last]
    out = np.split(flat, bounds[:-1])
    for i, t in apart.items():
        if any(x in t for x in _ODD):
            out[i] = np.append(pieces.whole(t), np.uint32(end_id))
        else:
            parts = [_encode_texts(pieces, [part], end_id)[0] for part in _stretches(t)]
            out[i] = np.concatenate([p[:-1] for p in parts[:-1]] + parts[-1:])
    return out


def _encoder(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, pieces = 0, _pieces(path)
        for batch in batches:
            for at, texts in text_slices(batch["text"], RUN):
                stop = at + len(texts)
                ids = _encode_texts(pieces, texts, end_id)
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(counts, out=offsets[1:])
                flat = pa.array(np.concatenate(ids).view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][at:stop],
                        batch["part"][at:stop],
                        pa.array(start + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])
        give_back()

    return encode


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text) in `parts` sorted ranges of ids.

    The bounds are quantiles of the ids, found without reading a text. Where an id repeats, a hash of the text takes part in
    order and bounds, so that its rows, however many, are split among tasks.
    """
    ids = docs.select("doc_id")
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        slim = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
        return slim.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    cuts = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10 * parts)).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    below = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below).cast("int")
    return docs.select("doc_id", "text").repartitionById(parts, place).sortWithinPartitions("doc_id")


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str | None = None,
    end_id: int = 2,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Encode `docs` (doc_id, text) and write them in ascending doc_id order below `path`."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ready = _dealt(docs, parts).select("doc_id", F.spark_partition_id().alias("part"), "text")
    rows = ready.mapInArrow(
        _encoder(vocabulary or vocabulary_path(), end_id),
        "doc_id long, part int, part_start long, n_tokens long, tokens array<int>",
    )
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_rows)
    spark.conf.set(batch_rows, ROWS)
    try:
        _write(rows, path, row_group_bytes, page_bytes, page_rows)
    finally:
        spark.conf.set(batch_rows, before)


def _write(rows: DataFrame, path: str, row_group_bytes: int, page_bytes: int, page_rows: int) -> None:
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens")) -> DataFrame:
    """The written documents with their global start; only the columns asked for are read."""
    rows = spark.read.parquet(path)
    if "start" in columns:
        totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
        offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        rows = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("part_start"))
    return rows.select(*columns)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["tokens"]
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all read from the files."""
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return f"{spool_root(spark)}/tokens-{uuid.uuid4().hex}"
