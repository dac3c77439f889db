"""What the operators of this package share: table access, checked broadcasts, word hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a narrow table (a few numbers or short strings) that may be broadcast after its rows were counted; beyond, the
# join shuffles both sides.
BROADCAST_ROWS = 500_000

# White space of the word rule [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"

_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a stored, narrow `right`: broadcast when its counted rows are few, by shuffle otherwise."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(3) + mix(right + np.uint64(0x632BE59BD9B4E019)))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, extended on demand."""

    up = np.ones(0, np.uint64)
    down = np.ones(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _PIECE + 4096)
            both = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            cls.up, cls.down = both
        return cls.up, cls.down


def give_back(*broadcasts) -> None:
    """Let go of what a task leaves in its worker for the next one: loaded broadcasts, tables of powers, free memory.

    A worker lives on after its stage; without this the next stage's tasks find its memory half full.
    """
    for b in broadcasts:
        vars(b).pop("_value", None)  # read again from its file when next needed
    _Powers.up = _Powers.down = np.ones(0, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def space_table() -> np.ndarray:
    """True for the bytes that end a word under `WORD`."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def hash_words(data: np.ndarray, gap: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in `data` (bytes).

    `gap` marks the byte values between words, `fold` maps bytes before hashing. The hash of a word is a polynomial
    in its bytes, read off prefix sums, so no Python object is made per word. Works piece by piece; a piece ends at
    a gap, so words stay whole.
    """
    starts, hashes = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n:
            back = np.flatnonzero(gap[data[max(at, end - 4096) : end]])
            if len(back):
                end = max(at, end - 4096) + int(back[-1]) + 1
                break
            end = min(n, end + 4096)
        piece = data[at:end]
        inside = np.empty(len(piece) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~gap[piece]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _Powers.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((fold[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def text_slices(column: pa.Array, most: int, kind: pa.DataType | None = None) -> Iterator[tuple[int, list]]:
    """Values of a text column (null: empty) in runs of about `most` units, each with the row it begins at.

    Only a few hundred rows at a time become Python objects, whatever the size of the batch.
    """
    empty = b"" if kind else ""
    run, size, begin = [], 0, 0
    for top in range(0, len(column), 256):
        part = column.slice(top, 256)
        for text in (part.cast(kind) if kind else part).to_pylist():
            text = text or empty
            if run and size + len(text) > most:
                yield begin, run
                begin += len(run)
                run, size = [], 0
            run.append(text)
            size += len(text) + 1
    if run:
        yield begin, run


def text_batches(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 (null: empty) in runs of about `most_bytes`, each with the row it begins at."""
    return text_slices(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, most_bytes, pa.binary())


def words_of(run: list[bytes], gap: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and the bounds of each text in them (len(run) + 1)."""
    data = np.frombuffer(b"\n".join(run), np.uint8)
    starts, hashes = hash_words(data, gap, fold)
    offsets = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in run], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def sorted_lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in the sorted `keys`, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    at[keys[at] != wanted] = -1
    return at


class SortedHashes:
    """Sorted array of 64-bit hashes with the first place of each value of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        each = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first = np.append(0, np.cumsum(each))

    def __reduce__(self):
        return SortedHashes, (self.keys,)  # the first places take more room than the hashes: made again where these are read

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        cell = (wanted >> self.shift).astype(np.int64)
        out = np.take(self.first, cell)
        missed = np.flatnonzero(np.take(self.keys, out, mode="clip") != wanted)
        at, end, wanted = out[missed], self.first[cell[missed] + 1], wanted[missed]
        out[missed] = -1
        left = np.flatnonzero(at + 1 < end)
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == wanted[left]
            out[missed[left[hit]]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out
