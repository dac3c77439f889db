"""Operator 4: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of lower-cased words. An item leaks into a document when some stretch of it is within
`similarity` of the item: at most (1 - similarity) * L edits of words for an item of L words.

The CGK walk reads a word sequence with random steps, the step at a time depending on the time and on the word read;
two sequences at a small edit distance mostly fall into step again, so their walks are equal at most times (a small
Hamming distance). WALKS random walks are sampled at a few times each; a window of the item's size is a candidate for the
item when all samples of one repetition are equal. The number of repetitions follows from the recall aimed at. Candidates
are verified by the exact edit distance of the item to the best stretch around the window.

Windows that cannot match are not walked: within e edits, an item of L words keeps (L - e) // (e + 1) words in a row
unchanged, so a window without a common run of that many words (three at most are looked up) is out, and a common run
fixes where the window begins, up to the edits before it. This loses nothing.

The benchmark is read in slices of bounded size, each broadcast and run over all documents in the same job.

Cases: null or empty texts hold nothing; items of fewer than `min_words` words, or with a null id or text, match nothing;
items of equal words are all named; a row is judged by itself, so repeated rows and ids, null ids and extra columns pass;
an empty benchmark leaves every document; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import give_back, hash_words, pair_hash, text_slices, words_of

WALKS, SAMPLES = 16, 4
# Share of equal walk times, at the largest edit distance allowed, that the number of repetitions reckons with.
EQUAL = 0.5
RECALL = 0.999
LONGEST_RUN = 3
# Words of the items in one slice.
SLICE_WORDS = 1_000_000
HITS = "array<struct<item_id:long,edits:int>>"

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SAME = np.arange(256, dtype=np.uint8)


def repetitions(recall: float = RECALL, equal: float = EQUAL, samples: int = SAMPLES) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - equal**samples))


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


class Items:
    """One slice of the benchmark: word hashes, allowed edits, run index, walks."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, min_words: int, recall: float, seed: int = 2016):
        kept = [(i, hash_words(np.frombuffer(folded(t), np.uint8), _GAP, _SAME)[1]) for i, t in rows]
        kept = [(i, w) for i, w in kept if len(w) >= min_words]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.size = np.array([len(w) for _, w in kept], np.int64)
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        self.longest = int(self.size.max(initial=0))
        self.words = np.zeros((len(kept), self.longest), np.uint64)
        for row, (_, w) in zip(self.words, kept, strict=True):
            row[: len(w)] = w
        run = np.clip((self.size - self.edits) // (self.edits + 1), 1, LONGEST_RUN)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in np.unique(run).tolist():
            of, at, key = [], [], []
            for n in np.flatnonzero(run == q):
                grams = rolled(self.words[n, : self.size[n]], q)
                of.append(np.full(len(grams), n))
                at.append(np.arange(len(grams)))
                key.append(grams)
            of, at, key = (np.concatenate(x) for x in (of, at, key))
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.runs[q] = keys, np.append(first, len(order)), of[order], at[order]
        rng = np.random.default_rng(seed)
        self.steps = 2 * self.longest
        self.odd = rng.integers(1, 1 << 63, (self.steps, WALKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        times = -(-repetitions(recall) // WALKS)
        self.times = rng.random((WALKS, times, SAMPLES))
        self.walked = self.walk(self.words, self.size)

    def walk(self, windows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CGK embeddings [window, walk, time]; past its end a sequence is all zeros."""
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], 1)
        row = np.arange(len(windows))[:, None]
        at = np.zeros((len(windows), WALKS), np.int64)
        out = np.zeros((len(windows), WALKS, self.steps), np.uint64)
        for t in range(self.steps):
            now = padded[row, at]
            out[:, :, t] = now
            at += ((now * self.odd[t]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, size[:, None], out=at)
        return out

    def alike(self, windows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether any repetition samples only equal times of window and item."""
        same = self.walk(windows, self.size[item]) == self.walked[item]
        at = (self.times[None] * (2 * self.size[item])[:, None, None, None]).astype(np.int64)
        walk = np.arange(WALKS)[None, :, None, None]
        return same[np.arange(len(item))[:, None, None, None], walk, at].all(3).any((1, 2))


def rolled(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words that begin at each place."""
    out = words
    for k in range(1, q):
        out = pair_hash(out[: max(0, len(words) - k)], words[k:])
    return out


def edit_distance(items: np.ndarray, size: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Edits from each item to the best stretch of its region (rows of hashes; 0 pads both)."""
    row = np.zeros((len(items), regions.shape[1] + 1), np.int64)
    place = np.arange(row.shape[1])
    best = np.full(len(items), np.iinfo(np.int64).max)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        cost = np.where((regions == word) & (word != 0), 0, 1)
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + cost, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - place, axis=1) + place
        ends = size == i + 1
        best[ends] = row[ends].min(1)
    return best


def _find(items: Items, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, edits) of all leaks into a run of texts."""
    wanted: list[np.ndarray] = []
    for q, (keys, first, of, at) in items.runs.items():
        grams = rolled(words, q)
        if not len(grams) or not len(keys):
            continue
        k = np.searchsorted(keys, grams)
        k[k == len(keys)] = 0
        place = np.flatnonzero(keys[k] == grams)
        text = np.searchsorted(bounds, place, "right") - 1
        inside = place + q <= bounds[text + 1]
        place, text, k = place[inside], text[inside], k[place[inside]]
        n = first[k + 1] - first[k]
        entry = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(place, n) - at[entry]
        wanted.append(np.stack([np.repeat(text, n), of[entry], begin]))
    if not wanted:
        return []
    found = np.unique(np.concatenate(wanted, 1), axis=1)
    best: dict[tuple[int, int], int] = {}
    wide = np.concatenate([words, np.zeros(1, np.uint64)])
    for a in range(0, found.shape[1], 512):
        text, item, begin = found[:, a : a + 512]
        start = np.maximum(begin, bounds[text])

        def window(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at = lo[:, None] + np.arange(int((hi - lo).max(initial=0)))
            return wide[np.where(at < hi[:, None], at, len(words))]

        end = np.minimum(start + items.size[item], bounds[text + 1])
        windows = np.zeros((len(text), items.longest), np.uint64)
        got = window(start, end)
        windows[:, : got.shape[1]] = got
        ok = np.flatnonzero(items.alike(windows, item))
        if not len(ok):
            continue
        text, item, begin, slack = text[ok], item[ok], begin[ok], items.edits[item[ok]]
        lo = np.maximum(begin - slack, bounds[text])
        hi = np.minimum(begin + items.size[item] + slack, bounds[text + 1])
        edits = edit_distance(items.words[item], items.size[item], window(lo, np.maximum(hi, lo)))
        for t, i, e in zip(text.tolist(), item.tolist(), edits.tolist(), strict=True):
            if e <= items.edits[i]:
                best[t, i] = min(e, best.get((t, i), e))
    return [(t, i, e) for (t, i), e in sorted(best.items())]


def _scanner(held, name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for batch in batches:
            hits = batch[name].to_pylist()
            for begin, run in text_slices(batch["text"], 1_000_000) if items.longest else ():
                words, bounds = words_of([folded(t) for t in run], _GAP, _SAME)
                for t, i, e in _find(items, words, bounds):
                    hits[begin + t] = [*hits[begin + t], {"item_id": int(items.ids[i]), "edits": e}]
            kind = batch.schema.field(name).type
            yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(hits, kind))
        give_back(held)

    return scan


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, name: str = "hits", *, similarity: float = 0.8, min_words: int = 5, recall: float = RECALL
) -> DataFrame:
    """The rows of `docs` with one more column `name`: the items found in their text, with the number of edits."""
    spark = docs.sparkSession
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    words = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(words / (6 * SLICE_WORDS)))
    out = docs.withColumn(name, F.array().cast(HITS))
    for n in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n).collect()
        held = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in rows], similarity, min_words, recall))
        out = out.mapInArrow(_scanner(held, name), out.schema)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with their own columns, that hold no benchmark item."""
    name = "hits"
    while name in docs.columns:
        name += "_"
    return find_leaks(docs, benchmark, name, **how).where(F.size(name) == 0).drop(name)
