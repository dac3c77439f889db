"""Operator 10: language ID by interpolated Kneser-Ney character models.

Text is lower-cased, everything but letters becomes one blank. Tasks count the character 5-grams of every learning text
per language; their sums are all that the model is made of: lower orders use continuation counts. For each order the
n-grams of all languages stand in one sorted array of 64-bit hashes, beside a row of log-probabilities, one per language,
so a text is scored for all languages with one search per character; back-off weights are looked up for unseen n-grams.
The language with the lowest cross-entropy per character wins. It is rejected when its cross-entropy, in units that allow
for short texts, lies SPREADS robust standard deviations above the median of all learning rows, and TOLERANCE at least;
medians, so that garbage and wrong labels among the learning rows do not move the limit.

No n-gram is left out: the model grows with the different 5-grams of the input. Counts of counts and lower orders are summed
in Spark over all of them. Beyond SHARD of them the model is cut by the two characters before the last one, which keeps
n-grams of three and more characters, their contexts and all they back off to in one part, beside the different pairs of
characters, which every part needs. Tasks build the parts; the driver passes them on one at a time and holds none. Of more than
KEPT parts a worker holds one at a time for a run of texts. Every learning row belongs to one of FOLDS
folds and is scored by a model whose counts leave its fold out; middles and limits are exact medians over all of these
scores, taken in Spark. The models of the folds live one after another; the final model counts every learning row.

Cases: a null text, or one without letters, is `und` with score 0 and is rejected; rows with a null id or a null language
are not learned from, and a null id is not held out; without any learning row every text is `und`; an empty table gives
no rows. Extra columns pass through `accepted_only` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import SortedHashes, give_back, mix, sorted_lookup, text_slices
from sensorloom.operators.frame import running_totals
from sensorloom.operators.quantile import quantile_table
from sensorloom.session import discard, shuffles_deleted, spool

ORDER = 5
# Different 5-grams of a part, about, counted once per language, and the parts that a worker keeps; both only set the memory of
# the driver, a task and a worker.
SHARD, KEPT = 250_000, 6
FOLDS = 5
SPREADS = 20.0
# Characters counted, and scored, at a time; both only set the memory of a task.
COUNTED, SCORED = 1_500_000, 400_000
# Characters beyond which a longer text is no surer, for the score and for the rejection. The second is small: a long clean
# text may quote another language at length.
SURE, SURE_TO_REJECT = 400, 50
# Nats per character above a language's middle that are never a reason to reject, however even its learning rows are.
TOLERANCE = 1.0

_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(ORDER)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a run with ORDER - 1 zeros before each text; first and end place of each text."""
    pad = "\x00" * (ORDER - 1)
    joined = pad + pad.join(t.replace("\x00", " ") for t in run).lower() + pad
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cp[~_is_letter()[np.minimum(cp, 0x10FFFF)] & (cp != 0)] = 32
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp = cp[keep]
    zeros = np.flatnonzero(cp == 0).reshape(-1, ORDER - 1)
    return cp, zeros[:-1, -1] + 1, zeros[1:, 0]


def polynomials(cp: np.ndarray) -> list[np.ndarray]:
    """For each order k from 1, a polynomial in the k characters that end at each place; `mix` of it, plus k - 1, is their hash."""
    c = cp.astype(np.uint64)
    out = [c]
    for k in range(1, ORDER):
        h = out[-1].copy()
        h[k:] += c[:-k] * _POWERS[k]
        out.append(h)
    return out


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """The same hash for rows of characters."""
    k = grams.shape[1]
    h = np.zeros(len(grams), np.uint64)
    for j in range(k):
        h += grams[:, k - 1 - j].astype(np.uint64) * _POWERS[j]
    return mix(h + np.uint64(k - 1))


def cells(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """20-bit hash of the two characters before the one that an n-gram ends with: its part is this modulo the number of parts."""
    return (mix(before.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)


def _grams(cp: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ORDER-grams that end at a character, as rows of code points, and their counts by the fold of that place."""
    at = np.flatnonzero(cp)
    there = np.zeros(0x110000, bool)
    there[cp] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    if len(alphabet) <= 4096:  # twelve bits a character and three for the fold: sorted as whole numbers
        code = (np.cumsum(there) - 1)[cp]
        packed = np.zeros(len(cp), np.uint64)
        for k in range(ORDER):
            packed[k:] |= code[: len(cp) - k].astype(np.uint64) << np.uint64(12 * k)
        cells, n = np.unique(packed[at] << np.uint64(3) | fold[at].astype(np.uint64), return_counts=True)
        keys = cells >> np.uint64(3)
        first = np.r_[True, keys[1:] != keys[:-1]]
        counts = np.zeros((int(first.sum()), FOLDS), np.int64)
        counts[np.cumsum(first) - 1, (cells & np.uint64(7)).astype(np.int64)] = n
        shifts = np.arange(12 * (ORDER - 1), -1, -12).astype(np.uint64)
        return alphabet[((keys[first][:, None] >> shifts) & np.uint64(4095)).astype(np.int64)], counts
    top = mix(polynomials(cp)[-1][at] + np.uint64(ORDER - 1))
    _, first, place = np.unique(top, return_index=True, return_inverse=True)
    counts = np.bincount(place * FOLDS + fold[at], minlength=FOLDS * len(first)).reshape(-1, FOLDS)
    return cp[at[first][:, None] + np.arange(1 - ORDER, 1)], counts


# Counts by fold, and the counts that the models are made of: of all rows, and of those outside each fold.
_BY_FOLD = [f"n{f}" for f in range(FOLDS)]
_COUNTS = ["n", *(f"rest{f}" for f in range(FOLDS))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in set(batch["lang"].to_pylist()):
            mine = pc.equal(batch["lang"], lang)
            folds = batch["fold"].filter(mine).to_numpy().astype(np.uint8)
            for begin, run in text_slices(batch["text"].filter(mine), COUNTED):
                cp, first, _ = symbols(run)
                if not cp.any():
                    continue
                sizes = np.diff(np.append(first, len(cp)))
                fold = np.concatenate([np.zeros(first[0], np.uint8), np.repeat(folds[begin : begin + len(run)], sizes)])
                grams, counts = _grams(cp, fold)
                wide = 4 * ORDER
                offsets = pa.py_buffer((np.arange(len(grams) + 1) * wide).astype(np.int32).tobytes())
                column = pa.Array.from_buffers(pa.binary(), len(grams), [None, offsets, pa.py_buffer(grams.astype("<u4").tobytes())])
                cell = pa.array(cells(grams[:, -3], grams[:, -2]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), column, cell, *map(pa.array, counts.T.copy())], ["lang", "gram", "cell", *_BY_FOLD])


def _discount(one: int, two: int) -> float:
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one and two else 0.75


def build(grams: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Model of all orders from distinct ORDER-grams (rows of code points) and their counts (one column per language)."""
    return _build(grams, counts)[0]


def _build(grams: np.ndarray, counts: np.ndarray, discounts: dict[int, np.ndarray] | None = None, base=(None, None, None)) -> tuple:
    """The model, and hashes and probabilities of its longest n-grams.

    For a part, `discounts` (by order) are those of the whole, and `base` is what this returned for its pairs of characters.
    """
    shortest = len(base[0] or []) + 1
    levels = []
    while True:
        width = grams.shape[1]
        keys, order = np.unique(gram_hash(grams), return_index=True)
        grams, counts = grams[order], counts[order]
        levels.append((keys, grams, counts))
        if width == shortest:
            break
        shorter = grams[:, 1:]
        tails, first, place = np.unique(gram_hash(shorter), return_index=True, return_inverse=True)
        more = np.zeros((len(tails), counts.shape[1]), np.int64)
        np.add.at(more, place, (counts > 0).astype(np.int64))
        grams, counts = shorter[first], more
    model: list[dict] = list(base[0] or [])
    below_keys, below = base[1:]
    for keys, grams, counts in reversed(levels):
        if discounts is None:
            d = np.array([_discount(int((c == 1).sum()), int((c == 2).sum())) for c in counts.T])
        else:
            d = discounts[grams.shape[1]]
        if grams.shape[1] == 1:
            context = np.zeros(len(grams), np.int64)
            context_keys = np.zeros(1, np.uint64)
            lower = np.full(counts.shape, 1.0 / (len(grams) + 1))
        else:
            context_keys, context = np.unique(gram_hash(grams[:, :-1]), return_inverse=True)
            lower = below[sorted_lookup(below_keys, gram_hash(grams[:, 1:]))]
        total, kinds = np.zeros((2, len(context_keys), counts.shape[1]))
        np.add.at(total, context, counts)
        np.add.at(kinds, context, counts > 0)
        safe = np.maximum(total, 1)
        back = np.where(total > 0, d * kinds / safe, 1.0)
        prob = np.maximum(counts - d, 0) / safe[context] + back[context] * lower
        below_keys, below = keys, prob
        logp = np.log(prob).astype(np.float32)
        logp = np.concatenate([logp, np.zeros((1, logp.shape[1]), np.float32)])  # the last row is for what is not found
        back = np.log(np.maximum(back, 1e-12)).astype(np.float32)
        back = np.concatenate([back, np.zeros((1, back.shape[1]), np.float32)])
        model.append({"keys": SortedHashes(keys), "logp": logp, "context": SortedHashes(context_keys), "back": back})
    return model, below_keys, below


class Parts:
    """A model whose base, the orders of one and two characters, and parts, all others, are broadcast; of many parts a process
    holds one at a time."""

    def __init__(self, base, parts: list):
        self.base, self.parts = base, parts

    @property
    def broadcasts(self) -> list:
        return [self.base, *self.parts] if self.parts else []

    def destroy(self) -> None:
        for b in self.broadcasts:
            b.destroy()

    @property
    def run(self) -> int:
        """Characters to score at a time: more where parts have to be read again for each run."""
        return SCORED if len(self.parts) <= KEPT else 4 * SCORED

    def log_likelihood(self, cp: np.ndarray, places: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return log_likelihood(self.base.value + self.parts[0].value, cp, places)
        poly, mine = polynomials(cp), cells(cp[places - 2], cp[places - 1]) % len(self.parts)
        own = [np.flatnonzero(mine == s) for s in range(len(self.parts))]
        got = []
        for part, at in zip(self.parts, own, strict=True):
            got.append(log_likelihood(self.base.value + part.value, cp, places[at], poly))
            if len(self.parts) > KEPT:
                vars(part).pop("_value", None)  # read again from its file when next needed
        out = np.empty((len(places), got[0].shape[1]), np.float32)
        out[np.concatenate(own)] = np.concatenate(got)
        return out


def log_likelihood(model: list[dict], cp: np.ndarray, places: np.ndarray, poly: list[np.ndarray] | None = None) -> np.ndarray:
    """Log-probability of the characters at `places`, one column per language."""
    poly = poly or polynomials(cp)
    level = model[-1]
    found = level["keys"].find(mix(poly[-1][places] + np.uint64(ORDER - 1)))
    out = np.take(level["logp"], found, axis=0, mode="wrap")
    left = np.flatnonzero(found < 0)
    for k in range(ORDER - 1, 0, -1):  # what order k + 1 has not seen backs off to order k
        if not len(left):
            return out
        at = places[left]
        context = model[k]["context"].find(mix(poly[k - 1][at - 1] + np.uint64(k - 1)))
        found = model[k - 1]["keys"].find(mix(poly[k - 1][at] + np.uint64(k - 1)))
        out[left] += model[k]["back"][context] + model[k - 1]["logp"][found]
        left = left[found < 0]
    if len(left):  # characters never seen: the rest of the lowest order, evenly
        out[left] += model[0]["back"][0] - np.log(len(model[0]["keys"].keys) + 1.0)
    return out


def cross_entropies(model: Parts, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character for each text and language, and the number of characters (0: no letter)."""
    cp, first, end = symbols(run)
    places = np.flatnonzero(cp)
    each = model.log_likelihood(cp, places)
    a, b = np.searchsorted(places, first), np.searchsorted(places, end)
    sums = np.zeros((len(run), each.shape[1]))
    some = b > a
    if some.any():
        sums[some] = np.add.reduceat(each.astype(np.float64), a[some], axis=0)
    letters = np.concatenate([[0], np.cumsum(cp[places] != 32)])
    n = np.where(letters[b] > letters[a], b - a, 0)
    return -sums / np.maximum(b - a, 1)[:, None], n


class LanguageModel:
    """Languages, the model, and for each language middle and limit of the cross-entropy of its own texts."""

    def __init__(self, languages: list[str], model: Parts, mean: np.ndarray, limit: np.ndarray):
        self.languages, self.model, self.mean, self.limit = languages, model, mean, limit

    def predict(self, run: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of each text."""
        if not self.languages:
            none = np.zeros(len(run))
            return ["und"] * len(run), none, none, none.astype(bool)
        ce, n = cross_entropies(self.model, run)
        best = ce.argmin(1)
        low = ce[np.arange(len(run)), best]
        score = 1.0 / np.exp(-(ce - low[:, None]) * np.minimum(n, SURE)[:, None]).sum(1)
        far = (low - self.mean[best]) * np.sqrt(np.minimum(n, SURE_TO_REJECT))
        ok = (n > 0) & (far <= self.limit[best])
        names = [self.languages[i] if m else "und" for i, m in zip(best.tolist(), n.tolist(), strict=True)]
        return names, np.where(n > 0, score, 0.0), np.where(n > 0, low, 0.0), ok


def _wide(table: pa.Table, languages: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of rows (lang, gram, n), and their counts by language."""
    column = table["gram"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    bytes_ = column.buffers()[2][int(ends[0]) : int(ends[-1])] if len(column) else b""
    grams = np.frombuffer(bytes_, "<u4").reshape(-1, width)
    code = {lang: i for i, lang in enumerate(languages)}
    coded = table["lang"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    lang = np.array([code[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    keys, first, place = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
    counts = np.zeros((len(keys), len(languages)), np.int64)
    counts[place, lang] = table["n"].to_numpy()
    return grams[first], counts


class _Sums:
    """Sums over all 5-grams of the rows (lang, gram, cell, counts): what the models of all rows and of each fold are made of."""

    def __init__(self, counts: DataFrame, languages: list[str]):
        self.counts, self.languages = counts, languages
        self.parts = max(1, ceil(counts.count() / SHARD))
        level = counts.select("lang", "gram", *_COUNTS)
        self.discounts: dict[str, dict[int, np.ndarray]] = {c: {} for c in _COUNTS}
        for width in range(ORDER, 0, -1):
            if width < ORDER:
                tail = F.expr("substring(gram, 5)").alias("gram")
                level = spool(level.groupBy("lang", tail).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in _COUNTS]))
            if width == 2:
                self.pairs = level
            ones = [F.sum((F.col(c) == k).cast("long")).alias(f"{c}_{k}") for c in _COUNTS for k in (1, 2)]
            got = {r.lang: r for r in level.groupBy("lang").agg(*ones).collect()}
            for c in _COUNTS:
                self.discounts[c][width] = np.array([_discount(got[x][f"{c}_1"], got[x][f"{c}_2"]) for x in languages])

    def models(self) -> Iterator[Parts]:
        """The models of the rows that each of _COUNTS counts, in this order, one at a time; without any parts where it counts none.

        One shuffle makes the parts of all models, so the driver plans and passes on no more than it has to.
        """
        sc = self.counts.sparkSession.sparkContext
        languages, discounts = self.languages, self.discounts
        pairs = self.pairs.select("lang", "gram", *_COUNTS).toArrow()
        bases = []
        for c in _COUNTS:
            some = pairs.filter(pc.greater(pairs[c], 0))
            grams, n = _wide(some.select(["lang", "gram", c]).rename_columns(["lang", "gram", "n"]), languages, 2)
            bases.append(_build(grams, n, discounts[c]) if len(grams) else None)
        below = sc.broadcast(bases)

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            part, of = (k.as_py() for k in key)
            made = _build(*_wide(table, languages, ORDER), discounts[_COUNTS[of]], below.value[of])[0][2:]
            out = pa.table({"part": pa.array([part], pa.int64()), "of": pa.array([of], pa.int32()), "model": pa.array([pickle.dumps(made, 5)], pa.binary())})
            del made, table
            give_back(below)
            return out

        each = F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("n")) for i, c in enumerate(_COUNTS)])
        rows = self.counts.select("lang", "gram", (F.col("cell") % self.parts).alias("part"), F.inline(each)).where("n > 0")
        with shuffles_deleted(self.counts.sparkSession):
            packed = spool(rows.groupBy("part", "of").applyInArrow(pack, "part long, of int, model binary"))
        below.destroy()
        nothing = np.zeros((0, ORDER), np.uint32), np.zeros((0, len(languages)), np.int64)
        for of, base in enumerate(bases):
            if base is None:
                yield Parts(None, [])
                continue
            made = {r["part"]: sc.broadcast(pickle.loads(r["model"])) for r in packed.where(F.col("of") == of).select("part", "model").toLocalIterator()}
            parts = [made[s] if s in made else sc.broadcast(_build(*nothing, discounts[_COUNTS[of]], base)[0][2:]) for s in range(self.parts)]
            model = Parts(sc.broadcast(base[0]), parts)
            give_back(*model.broadcasts)
            yield model
        discard(packed)


def _measured(rows: DataFrame, languages: list[str], model: Parts) -> DataFrame:
    """lang (its place), cross-entropy ce of the text by its own language, and number of characters n; of rows with letters."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.searchsorted(languages, batch["lang"].to_pylist())
            for begin, run in text_slices(batch["text"], model.run):
                ce, n = cross_entropies(model, run)
                mine = where[begin : begin + len(run)]
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(ce[np.arange(len(run)), mine]), pa.array(n)], ["lang", "ce", "n"])
        give_back(*model.broadcasts)

    return spool(rows.select("lang", "text").mapInArrow(measure, "lang long, ce double, n long").where("n > 0"))


def _limits(scores: DataFrame, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Middle and limit of each language, from the rows (lang, ce, n) of all learning rows.

    The middle is the median of ce weighted by n, up to SURE; the limit is taken from medians of all distances from it.
    """
    mean, limit = np.zeros(kinds), np.full(kinds, np.inf)
    weighed = scores.groupBy("lang", "ce").agg(F.sum(F.least("n", F.lit(SURE))).alias("w"))
    total = {r.lang: r.w for r in weighed.groupBy("lang").agg(F.sum("w").alias("w")).collect()}
    if not total:
        return mean, limit
    half = F.element_at(F.create_map(*[F.lit(x) for k, w in total.items() for x in (k, w / 2)]), F.col("lang"))
    upto = running_totals(weighed, ["lang"], ["ce"], {"upto": "w"})
    for r in upto.where(F.col("upto") >= half).groupBy("lang").agg(F.min("ce").alias("ce")).collect():
        mean[r.lang] = r.ce
    middle = F.element_at(F.lit(mean.tolist()), (F.col("lang") + 1).cast("int"))
    far = scores.select("lang", ((F.col("ce") - middle) * F.sqrt(F.least("n", F.lit(SURE_TO_REJECT)).cast("double"))).alias("far"))
    half_way = np.zeros(kinds)
    for (lang,), _, _, (q,) in quantile_table(far, ["far"], [0.5], ["lang"]):
        half_way[lang] = q
    middle = F.element_at(F.lit(half_way.tolist()), (F.col("lang") + 1).cast("int"))
    apart = far.select("lang", F.abs(F.col("far") - middle).alias("apart"))
    for (lang,), _, _, (q,) in quantile_table(apart, ["apart"], [0.5], ["lang"]):
        limit[lang] = max(half_way[lang] + SPREADS * 1.4826 * q, TOLERANCE * SURE_TO_REJECT**0.5)
    return mean, limit


def fit(learn: DataFrame) -> LanguageModel:
    """Learn from `learn` (doc_id, text, lang): whole texts of all its rows."""
    rows = learn.where("lang is not null and text is not null and doc_id is not null")
    fold = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = rows.select("lang", "text", fold.alias("fold"))
    tallies = rows.mapInArrow(_count, "lang string, gram binary, cell long, " + ", ".join(f"{c} long" for c in _BY_FOLD))
    sums = tallies.groupBy("lang", "gram").agg(F.first("cell").alias("cell"), *[F.sum(c).alias(c) for c in _BY_FOLD])
    every = sum((F.col(c) for c in _BY_FOLD[1:]), F.col(_BY_FOLD[0]))
    counts = spool(sums.select("lang", "gram", "cell", every.alias("n"), *[(every - F.col(c)).alias(f"rest{f}") for f, c in enumerate(_BY_FOLD)]))
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], Parts(None, []), np.zeros(0), np.zeros(0))
    models = _Sums(counts, languages).models()
    model = next(models)
    scores = None
    for f, held in enumerate(models):
        some = _measured(rows.where(F.col("fold") == f), languages, held if held.parts else model)
        scores = some if scores is None else scores.unionByName(some)
        held.destroy()
    return LanguageModel(languages, model, *_limits(scores, len(languages)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted, for each row of `docs` (doc_id, text)."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, run in text_slices(batch["text"], model.model.run):
                names, score, ce, ok = model.predict(run)
                ids = batch["doc_id"][begin : begin + len(run)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names), pa.array(score), pa.array(ce), pa.array(ok)], ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])
        give_back(*model.model.broadcasts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def accepted_only(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text the model accepts."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, run in text_slices(batch["text"], model.model.run):
                yield batch.slice(begin, len(run)).filter(pa.array(model.predict(run)[3]))
        give_back(*model.model.broadcasts)

    return docs.mapInArrow(keep, docs.schema)
