"""Toxicity and language ID: held-out accuracy, the models themselves, awkward rows."""

from __future__ import annotations

import pickle
import random
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensorloom.llm import langid, queries, toxicity
from sensorloom.llm.common import SortedHashes, pair_hash, sorted_lookup, words_of

from .data import SF, awkward_documents, no_documents

BIG = "/root/testdata/sf0.1"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows) and all(r.accepted for r in rows)


def test_language_model_is_a_distribution():
    texts = ["the cat and the dog sat on the mat", "der hund und die katze auf dem dach"]
    tables = []
    for t in texts:
        cp, _, _ = langid.symbols([t])
        at = np.flatnonzero(cp)
        tables.append(cp[at[:, None] + np.arange(1 - langid.ORDER, 1)])
    grams, place = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
    counts = np.zeros((len(grams), 2), np.int64)
    np.add.at(counts, (place, np.repeat([0, 1], [len(t) for t in tables])), 1)
    model = langid.build(grams, counts)
    alphabet = sorted({int(x) for x in np.unique(grams)} - {0})
    for start in ("the", "dem da", "zzz"):  # seen, seen, unseen: the chances of all next characters add up to one
        total = np.zeros(2)
        for c in alphabet:
            cp, _, end = langid.symbols([start + chr(c)])
            total += np.exp(langid.log_likelihood(model, cp, np.array([end[0] - 1])))[0] if chr(c) != " " else 0
        space = np.concatenate([langid.symbols([start])[0][: langid.ORDER - 1 + len(start)], [32]]).astype(np.uint32)
        total += np.exp(langid.log_likelihood(model, space, np.array([len(space) - 1])))[0]
        assert np.all(total < 1.0 + 1e-6) and np.all(total > 0.9)


def test_language_awkward_rows(spark):
    docs = awkward_documents(spark)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and not by_id[i].accepted for i in (10, 11, 12, 17))
    kept = langid.accepted_only(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2, 13, 14, 15}.issubset({r.doc_id for r in kept.collect()})
    assert langid.identify(no_documents(spark), model).count() == 0
    nothing = langid.fit(no_documents(spark))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_gibberish_is_rejected(spark):
    learn = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(learn)
    rng = np.random.default_rng(3)
    noise = ["".join(chr(c) for c in rng.integers(0x61, 0x7B, 300)) for _ in range(5)]
    _, _, _, ok = model.predict(noise)
    assert not ok.any()


def test_garbage_among_the_learning_rows_does_not_open_the_gate(spark):
    rng = np.random.default_rng(11)

    def noise(n):
        return ["".join(chr(c) for c in rng.integers(0x61, 0x7B, 300)) for _ in range(n)]

    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    wrong = clean.where("lang = 'de' and doc_id % 10 = 0").selectExpr("doc_id + 500000", "text", "'en'")
    dirty = spark.createDataFrame([(10**6 + i, t, "en") for i, t in enumerate(noise(10))], clean.schema)
    model = langid.fit(clean.unionByName(dirty).union(wrong))
    assert not model.predict(noise(20))[3].any()
    assert langid.accepted_only(clean, model).count() == clean.count()


def test_limits_come_from_all_learning_rows(spark, monkeypatch):
    learn = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 3 = 0 and lang in ('de', 'en')")
    seen = {}
    limits = langid._limits
    monkeypatch.setattr(langid, "_limits", lambda scores, kinds: limits(seen.setdefault("scores", scores), kinds))
    model = langid.fit(learn)
    got = seen["scores"].toPandas()
    rows = learn.where("text is not null").withColumn("fold", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(langid.FOLDS))).toPandas()
    # Plainly: the texts of each fold against a model built from the texts of the others.
    mean, limit = [], []
    plain = {lang: [] for lang in model.languages}
    for f in range(langid.FOLDS):
        tables = []
        for lang in model.languages:
            cp, _, _ = langid.symbols(rows[(rows.fold != f) & (rows.lang == lang)].text.tolist())
            at = np.flatnonzero(cp)
            tables.append(np.unique(cp[at[:, None] + np.arange(1 - langid.ORDER, 1)], axis=0, return_counts=True))
        grams, place = np.unique(np.concatenate([g for g, _ in tables]), axis=0, return_inverse=True)
        counts = np.zeros((len(grams), len(tables)), np.int64)
        np.add.at(counts, (place, np.repeat(np.arange(len(tables)), [len(g) for g, _ in tables])), np.concatenate([n for _, n in tables]))
        built = langid.build(grams, counts)
        for r in rows[rows.fold == f].itertuples():
            cp, first, end = langid.symbols([r.text])
            places = np.arange(first[0], end[0])
            if any(c.isalpha() for c in r.text):
                like = langid.log_likelihood(built, cp, places)[:, model.languages.index(r.lang)]
                plain[r.lang].append((-like.astype(float).mean(), len(places)))
    assert len(got) == sum(map(len, plain.values())) > 200
    for lang in model.languages:
        ce, n = np.array(plain[lang]).T
        order = np.argsort(ce)
        upto = np.cumsum(np.minimum(n, langid.SURE)[order])
        mean.append(ce[order][np.searchsorted(upto, upto[-1] / 2)])
        far = (ce - mean[-1]) * np.sqrt(np.minimum(n, langid.SURE_TO_REJECT))
        spread = 1.4826 * np.median(np.abs(far - np.median(far)))
        limit.append(max(np.median(far) + langid.SPREADS * spread, langid.TOLERANCE * langid.SURE_TO_REJECT**0.5))
    np.testing.assert_allclose(model.mean, mean, rtol=1e-4)
    np.testing.assert_allclose(model.limit, limit, rtol=1e-3)


def _log_likelihood(model, text):
    cp, first, end = langid.symbols([text])
    return model.log_likelihood(cp, np.arange(first[0], end[0])) if isinstance(model, langid.Parts) else langid.log_likelihood(model, cp, np.arange(first[0], end[0]))


def test_rare_5_grams_stay_in_the_model(spark, monkeypatch):
    # Over four million characters, in which the 5-grams of the last rows are seen once or twice.
    common = "the of and to in that it was for on are with as his they be at one have this "
    rows = [(i, common * 2800, "en") for i in range(20)] + [(100, "quixotic zephyr", "en"), (101, "der hund und die katze", "de")]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    tables = []
    for _, text, lang in rows:
        cp, _, _ = langid.symbols([text])
        at = np.flatnonzero(cp)
        grams, counts = np.unique(cp[at[:, None] + np.arange(1 - langid.ORDER, 1)], axis=0, return_counts=True)
        tables.append((grams, np.stack([counts * (lang == x) for x in ("de", "en")], 1)))
    grams, place = np.unique(np.concatenate([g for g, _ in tables]), axis=0, return_inverse=True)
    counts = np.zeros((len(grams), 2), np.int64)
    np.add.at(counts, place, np.concatenate([n for _, n in tables]))
    want = langid.build(grams, counts)
    for shard in (langid.SHARD, 60):
        monkeypatch.setattr(langid, "SHARD", shard)
        model = langid.fit(learn)
        assert len(model.model.parts) == (1 if shard > 60 else -(-(len(grams)) // 60))
        for text in ("quixotic zephyr", "der hund with his zephyr", "unseen wörds"):
            np.testing.assert_allclose(_log_likelihood(model.model, text), _log_likelihood(want, text), rtol=1e-5)
        got = langid.identify(learn, model).collect()
        assert all(r.lang_pred == ("de" if r.doc_id == 101 else "en") for r in got)


def test_5_grams_do_not_reach_the_driver(spark, monkeypatch):
    seen, wide, build = [], langid._wide, langid._build
    monkeypatch.setattr(langid, "SHARD", 60)
    monkeypatch.setattr(langid, "_wide", lambda *a: seen.append(a[-1]) or wide(*a))  # the driver's; tasks load the module anew
    monkeypatch.setattr(langid, "_build", lambda grams, *a: seen.append(grams.shape[1] if len(grams) else 0) or build(grams, *a))
    rows = [(0, "the cat and the dog sat on the mat", "en"), (1, "der hund und die katze auf dem dach", "de"), (2, "a dog", "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(seen) <= {0, 2} and 2 in seen
    assert len(model.model.parts) > 1 and not any("_value" in vars(b) for b in model.model.broadcasts)
    monkeypatch.setattr(langid, "KEPT", 0)
    few = _log_likelihood(model.model, "the dog on the dach")
    assert not any("_value" in vars(b) for b in model.model.parts)
    monkeypatch.setattr(langid, "KEPT", len(model.model.parts))
    assert np.array_equal(few, _log_likelihood(model.model, "the dog on the dach"))
    assert all("_value" in vars(b) for b in model.model.parts)


def test_all_language_models_come_from_one_shuffle(spark, monkeypatch):
    made, spool = [], langid.spool
    monkeypatch.setattr(langid, "spool", lambda df: made.append(df.columns) or spool(df))
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog sat", "en"), ("der hund und die katze", "de"), ("a dog", "en")] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum("model" in columns for columns in made) == 1
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).orderBy("doc_id").collect()] == [r[2] for r in rows]


def test_sorted_hashes_travel_without_their_first_places():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300, 20_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        table = SortedHashes(keys)
        sent = pickle.dumps(table, 5)
        assert len(sent) < keys.nbytes + 1000
        got = pickle.loads(sent)
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 100, dtype=np.uint64)])
        assert np.array_equal(got.first, np.append(np.searchsorted(keys, np.arange(len(table.first) - 1, dtype=np.uint64) << table.shift), n))
        assert np.array_equal(got.find(wanted), sorted_lookup(keys, wanted))


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = queries.op8(spark, BIG).join(labels, "doc_id").where("held_out").collect()
    toxic, plain = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.85 and np.mean([r.predicted for r in plain]) <= 0.01


def test_toxicity_awkward_rows(spark):
    docs = awkward_documents(spark)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0), (13, 1, 1), (13, 1, 0), (10, 1, 1), (11, 1, 0), (19, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for part, share in ((labels.where("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, part)).collect()} == {share}
    assert toxicity.score(no_documents(spark), model).count() == 0
    assert toxicity.score(docs.withColumn("score", F.lit(1)), model).columns == ["doc_id", "score", "predicted"]


def test_rare_toxic_expressions_count_in_a_large_corpus(spark):
    # Six million counts; two words, and their pair, stand in five texts, all of them toxic.
    def texts(batches):
        for batch in batches:
            ids = batch["id"].to_pylist()
            common = [" ".join(f"w{(i * 37 + k) % 3000}" for k in range(1000)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([t + " zorg blatt" * (i % 1200 == 7) for i, t in zip(ids, common, strict=True)])], ["doc_id", "text"])

    docs = spark.range(0, 6000, 1, 8).mapInArrow(texts, "doc_id long, text string")
    labels = spark.range(6000).selectExpr("id as doc_id", "cast(id % 120 = 7 as int) as toxic")
    model = toxicity.fit(docs, labels)
    word = words_of([b"zorg blatt"], toxicity._GAP, toxicity._SAME)[0]
    one = model.ratio.one[np.isin(model.ratio.words, word)]
    two = model.ratio.two[model.ratio.pairs == pair_hash(word[:1], word[1:])[0]]
    assert len(one) == 2 and len(two) == 1 and (one > 0).all() and two[0] > 0


def _plain_kneser_ney(texts, own, marks, least, sigmas, d=toxicity.DISCOUNT):
    """Sums of log-ratios of the words `own` under models of `texts` marked `marks`: over all pairs, and where the classes differ."""
    def pairs(words):
        return set(zip(["<s>", *words], words, strict=False))

    n = [Counter(p for t, m in zip(texts, marks, strict=True) if m == k for p in pairs(t)) for k in (0, 1)]
    after = [Counter(w for _, w in c) for c in n]
    followers = [Counter(v for v, _ in c) for c in n]
    context, words = ([sum((Counter({p[side]: x}) for p, x in c.items()), Counter()) for c in n] for side in (0, 1))
    anywhere = Counter(w for _, w in set(n[0]) | set(n[1]))
    share = sum(n[1].values()) / (sum(n[0].values()) + sum(n[1].values()))

    def single(k, w):
        lowest = (anywhere[w] + 1) / (sum(anywhere.values()) + len(anywhere) + 1)
        return (max(after[k][w] - d, 0) + d * len(after[k]) * lowest) / sum(after[k].values())

    def double(k, v, w):
        if not context[k][v]:
            return single(k, w)
        return (max(n[k][v, w] - d, 0) + d * followers[k][v] * single(k, w)) / context[k][v]

    def differs(a, b):
        return a + b >= least and abs(b - (a + b) * share) - 0.5 > sigmas * ((a + b) * share * (1 - share)) ** 0.5

    gain = {(v, w): log(double(1, v, w) / double(0, v, w)) for v, w in pairs(own)}
    apart = {p for p in gain if differs(n[0][p], n[1][p])}
    alone = {w for v, w in set(gain) - apart if differs(words[0][w], words[1][w])}
    return sum(gain.values()), sum(gain[p] for p in apart) + sum(log(single(1, w) / single(0, w)) for w in alone)


def test_toxicity_is_plain_kneser_ney_over_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    # Many words stand in one text only; some belong to one class.
    texts = [[rng.choice(["a", "b", "c", "d", "e", "z" if i % 3 == 0 else "y", f"r{rng.randrange(150)}"]) for _ in range(rng.randrange(1, 25))] for i in range(60)]
    marks = [int(i % 3 == 0) for i in range(60)]
    monkeypatch.setattr(toxicity, "LEAST", 2)
    monkeypatch.setattr(toxicity, "SIGMAS", 1.0)
    monkeypatch.setattr(toxicity, "SHARD", 30)  # several parts
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    assert len(model.ratio.pairs_.parts) > 2 and len(model.ratio.words_.parts) > 1
    others = [["a", "unseen", "b", "a", "unseen"], ["z", "z", "z"], []]
    got = model.ratio.features([" ".join(t).encode() for t in texts + others])
    for t, x in zip(texts + others, got, strict=True):
        want = _plain_kneser_ney(texts, t, marks, 2, 1.0)
        np.testing.assert_allclose(x[[0, 2]] * max(len(t), 1), want, atol=1e-9)
    # A learning row is measured by models of all rows but itself.
    left_out = model.ratio.features([" ".join(t).encode() for t in texts], np.array(marks))
    for i, t in enumerate(texts):
        want = _plain_kneser_ney(texts[:i] + texts[i + 1 :], t, marks[:i] + marks[i + 1 :], 2, 1.0)
        np.testing.assert_allclose(left_out[i, [0, 2]] * len(t), want, atol=1e-9)


def test_toxicity_curve_is_fitted_on_all_learning_rows(spark, monkeypatch):
    learn = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, fitted = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda rows, scale: seen.append(rows.toPandas()) or fitted(rows, scale))
    model = toxicity.fit(learn, labels)
    rows = seen[0]
    assert len(rows) == learn.join(labels.where("toxic is not null").select("doc_id").distinct(), "doc_id").count()
    x, y = rows[list(toxicity.Ratio.NAMES)].to_numpy() / model.scale, rows["y"].to_numpy()
    p = 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))
    slope = np.append(x, np.ones((len(x), 1)), 1).T @ (p - y) + 1e-2 * model.weights
    assert np.abs(slope).max() < 1e-4
