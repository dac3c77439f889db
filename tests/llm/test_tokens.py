from __future__ import annotations

import glob
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import tokens

from .data import SF, awkward_documents, no_documents


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return t


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    texts = ["a  b", "a \n b", " x", "\n\nq", "tab\tx", "nb sp  \n", "it's  we'll", "é² ³.", "", "\n", " ", "a b", "don't stop 12 ab12", "<|endoftext|> hi", "a\nb c.\nd", "x\x1cy z", "end ", "end\n", "  wide", "a\x00b c"]
    store = tokens.Pieces(tokens.vocabulary_path())
    for _ in range(2):  # new pieces, then remembered ones
        got = tokens._encode_texts(store, texts, 2)
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == _ids(tokenizer, text), text


def test_random_texts_with_a_small_memory(tokenizer, monkeypatch):
    rng = random.Random(4)
    parts = ["a", "the", " the", "\n", " ", "é", "\U0001f600", "'s", "12", ".", "zzzzqx", "\t", "  ", "日本", "<s>", "\ud800"[:0]]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3_000)]
    texts += ["word " * 50 + f"w{i} x{i * 7}" for i in range(500)]
    monkeypatch.setattr(tokens, "MEMORY", 300)
    monkeypatch.setattr(tokens, "LONG", 120)
    store = tokens.Pieces(tokens.vocabulary_path())
    for top in range(0, len(texts), 70):
        for text, ids in zip(texts[top : top + 70], tokens._encode_texts(store, texts[top : top + 70], 2), strict=True):
            assert ids.tolist() == _ids(tokenizer, text), text
    assert sum(len(t["keys"]) for t in store.tiers) < 1_000


def test_pieces_that_share_a_key_keep_their_own_ids():
    store = tokens.Pieces(tokens.vocabulary_path())
    words = ["alpha", "beta", "gamma"]
    want = [store.whole(w).tolist() for w in words]
    for _ in range(3):
        for k in (0, 1, 2, 1):
            ids, begin, counts = store.ids_of(np.array([7], np.uint64), np.array([k], np.uint32), lambda _, k=k: words[k])
            assert tokens.gathered(ids, begin, counts).tolist() == want[k]


def test_files_against_a_plain_encoding(spark, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").repartition(5)
    path = str(tmp_path / "t")
    tokens.write_tokens(docs, path)
    got = {r.doc_id: r for r in tokens.token_digests(spark, path).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = _ids(tokenizer, r.text)
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    files = sorted(glob.glob(f"{path}/part-*"))
    order = [x for f in files for x in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert order == sorted(order)
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["part_start"].encodings
    assert "RLE_DICTIONARY" in by_name["tokens.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in by_name.values() if "tokens" not in c.path_in_schema)


def test_awkward_rows(spark, tokenizer, tmp_path):
    docs = awkward_documents(spark)
    path = str(tmp_path / "a")
    tokens.write_tokens(docs, path)
    rows = sorted(tokens.token_digests(spark, path).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows[:-1], rows[1:], strict=True))
    want = sorted(zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for i in (_ids(tokenizer, r.text) for r in docs.collect()))
    assert sorted(r.ids_crc32 for r in rows) == want
    tokens.write_tokens(no_documents(spark), str(tmp_path / "n"))
    assert tokens.token_digests(spark, str(tmp_path / "n")).count() == 0


def test_metadata_is_read_without_ids(spark, tmp_path):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('word ', 5) as text")
    tokens.write_tokens(docs, str(tmp_path / "m"))
    plan = tokens.read_tokens(spark, str(tmp_path / "m"), ("doc_id", "n_tokens")).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,7)" in plan


def test_gathering_ids_holds_little_beside_them():
    counts = np.full(500_000, 4)
    begin = np.arange(500_000)[::-1].copy()
    values = np.arange(500_004, dtype="<u4")
    tracemalloc.start()
    got = tokens.gathered(values, begin, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, (begin[:, None] + np.arange(4)).ravel()) and got.dtype == values.dtype
    assert peak < 30_000_000  # 8 MB of ids; the places of all of them at once took 36 MB
