from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

from sensorloom.llm import warc

SCHEMA = "page_id long, url string, html string, original long, value string"


def _sha(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def _expected(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, html in rows:
        ids = [p for p in groups[html or ""] if p is not None]
        first = max(ids, default=None)
        revisit = len(groups[html or ""]) > 1 and first is not None and page != first
        size = len((html or "").encode())
        out.append((page, size, _sha(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip_with_awkward_payloads(spark, tmp_path):
    nasty = "WARC/1.1\r\nWARC-Run-ID: x\r\n\r\nContent-Length: 5\r\n\r\n"
    pages = [
        (1, "http://a/1", "same"),
        (2, "http://a/2", "same"),
        (9, "http://a/2", "same"),
        (3, "http://a/\r\nWARC-Type: evil", nasty),
        (4, None, nasty * 3),
        (5, "http://a/5", None),
        (6, "http://a/6", ""),
        (7, "http://a/7", "é\n\r\n\r\n" * 5),
        (8, "http://a/8", "z" * 200_000),
        (None, "http://a/n", "only"),
        (None, None, "same"),
        (10, "u", "twice"),
        (10, "u", "twice"),
    ]
    df = spark.createDataFrame([(*p, 5, "clash") for p in pages], SCHEMA).repartition(4)
    path = str(tmp_path / "w")
    run = warc.write_archives(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # records and their heads fall across splits
    try:
        got = warc.read_archives(spark, path, run).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    fields = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(fields, key=str) == _expected([(p, h) for p, _, h in pages])
    held = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert held[4] == nasty * 3 and held[9] == "same" and held[7] == "é\n\r\n\r\n" * 5
    assert {r.page_id: r.url for r in got}[3] == "http://a/%0D%0AWARC-Type: evil"


def test_threshold_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    run = warc.write_archives(df, str(tmp_path / "t"), min_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path / "t"), run).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    run = warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e"), run).count() == 0


def test_a_damaged_record_raises(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    run = warc.write_archives(df, str(tmp_path / "d"))
    for part in (tmp_path / "d").glob("part-*"):
        part.write_bytes(part.read_bytes().replace(b"abc", b"abd"))
    for crc in (tmp_path / "d").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="differs from its headers"):
        warc.read_archives(spark, str(tmp_path / "d"), run).collect()
