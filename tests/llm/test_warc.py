import hashlib
import os
import struct

import pytest
import zstandard

from airshed.llm import warc
from airshed.llm.queries import QUERIES

PAGES = [(3, "http://a/x y", "same"), (1, "http://b", "same"), (2, None, None), (4, "http://c", ""), (None, "u", "same"),
         (5, "http://d", "ünïcode 日本 \r\n\r\n WARC/1.1"), (6, "http://e\r\nEvil: 1", "x" * 3_000_000), (7, "http://f", "P*M\x18\x00\x00\x00\x00" * 3),
         (1, "http://b", "same")]


def pages(spark, rows=PAGES):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"payload": F.lit("clash"), "digest": F.lit(1), "first": F.lit(2), "revisit": F.lit(3)})


@pytest.mark.parametrize("size", [1 << 24, 1000])
def test_round_trip(spark, tmp_dir, size):
    path = os.path.join(tmp_dir, "w")
    warc.write_archives(spark, pages(spark), path, archive_bytes=size)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(PAGES)
    texts = {p: (h or "").encode() for p, _, h in PAGES}
    for r in got:
        payload = texts[r["page_id"]]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == warc.payload_digest(payload)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == payload and r["refers_to"] is None
    kind = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (1, 2, 3, 4, None))
    assert kind == [("1", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", 1),
                    ("4", "revisit", 2), ("None", "revisit", 1)]


def test_small_payloads_stay_responses(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w")
    warc.write_archives(spark, pages(spark), path, min_bytes=5)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_empty_table(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w")
    warc.write_archives(spark, pages(spark).where("false"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_whole_table_uses_a_dictionary(spark):
    got = QUERIES["op8_warc"](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {r["page_id"]: hashlib.sha1((r["html"] or "").encode()).digest() for r in rows}
    assert len(got) == len(want) and all(warc.base64.b32decode(r["payload_digest"]) == want[r["page_id"]] for r in got)


def archive(records, dictionary=b""):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary \
        else zstandard.ZstdCompressor()
    return warc.skippable(dictionary) + b"".join(c.compress(r) + warc.SEPARATOR.encode() for r in records)


def record(payload=b"hello"):
    return warc.build_record(1, "http://a", payload, warc.payload_digest(payload), None, False)


def test_compressed_dictionary_is_loaded():
    sample = [record(f"page {i} of the sample, with the usual words {i * 7}".encode()) for i in range(800)]
    raw = zstandard.train_dictionary(4096, sample).as_bytes()
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    data = warc.skippable(zstandard.ZstdCompressor().compress(raw)) + c.compress(record())
    assert [warc.parse_record(f)["payload"] for f in warc.frames(data)] == [b"hello"]


@pytest.mark.parametrize("damage", [
    lambda d: d[8:],                                            # no dictionary frame
    lambda d: d[:-20],                                          # cut short
    lambda d: d + b"junk junk",                                 # stray bytes
    lambda d: d + struct.pack("<II", 0x12345678, 4) + b"abcd",  # unknown frame
])
def test_broken_archives_fail(damage):
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.frames(damage(archive([record(), record(b"second")]))))


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response", b"WARC-Type: metadata"), (b"hello", b"hullo"),
    (b"Content-Length: 5", b"Content-Length: 6"), (b"\r\n\r\nHTTP", b"\r\nHTTP"), (b"WARC-Date", b"WARC-Type"),
    (b"<urn:x-page:1>", b"<urn:x-page:x>"), (b"sha1:", b"md5:"), (b"hello\r\n\r\n", b"hello\r\n")])
def test_broken_records_fail(change):
    with pytest.raises(warc.WarcError):
        warc.parse_record(record().replace(*change))
