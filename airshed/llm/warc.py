"""WARC archives in Zstandard frames (operator 8): writer and reader.

Layout of an archive file: a leading skippable frame (magic 0x184D2A5D) holds
the compression dictionary, then every record is one Zstandard frame.  Spark's
text writer stores the frames, with an *empty skippable frame* as line
separator, so files go to any file system Spark can write, through its commit
protocol, and stay valid Zstandard streams.  The reader takes whole archive
files (``binaryFile``), loads the dictionary, decodes frame by frame and
validates headers and lengths.

Archives hold about ``archive_bytes`` of payload, which bounds what a task
reads at once; one larger payload makes one larger archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Format constants.
DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 16 << 10
#: The dictionary is trained on at most this many payloads (a bounded sample).
DICT_SAMPLE = 400
_ID = re.compile(rb"^<urn:x-page:(-?\d+|none)>$")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def skippable(data: bytes, magic: int = DICT_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with HTTP headers and payload, or a revisit with HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {RECORD_DATE}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[bytes, dict[bytes, bytes], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{what}: headers do not end")
    first, *lines = head.split(b"\r\n")
    fields: dict[bytes, bytes] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise WarcError(f"{what}: bad header line {line[:80]!r}")
        if name.lower() in fields:
            raise WarcError(f"{what}: repeated header {name!r}")
        fields[name.lower()] = value.strip()
    return first, fields, rest


def _page(value: bytes | None, what: str) -> int | None:
    m = _ID.match(value or b"")
    if not m:
        raise WarcError(f"{what}: bad record id {value!r}")
    return None if m[1] == b"none" else int(m[1])


def _number(fields: dict[bytes, bytes], what: str) -> int:
    value = fields.get(b"content-length", b"")
    if not value.isdigit():
        raise WarcError(f"{what}: no valid Content-Length")
    return int(value)


def parse_record(data: bytes) -> dict:
    """Validate one decoded record; its fields and (for a response) its payload."""
    version, fields, rest = _headers(data, "record")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"unknown version {version[:20]!r}")
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in fields:
            raise WarcError(f"missing header {name.decode()}")
    size = _number(fields, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length says {size}")
    page_id = _page(fields[b"warc-record-id"], "WARC-Record-ID")
    status, http, payload = _headers(rest[:size], "http")
    if not status.startswith(b"HTTP/1."):
        raise WarcError(f"bad status line {status[:40]!r}")
    payload_bytes = _number(http, "http")
    kind = fields[b"warc-type"].decode("ascii", "replace")
    sha = fields.get(b"warc-payload-digest", b"")
    if not re.match(rb"sha1:[A-Z2-7]{32}$", sha):
        raise WarcError(f"bad payload digest {sha!r}")
    digest = sha[5:].decode()
    out = {"page_id": page_id, "payload_bytes": payload_bytes, "payload_digest": digest, "record_type": kind,
           "refers_to": None, "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None,
           "payload": None}
    if kind == "response":
        if len(payload) != payload_bytes:
            raise WarcError(f"payload of {len(payload)} bytes, http says {payload_bytes}")
        if payload_digest(payload) != digest:
            raise WarcError("payload does not match its digest")
        out["payload"] = payload
    elif kind == "revisit":
        if payload:
            raise WarcError("a revisit carries a payload")
        if fields.get(b"warc-profile") != PROFILE.encode():
            raise WarcError("unknown revisit profile")
        out["refers_to"] = _page(fields.get(b"warc-refers-to"), "WARC-Refers-To")
    else:
        raise WarcError(f"unexpected record type {kind!r}")
    return out


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive, in order; the leading skippable frame is the dictionary."""
    at, end, view, dctx = 0, len(data), memoryview(data), None
    while at < end:
        if end - at < 8:
            raise WarcError(f"{end - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", data, at)
        if dctx is None:
            if magic != DICT_MAGIC or at + 8 + size > end:
                raise WarcError("no leading dictionary frame")
            raw = data[8:8 + size]
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            dctx = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(raw)) if raw \
                else zstandard.ZstdDecompressor()
            at += 8 + size
        elif magic in SKIP_MAGICS:
            if at + 8 + size > end:
                raise WarcError("skippable frame cut short")
            at += 8 + size
        elif magic == FRAME_MAGIC:
            one, parts = dctx.decompressobj(), []
            while not one.eof and at < end:  # in small steps, so that little is read past the frame
                step = view[at:at + 4096]
                parts.append(one.decompress(step))
                at += len(step)
            if not one.eof:
                raise WarcError("record frame cut short")
            at -= len(one.unused_data)
            yield b"".join(parts)
        else:
            raise WarcError(f"unknown frame {magic:#x}")


def train_dictionary(payloads: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from sample records; empty when there is too little to learn from."""
    if sum(map(len, payloads)) < 8 * size or len(payloads) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def _rows(pages: DataFrame, page_id: str) -> DataFrame:
    """(page_id, url, payload, digest, row): ``row`` names the page id and the payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    return rows.withColumn("row", F.concat_ws(" ", "digest", F.col("page_id").cast("string")))


def revisits(pages: DataFrame, page_id: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """(row, response_id) of the pages that revisit an earlier one; payloads do not travel.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page id is
    the response.  Digests are reduced inside each task before the shuffle;
    a payload shared by very many pages is then one row per task, and the
    join back (against one row per digest) can be split by adaptive execution.
    """
    rows = _rows(pages, page_id).where(F.octet_length("payload") >= min_bytes).select("page_id", "digest", "row")
    firsts = (rows.groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "response_id"))
    # a later row (or one without an id) revisits the first; rows that tie with it stay responses
    return (rows.join(firsts, "digest").where(F.col("response_id").isNotNull()
                                              & ~F.col("page_id").eqNullSafe(F.col("response_id")))
            .select("row", "response_id").distinct())


def write_archives(spark: SparkSession, pages: DataFrame, path: str, page_id: str = "page_id", min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html), in archives below ``path``.

    A null html is an empty payload, a null url leaves the header out, a null
    page id writes the id ``none`` and never is the response of others with
    an id; rows with equal page id and payload are all responses if that id
    is the smallest.  Further columns are ignored.  Payloads are shuffled
    once, into the archives.
    """
    sample = [bytes(r["p"]) for r in pages.select(F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p"))
              .where(F.octet_length("p") < 1 << 16).limit(DICT_SAMPLE).collect()]
    dictionary = train_dictionary(sample)
    total = pages.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    archives = max(1, -(-total // archive_bytes))
    dealt = _rows(pages, page_id).repartition(archives, "row")
    # the join keeps that partitioning, and holds one archive's revisits in a hash table
    joined = dealt.join(revisits(pages, page_id, min_bytes).hint("shuffle_hash"), "row", "left")
    slim = joined.select("page_id", "url", "payload", "digest", "response_id")
    lead = skippable(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if dictionary:
            cctx = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        else:
            cctx = zstandard.ZstdCompressor(write_checksum=True)
        begun = False
        for b in batches:
            out = []
            cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "response_id")]
            for row in zip(*cols, strict=True):
                pid, url, payload, digest, first = (x.as_py() for x in row)
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(cctx.compress(build_record(pid, url, payload, name, first, first is not None)))
            if out and not begun:
                out.insert(0, lead)
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    (slim.mapInArrow(write, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "none").text(path))


RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; a broken archive or record fails the read."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("payload", pa.binary())])
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for record in frames(content.as_py()):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size > 4 << 20:  # bounded batches
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(read, RECORD)
