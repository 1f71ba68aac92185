"""Substring dedup (operator 6): sliding sentence spans.

Every run of ``RUN`` consecutive sentences of a document is hashed; runs that
more than one document holds are found by one global grouping, and sentences
covered by a run that is not its first occurrence are removed.  Occurrences
are ordered by document id, then place.

* A sentence ends at ``.``, ``!`` or ``?`` before white space, at an
  ideographic full stop, and at a line end; one of more than ``PIECE`` words
  counts as several, cut by content so that a passage inside it is found too.
  Sentences are compared by their lower-cased letters and digits.
* Removed stretches have at least ``min_words`` words, as every run of three
  pieces of a long sentence has; only chance runs of tiny sentences stay.

Data flow: the runs are written once.  (hash, id) rows are reduced to the
smallest and largest id inside each task before the shuffle; the hashes with
two ids are joined back to the runs (adaptive execution splits the runs of a
hash that very many documents share), which gives at most one row per run; a
document's runs are collected by document only.  A bitmap of the shared hashes
(``BITS`` bits at any size, broadcast) keeps runs that no other document has
out of that join's shuffle; where bits collide a run only travels in vain, and
the join decides by the whole hash.  The text itself is shuffled once, to meet
its own runs.

Defined results: a null text stays null and an empty one empty; documents of
fewer than ``RUN`` sentences never change; rows that repeat an id count as one
document for the order (so equal rows stay equal), and rows without an id as
one document after all others.  Columns of the input keep their values, but
for the text; n_sentences, n_removed and words_removed are added (and replace
columns so named).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.llm.tables import kept
from airshed.llm.words import alnum_bytes, mix

RUN = 3
PIECE = 16
LEAST = 4
CUT = 3  # one word in so many ends a piece
MIN_WORDS = 12
BITS = 1 << 27
_END = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|\xe3\x80\x82")
_WORD = re.compile(rb"[^ ]+")


def _pieces(words: list[bytes]) -> list[int]:
    """Ends of the pieces of a long sentence.

    A piece ends after a word whose code says so (one in ``CUT``), so that equal
    stretches are cut alike whatever stands before them.
    """
    out, start = [], 0
    for i, w in enumerate(words, 1):
        if i == len(words) or i - start == PIECE or i - start >= LEAST and crc32(w) % CUT == 0:
            out.append(i)
            start = i
    return out


def sentences(text: bytes) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """Byte ranges that tile the text, the normalised sentence of each, and its words."""
    plain = alnum_bytes(text)
    ranges: list[tuple[int, int]] = []
    keys: list[bytes] = []
    sizes: list[int] = []
    start, at = 0, 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        words = plain[at:end].split()
        if not words:  # no word: goes with what follows
            at = end
            continue
        if len(words) <= PIECE:
            ranges.append((start, end))
            keys.append(b" ".join(words))
            sizes.append(len(words))
        else:
            places = [m.start() for m in _WORD.finditer(plain, at, end)]
            cuts = _pieces(words)
            for i, j in zip([0, *cuts], cuts, strict=False):
                stop = end if j == len(words) else places[j]
                ranges.append((start, stop))
                keys.append(b" ".join(words[i:j]))
                sizes.append(j - i)
                start = stop
        start = at = end
    if ranges:
        ranges[-1] = (ranges[-1][0], len(text))
    return ranges, keys, sizes


def run_hashes(keys: list[bytes]) -> np.ndarray:
    """(n - RUN + 1, 2) 64-bit codes: 128 bits per run of sentences."""
    n = len(keys) - RUN + 1
    if n <= 0:
        return np.zeros((0, 2), np.int64)
    one = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    out = np.zeros((n, 2), np.uint64)
    for j in range(RUN):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + one[j:j + n])
    return out.view(np.int64)


def _runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2, id, check, place) of every run of sentences, once per document and hash."""
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("check"),
                      F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, lengths, places = [], [], []
            for t in b.column("t").cast(pa.binary()):
                h = run_hashes(sentences(t.as_py() or b"")[1])
                # the first place of a hash in this document; the others are found again when it is cleaned
                _, first = np.unique(h, axis=0, return_index=True) if len(h) > 1 else (None, np.arange(len(h)))
                hashes.append(h[first])
                places.append(first)
                lengths.append(len(first))
            rows = np.repeat(np.arange(len(lengths)), lengths)
            h = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.int64)
            for i in range(0, len(rows), 100_000):
                cut = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[cut, 0])), pa.array(np.ascontiguousarray(h[cut, 1])),
                     b.column("id").take(pa.array(rows[cut])), b.column("check").take(pa.array(rows[cut])),
                     pa.array(np.concatenate(places)[cut].astype(np.int32))],
                    names=["h1", "h2", "id", "check", "place"])

    return src.mapInArrow(run, T.StructType([
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), src.schema["id"], src.schema["check"],
        T.StructField("place", T.IntegerType())]))


def _met(runs: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``runs`` whose bit is set by a hash of ``shared``: all that join it, and few others."""
    at = F.col("h1").bitwiseAND(F.lit(BITS - 1))
    bits = (shared.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    place = F.bitmap_bit_position(at)
    byte = F.col("bits").substr(F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    bit = F.pow(F.lit(2), place.bitwiseAND(F.lit(7))).cast("int")
    return (runs.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket")
            .where(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(bit) != 0).select(*runs.columns))


def later_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, check, places): per document the runs that an earlier document holds too."""
    spark = docs.sparkSession
    runs = kept(spark, _runs(docs, doc_id, text), "runs")
    shared = (runs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                           F.max(F.col("id").isNull().cast("int")).alias("without"))
              .where((F.col("first") < F.col("last")) | (F.col("first").isNotNull() & (F.col("without") == 1)))
              .select("h1", "h2", "first"))
    shared = kept(spark, shared, "shared-runs")
    return (_met(runs, shared).join(shared, ["h1", "h2"])
            .where(F.col("id").isNull() | (F.col("id") > F.col("first")))
            .groupBy("id", "check").agg(F.collect_set("place").alias("places")))


def covered(keys: list[bytes], sizes: list[int], places: list[int], min_words: int) -> np.ndarray:
    """Which sentences to remove: covered by a run at ``places`` or by one that this text has before."""
    h = run_hashes(keys)
    later = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((h[:, 1], h[:, 0]))  # stable: places of a hash stay in order
        same = (h[order][1:] == h[order][:-1]).all(axis=1)
        later[order[1:][same]] = True
        if places:
            hit = np.zeros(len(h), bool)
            hit[places] = True
            # a run found elsewhere is removed at each of its places
            group = np.cumsum(np.r_[True, ~same])
            bad = np.zeros(group[-1] + 1, bool)
            bad[group[hit[order]]] = True
            later[order] |= bad[group]
    out = np.zeros(len(keys), bool)
    for j in range(RUN):
        out[j:j + len(h)] |= later
    edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if sum(sizes[a:b]) < min_words:
            out[a:b] = False
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated sentences removed from the text (see the module's rules)."""
    made = ("n_sentences", "n_removed", "words_removed")
    keep = [c for c in docs.columns if c not in made]
    later = later_runs(docs, doc_id, text).select(F.col("id").alias("__id"), F.col("check").alias("__check"),
                                                  F.col("places").alias("__places"))
    # texts under one id are told apart by their check
    checked = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(f"`{text}`").alias("__check"))
    joined = checked.alias("d").join(
        later.alias("r"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("r.__id"))
        & (F.col("d.__check") == F.col("r.__check")), "left") \
        .select(*[F.col(f"d.`{c}`") for c in keep], F.col("r.__places"))
    out = T.StructType([*[joined.schema[c] for c in keep], T.StructField("n_sentences", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("words_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], ([], [], [])
            for t, places in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("__places").to_pylist(),
                                 strict=True):
                ranges, keys, sizes = sentences(t or b"")
                gone = covered(keys, sizes, places or [], min_words)
                counts[0].append(len(keys))
                counts[1].append(int(gone.sum()))
                counts[2].append(sum(s for s, g in zip(sizes, gone, strict=True) if g))
                if gone.any():
                    t = b"".join(t[a:e] for (a, e), g in zip(ranges, gone, strict=True) if not g)
                texts.append(t)
            arrays = {c: b.column(c) for c in keep}
            arrays[text] = pa.array(texts, pa.binary()).cast(b.column(text).type)
            arrays |= {c: pa.array(v, pa.int64()) for c, v in zip(made, counts, strict=True)}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return joined.mapInArrow(run, out)
