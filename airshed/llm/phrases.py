"""Phrase collocation mining (operator 11), by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the
pieces into words ``[^\\x20\\x09]+``.  A phrase is a run of words of one piece;
everything is counted per language.

1. *Shards.*  The table is dealt into ``SHARDS`` shards by task.  A shard's
   local support is the global one times its share of all bytes, rounded up:
   shares add up to 1, so a phrase of global support reaches the local support
   of a shard, whatever the shares are.
2. *Local mining.*  Every shard's phrases are counted completely.  A task
   counts its own words first and deals the counted phrases into buckets by
   hash (compressed columns, one row per bucket); a bucket sees every shard's
   counts of its phrases.  Phrases of local support in some shard are candidates.
3. *Global count.*  The union of the candidates is counted over all shards,
   exactly, in the bucket that holds them, and kept at global support.

The number of buckets follows the measured bytes, so that a bucket's phrases
fit a task at every size; a hot phrase is one row a task and bucket.  Strings
are compared, never hashes.  Scores and containment are joins of the table of
frequent phrases: every part of a frequent phrase is frequent, so it is there.

Defined results: null texts are empty, a null language is ``und``; empty texts
and tables give no rows; repeated rows count repeatedly; other columns don't
matter; a text of any length is counted whole; equal scores and counts are
ordered by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.tables import kept
from airshed.llm.words import mix

SHARDS = 4
SUPPORT = 10
MAX_WORDS = 3
BUCKET_BYTES = 2 << 20      # bytes of text per bucket
HELD = 2_000_000            # words a task holds before it hands their phrases over
PARTS = 16                  # parts in which a language's phrases are ranked first
_CUT = b"\n"
# A-Z to a-z, the piece ends to a line feed, a tab to a blank
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c
               for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, a line feed before every piece; blanks that follow each other give empty tokens."""
    return (_CUT + text.translate(_TABLE)).replace(_CUT, b" \n ").split(b" ")


class Numbers(dict):
    """A number per token, in order of first use; 0 for empty ones, 1 for the piece end."""

    def __init__(self):
        super().__init__({b"": 0, _CUT: 1})

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def counted_runs(codes: np.ndarray, words: pa.Array, marks: np.ndarray,
                 longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, hashes, counts) of the runs of 1 to ``longest`` words, one item a length.

    ``codes`` are token numbers (1: piece end), ``marks`` a hash per number."""
    at = np.flatnonzero(codes != 1)          # where the runs of this length begin
    run = codes                              # number of the run that begins at each place
    texts, hashes = words, marks
    for k in range(1, longest + 1):
        if k > 1:
            at = at[at < len(codes) - k + 1]
            at = at[codes[at + k - 1] != 1]
        if not len(at):
            return
        # the run without its last word, and the last word: numbers below places and words, so one integer
        key = codes[at] if k == 1 else run[at] * np.int64(len(marks)) + codes[at + k - 1]
        distinct, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        if k == 1:
            texts, hashes = words.take(pa.array(distinct)), marks[distinct]
        else:
            head, last = distinct // len(marks), distinct % len(marks)
            texts = pc.binary_join_element_wise(texts.take(pa.array(head)), words.take(pa.array(last)), b" ")
            hashes = mix(hashes[head] + marks[last])
        run = np.zeros(len(codes), np.int64)
        run[at] = inverse
        yield texts, hashes, counts


def local_support(support: int, share: float) -> int:
    """Least count in a shard of this share; rounded down against floating-point error before the ceiling."""
    return max(1, math.ceil(support * share - 1e-9))


_DEALT = "bucket int, lang string, shard int, phrases binary, counts binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()),
                          ("phrases", pa.binary()), ("counts", pa.binary())])
_COUNTED = "lang string, phrase string, words int, f long"


def _dealt(docs: DataFrame, lang: str, text: str, buckets: int, shards: int, longest: int) -> DataFrame:
    """(bucket, lang, shard, phrases, counts): each task's counted phrases, dealt by hash."""
    df = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        pack = zstandard.ZstdCompressor(level=1).compress
        held: dict[str, list[np.ndarray]] = {}
        numbers, size = Numbers(), 0

        def packed(language: str, phrases: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            lines = pc.binary_join_element_wise(phrases.take(pa.array(order)), b"", _CUT)  # every phrase ends a line
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
            data, counts = memoryview(lines.buffers()[2]), counts[order].astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield (int(bucket[order[i]]), language, shard, pack(data[ends[i]:ends[j]]), pack(counts[i:j].tobytes()))

        def handed() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(numbers), pa.binary())
            marks = mix(np.fromiter(map(crc32, numbers), np.uint64, len(numbers)))
            for language, parts in held.items():
                codes = np.concatenate(parts)
                total = int((codes != 1).sum())
                rows = [r for run in counted_runs(codes, words, marks, longest) for r in packed(language, *run)]
                # the empty phrase carries the number of words
                rows += packed(language, pa.array([b""], pa.binary()), np.array([crc32(language.encode())], np.uint64),
                               np.array([total]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _DEALT_ARROW.types)], schema=_DEALT_ARROW)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for language, value in zip(batch.column(0).to_pylist(), texts):
                found = tokens(value.as_py())
                codes = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                codes = codes[codes > 0]
                held.setdefault(language, []).append(codes)
                size += len(codes)
                if size > HELD:
                    yield from handed()
                    held.clear()
                    numbers, size = Numbers(), 0
        yield from handed()

    return df.mapInArrow(work, _DEALT)


def _lines(packed: bytes) -> pa.Array:
    """The lines of a packed text as an array of binaries (without copying them)."""
    data = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).astype(np.int32)
    offsets = np.r_[np.int32(0), ends + np.int32(1)]
    whole = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pc.binary_slice(whole, 0, -1)


def _mined(dealt: DataFrame, least: list[int], support: int) -> DataFrame:
    """(lang, phrase, words, f): phrases of local support in some shard and of global support;
    the empty phrase carries the words of a language that the bucket's tasks counted."""
    def work(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        phrases, numbers, langs, shards = [], [], [], []
        for language, shard, lines, counts in zip(*(group.column(c).to_pylist()
                                                    for c in ("lang", "shard", "phrases", "counts"))):
            phrases.append(_lines(lines))
            numbers.append(np.frombuffer(unpack(counts), np.uint32).astype(np.int64))
            langs.append(pa.repeat(language, len(phrases[-1])))
            shards.append(np.full(len(phrases[-1]), shard, np.int32))
        rows = pa.table({"lang": pa.chunked_array(langs, pa.string()).dictionary_encode(),
                         "phrase": pa.chunked_array(phrases, pa.binary()),
                         "shard": np.concatenate(shards), "n": np.concatenate(numbers)})
        # every shard's phrases, completely
        mined = rows.group_by(["lang", "phrase", "shard"], use_threads=False).aggregate([("n", "sum")])
        n, low = mined.column("n_sum"), np.array(least)[mined.column("shard").to_numpy()]
        local = pc.greater_equal(n, pa.array(low))
        # the union of locally frequent phrases, counted over all shards
        union = mined.append_column("local", local) \
            .group_by(["lang", "phrase"], use_threads=False).aggregate([("local", "max"), ("n_sum", "sum")])
        phrase, f = union.column("phrase"), union.column("n_sum_sum")
        stays = pc.or_(pc.equal(pc.binary_length(phrase), 0),
                       pc.and_(union.column("local_max"), pc.greater_equal(f, support)))
        union = union.filter(stays)
        phrase = union.column("phrase").cast(pa.string())
        blanks = pc.count_substring(phrase, " ")
        words = pc.if_else(pc.equal(pc.binary_length(phrase), 0), 0, pc.add(blanks, 1))
        return pa.table({"lang": union.column("lang").cast(pa.string()), "phrase": phrase,
                         "words": words.cast(pa.int32()), "f": union.column("n_sum_sum").cast(pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(work, _COUNTED)


def frequent(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT,
             longest: int = MAX_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, f) of every phrase of 1 to ``longest`` words with
    f >= ``support``, and (lang, n), the word occurrences of every language."""
    size = F.octet_length(F.col(f"`{text}`").cast("string"))
    sizes = {r["shard"]: r["b"] or 0 for r in  # one row per shard
             docs.select((F.spark_partition_id() % shards).alias("shard"), size.alias("b"))
             .groupBy("shard").agg(F.sum("b").alias("b")).collect()}
    total = sum(sizes.values())
    least = [local_support(support, sizes.get(i, 0) / total if total else 1 / shards) for i in range(shards)]
    buckets = max(1, -(-total // BUCKET_BYTES))
    counted = kept(spark, _mined(_dealt(docs, lang, text, buckets, shards, longest), least, support), "phrases")
    totals = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return counted.where("words > 0"), totals


def _words(phrase: str) -> Column:
    return F.split(F.col(phrase), " ")


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits (counts below 10^15)."""
    a, left, right = (f"cast({c} AS decimal(16,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * cast(1000000 AS decimal(7,0))) div ({left} * {right})")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): the lowest-scoring cut of every phrase of two or more words."""
    cuts = phrases.where("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), _words("phrase").alias("w"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("first"),
                       _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    first = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    best = F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r"))
    return (both.groupBy("lang", "phrase", "words", "a").agg(best.alias("b"))
            .select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score"))


def contained(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """(lang, phrase) of two or more words that lie in a longer phrase with
    100 f(longer) >= ``percent`` f(phrase)."""
    longer = phrases.where("words > 2").select("lang", F.col("f").alias("over"), "words", _words("phrase").alias("w"))
    longer = longer.select("lang", "over", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    parts = longer.select("lang", "over", "k", "w",
                          F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
    parts = parts.select("lang", _joined(F.col("w"), F.col("at"), F.col("k")).alias("phrase"), "over")
    most = parts.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return (phrases.join(most, ["lang", "phrase"])
            .where(F.col("over").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent)
            .select("lang", "phrase"))


def collocations(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT,
                 longest: int = MAX_WORDS, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language."""
    phrases, totals = frequent(spark, docs, lang, text, support, longest)
    left = scored(phrases).join(contained(phrases, percent), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of every part of a language, then of the language: at most PARTS * top rows meet in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = left.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              "n", "score")
