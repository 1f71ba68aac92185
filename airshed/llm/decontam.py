"""Benchmark decontamination (operator 7): prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words, but not none, is one window), every window into shingles
of ``shingle`` words.  A window of m shingles occurs in a document where an
equally long run of words holds at least ``ceil(threshold * m)`` of them.

1. Count in how many documents each benchmark shingle occurs (all documents,
   added up inside each task before the shuffle).
2. Order each window's shingles by rarity and keep its necessary prefix: the
   ``m - ceil(threshold * m) + 1`` rarest.  A window can only occur where one
   of them does.
3. Probe the documents with the prefix shingles.  The length bound asks that
   the run fits the document; the positional bound asks that the shingle lies
   at most ``m - ceil(threshold * m)`` places off (that many shingles may be
   missing, in an order-keeping match).
4. Verify containment over the item-sized run, and whether its words equal
   the window's.

Items are cut into windows in Spark; repeated (item, window) rows are dropped,
the rest counted and dealt by hash to blocks of about ``block_windows`` rows, so a
long item, or a window of many items, is spread over blocks.  A block (never
the whole benchmark) passes the driver and is broadcast, so memory is bounded
at any benchmark size; documents are only mapped, never shuffled, and no text leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.llm.tables import kept
from airshed.llm.words import alnum_bytes, alnum_words, mix

WINDOW = 10
SHINGLE = 5
BLOCK_WINDOWS = 1_000_000
_CUT = b" \x00 "  # between documents of a batch: alnum_bytes() leaves no NUL


@dataclass
class Block:
    """Windows of some items, by length, with word numbers from 1."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)   # length -> (n, length) word numbers
    items: dict[int, list[list[int]]] = field(default_factory=dict)  # length -> item numbers per window
    item_ids: list[str | None] = field(default_factory=list)
    shingle: int = SHINGLE
    threshold: float = 1.0
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def cut_items(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (id, words): the windows of every item, words joined by spaces; wordless texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column("id").to_pylist(), _texts(b), strict=True):
                words = [w.decode() for w in alnum_words(t)]
                size = min(window, len(words))
                last = len(words) - size + 1 if words else 0
                for at in range(0, last, 10_000):
                    found = [" ".join(words[i:i + size]) for i in range(at, min(at + 10_000, last))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()),
                                                      pa.array(found, pa.string())], names=["id", "words"])

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, "id string, words string").distinct()


def build_block(rows: list[tuple[str | None, str]], shingle: int, threshold: float) -> Block:
    """Block of distinct (item id, words of a window) rows."""
    block = Block(shingle=shingle, threshold=threshold)
    found: dict[int, dict[tuple, list[int]]] = {}
    numbers: dict[str | None, int] = {}
    for item_id, words in rows:
        ids = tuple(block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words.encode().split(b" "))
        found.setdefault(len(ids), {}).setdefault(ids, []).append(numbers.setdefault(item_id, len(numbers)))
    block.item_ids = list(numbers)
    for size, windows in found.items():
        block.windows[size] = np.array(list(windows), np.uint64).reshape(len(windows), size)
        block.items[size] = list(windows.values())
    return block


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """Code of the k word numbers from each place on (last axis), mixed in order."""
    n = ids.shape[-1] - k + 1
    out = np.zeros((*ids.shape[:-1], n), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[..., j:j + n])
    return out


def _flatten(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a batch (0: no benchmark word), and where each document begins and ends."""
    words = _CUT.join(map(alnum_bytes, texts)).split()
    get = vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    cuts = np.array([i for i in np.flatnonzero(ids == 0) if words[i] == b"\x00"], np.int64) if len(texts) > 1 \
        else np.zeros(0, np.int64)
    return ids.astype(np.uint64), np.r_[0, cuts + 1], np.r_[cuts, len(words)]


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Places from which k benchmark words follow each other (never across documents)."""
    gaps = np.r_[0, np.cumsum(ids == 0)]
    return np.flatnonzero(gaps[k:] == gaps[:-k]) if len(ids) >= k else np.zeros(0, np.int64)


def _codes_at(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[at + j])
    return out


def _by_shingle_size(block: Block) -> dict[int, list[int]]:
    sizes: dict[int, list[int]] = {}
    for size in block.windows:
        sizes.setdefault(min(block.shingle, size), []).append(size)
    return sizes


def _known(block: Block) -> dict[int, np.ndarray]:
    """Sorted distinct shingle codes of the block by shingle size."""
    return {k: np.unique(np.concatenate([_codes(block.windows[s], k).ravel() for s in sizes]))
            for k, sizes in _by_shingle_size(block).items()}


def _lookup(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are known, and their places in ``known``."""
    at = np.searchsorted(known, codes)
    at[at == len(known)] = 0
    return known[at] == codes, at


def document_frequency(spark: SparkSession, docs: DataFrame, block: Broadcast, text: str) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs (over all documents).

    One row per shingle and task is shuffled; one per shingle of the block
    comes back, which the block size bounds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(block.value)
        counts = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for b in batches:
            ids, starts, _ = _flatten(_texts(b), block.value.vocabulary)
            for k, codes in known.items():
                at = _runs(ids, k)
                hit, place = _lookup(codes, _codes_at(ids, at, k))
                doc = np.searchsorted(starts, at[hit], side="right").astype(np.int64)
                once = np.unique(doc * len(codes) + place[hit]) % len(codes)
                counts[k] += np.bincount(once, minlength=len(codes))
        for k, n in counts.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()),
                                                  pa.array(n[at], pa.int64())], names=["k", "place", "n"])

    known = _known(block.value)
    out = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
    part = docs.select(docs[f"`{text}`"].alias("__text")).mapInArrow(run, "k int, place int, n long")
    for r in part.groupBy("k", "place").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["place"]] = r["n"]
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("__text").cast(pa.binary()).to_pylist()]


def set_prefixes(block: Block, frequency: dict[int, np.ndarray]) -> None:
    """Per window length: (shingle code, window, offset) of every necessary prefix shingle, sorted by code."""
    known = _known(block)
    for size, windows in block.windows.items():
        k = min(block.shingle, size)
        codes = _codes(windows, k)
        m = codes.shape[1]
        rank = frequency[k][np.searchsorted(known[k], codes)]
        length = m - math.ceil(block.threshold * m) + 1
        # rarest first; ties by code, so that a shingle has one place in every window's order
        rarest = np.lexsort((codes, rank), axis=1)[:, :length]
        window = np.repeat(np.arange(len(windows)), length)
        offset = rarest.ravel()
        code = codes[window, offset]
        order = np.argsort(code, kind="stable")
        block.prefix[size] = (code[order], window[order], offset[order])


def probe(block: Block, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Occurrences (length, window, first word, contained share, equal words) in a flattened batch."""
    for size, (codes, window, offset) in block.prefix.items():
        k = min(block.shingle, size)
        m = size - k + 1
        need = math.ceil(block.threshold * m)
        at = _runs(ids, k)
        here = _codes_at(ids, at, k)
        first, last = np.searchsorted(codes, here), np.searchsorted(codes, here, side="right")
        n = last - first
        if not n.sum():
            continue
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        row = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(at, n)
        doc = np.searchsorted(starts, place, side="right") - 1
        slack = m - need
        for shift in range(-slack, slack + 1):  # positional bound
            begin = place - offset[row] + shift
            fits = (begin >= starts[doc]) & (begin + size <= ends[doc]) & (begin <= place) & (begin + size >= place + k)
            pair = np.unique(np.stack([begin[fits], window[row][fits]]), axis=1)
            b, w = pair
            if not len(b):
                continue
            own = block.windows[size][w]
            there = ids[b[:, None] + np.arange(size)]
            a, c = _codes(own, k), _codes(there, k)
            fresh = np.ones(a.shape, bool)
            for j in range(1, m):  # shingles are a set: count each once
                fresh[:, j] = (a[:, j:j + 1] != a[:, :j]).all(axis=1)
            shared = ((a[:, :, None] == c[:, None, :]).any(axis=2) & fresh).sum(axis=1)
            share = shared / fresh.sum(axis=1)
            for i in np.flatnonzero(share >= block.threshold):
                yield size, int(w[i]), int(b[i]), float(share[i]), bool((own[i] == there[i]).all())


SPANS = "array<struct<start:int,length:int,share:double,equal:boolean>>"


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, threshold: float = 1.0,
         exact: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, spans (runs of words that hold a benchmark window) and items (their ids, sorted).

    ``exact`` keeps only runs whose words equal the window's.  Defined
    results: null and wordless texts have no words, spans or items; an item
    without words is never found; an item without an id marks words but is
    not listed; repeated documents are each searched; columns of ``docs``
    named n_words, spans or items are replaced.
    """
    windows = kept(spark, cut_items(items, item_id, item_text, window), "windows")
    blocks = max(1, math.ceil(windows.count() / block_windows))
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for i in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == i)
        block = build_block([(r["id"], r["words"]) for r in own.collect()], shingle, threshold)
        sent = spark.sparkContext.broadcast(block)
        set_prefixes(block, document_frequency(spark, docs, sent, text))
        sent.unpersist()
        out = _search(out, spark.sparkContext.broadcast(block), text, exact)
    # a window of several items may be in several blocks
    return out.withColumn("spans", F.array_distinct("spans")) if blocks > 1 else out


def _search(docs: DataFrame, block: Broadcast, text: str, exact: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = _flatten(_texts(b.append_column("__text", b.column(text))), block.value.vocabulary)
            spans = b.column("spans").to_pylist()
            items = [set(x) for x in b.column("items").to_pylist()]
            for size, w, at, share, equal in probe(block.value, ids, starts, ends):
                if equal or not exact:
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    spans[doc].append({"start": at - int(starts[doc]), "length": size, "share": share, "equal": equal})
                    items[doc].update(block.value.item_ids[n] for n in block.value.items[size][w])
            arrays = dict(zip(b.schema.names, b.columns, strict=True))
            arrays["n_words"] = pa.array(ends - starts, pa.int64())
            arrays["spans"] = pa.array(spans, b.schema.field("spans").type)
            arrays["items"] = pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def covered_words(spans: str = "spans"):
    """How many words lie in any span (spans may overlap)."""
    s = F.array_sort(F.col(spans))
    merged = F.aggregate(
        s, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"])))
            .cast("long").alias("n")),
        lambda acc: acc["n"])
    return merged
