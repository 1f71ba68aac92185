"""Near-duplicate classes by Order MinHash (operator 10).

Documents are sequences of ``K``-word k-mers labelled with their occurrence
(the second time a k-mer occurs it is another element).  Per band, a random
order of the labelled k-mers picks the ``PICKS`` smallest; their codes *in text
order* make the band's sketch.  Two documents share a band's sketch only if
they agree on those k-mers and on their order, so sketches follow edit
similarity, not just the bag of k-mers.

Candidates are verified by a banded alignment of the labelled k-mers: the
longest chain that keeps the order of both texts, within the band of shifts
that the threshold allows.  Similarity is chain / (n1 + n2 - chain); it never
exceeds the Jaccard similarity of the two sets, and texts are linked at
``threshold`` (0.8) or more.

Classes are the connected components of the links.  Equal texts are one node
first, and each sketch links its members to one leader, the member that shares
most sketches with others (of a family of copies, the one nearest their common
original).  Members that miss their leader and are in no common class with it
form the bucket of the next round, with the next leader, until a round merges
no classes.

Leaders only gather the large classes cheaply; they decide no pair.  All
members of every bucket that then holds two classes or more are joined exactly:
texts of similarity ``threshold`` share a labelled k-mer among the first few of
each, rarest first (prefix filter with length bounds), and every such pair of
two classes is aligned.  Pairs within one class are never listed.

With 20 bands of 5 picks, two long texts of similarity 0.8 share a sketch with
probability 1 - (1 - 0.8^5)^20 = 0.9996; picks are drawn without replacement,
so shorter texts share one less often (24 of 30 k-mers in common: 0.9992).
Every text with a k-mer has its sketches.  Texts of up to ``FEW`` k-mers, for
which the sketches promise too little, and the longer texts that they can link
to, meet also by the k-mers that come first in one fixed random order, as many
as hold a common one for certain (prefix filter).

Defined results: rows with equal texts are of one class, empty texts included;
a null text is a class of its own row's id; texts without words have no
k-mers and only join equal texts; fewer than ``K`` words are one k-mer; rows
that repeat an id are one document (their texts share a class); a null id has
a null class.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.components import components, merged
from airshed.llm.tables import kept
from airshed.llm.words import alnum_words, kmer_codes, mix, occurrence, word_codes

K = 5
BANDS = 20
PICKS = 5
THRESHOLD = 0.8
FEW = 20  # k-mers up to which a prefix filter backs the sketches
_CELLS = 1 << 20  # band x k-mer cells held at once
_COUNTERS = 1 << 20  # cells in which k-mers are counted to order them by rarity


def labelled_kmers(text: bytes, k: int = K) -> np.ndarray:
    """Codes of the occurrence-labelled k-mers, in text order."""
    codes = kmer_codes(word_codes(alnum_words(text)), k)
    return mix(codes ^ mix(occurrence(codes) + np.uint64(1)))


def sketches(kmers: np.ndarray, bands: int = BANDS, picks: int = PICKS) -> np.ndarray:
    """One code per band; none for a text without k-mers."""
    n = len(kmers)
    if not n:
        return np.zeros(0, np.int64)
    picks = min(picks, n)
    out = np.zeros(bands, np.uint64)
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = max(1, _CELLS // n)
    for a in range(0, bands, step):
        own = seeds[a:a + step]
        order = mix(kmers[None, :] ^ own[:, None])
        least = np.argpartition(order, picks - 1, axis=1)[:, :picks] if picks < n else \
            np.tile(np.arange(n), (len(own), 1))
        chosen = kmers[np.sort(least, axis=1)]  # text order
        code = own.copy()
        for j in range(picks):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
        out[a:a + step] = code
    return out.view(np.int64)


def prefix_size(n: int, threshold: float = THRESHOLD) -> int:
    """In any order of the k-mers, linked texts share one among the first ``prefix_size`` of each."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def bucket_keys(kmers: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Buckets of a text: its sketches; where these can miss short texts, also its first k-mers in a fixed random order."""
    n = len(kmers)
    keys = sketches(kmers)
    if n and threshold * n <= FEW + 1e-9:  # short itself, or near to a short one
        order = np.sort(mix(kmers ^ np.uint64(0xD1B54A32D192ED03)))
        keys = np.r_[keys, order[:prefix_size(n, threshold)].view(np.int64)]
    return keys


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned share of two labelled k-mer sequences; 0 if it can't reach the threshold."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    need = threshold / (1 + threshold) * both - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    common, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < need:
        return 0.0
    order = np.argsort(at)
    at, to = at[order], to[order]
    band = both - 2 * need  # k-mers left over, and so the largest shift
    to = to[np.abs(at - to) <= band]
    chain = len(to)
    if chain and (np.diff(to) < 0).any():
        tails: list[int] = []
        for x in to.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        chain = len(tails)
    return chain / (both - chain) if chain >= need else 0.0


def _sketched(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(id, h1, h2, keys) per document: id, 128-bit code of the text, buckets."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                      F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("h1"),
                      F.conv(F.substring(F.md5(F.col(f"`{text}`").cast("binary")), 1, 15), 16, 10).cast("long")
                      .alias("h2"),
                      F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [bucket_keys(labelled_kmers(t.as_py()), threshold) for t in b.column("t").cast(pa.binary())]
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h1"), b.column("h2"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                names=["id", "h1", "h2", "keys"])

    return src.mapInArrow(run, "id long, h1 long, h2 long, keys array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts align at the threshold or more."""
    sides = (pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
             .join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
             .select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kmers = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            rows = []
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                if b != last:  # a leader's pairs mostly follow each other
                    last, kmers = b, labelled_kmers(tb[i].as_py())
                if similarity(labelled_kmers(ta[i].as_py()), kmers, threshold) >= threshold:
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def least_common(n1, n2, threshold: float = THRESHOLD):
    """K-mers that two texts of ``n1`` and ``n2`` k-mers share at least, if they are linked."""
    return threshold / (1 + threshold) * (n1 + n2) - 1e-9


def _prefixes(spark: SparkSession, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, own, n, place, kmer): the rarest k-mers of every text (node, own, t), as many as a link can need.

    K-mers are counted in a fixed number of cells; cells that several share only make the order less even.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_COUNTERS, np.int64)
        for b in batches:
            for t in b.column("t").cast(pa.binary()):
                np.add.at(n, (labelled_kmers(t.as_py()) % np.uint64(_COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["cell", "n"])

    cells = texts.select("t").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_COUNTERS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            size, place, kmer = [], [], []
            for t in b.column("t").cast(pa.binary()):
                kmers = labelled_kmers(t.as_py())
                n = len(kmers)
                m = prefix_size(n, threshold) if n else 0
                order = np.lexsort((kmers, counts[(kmers % np.uint64(_COUNTERS)).astype(np.int64)]))[:m]
                size.append((n, m))
                place.append(np.arange(m))
                kmer.append(kmers[order])
            if not size:
                continue
            rows = np.repeat(np.arange(len(size)), [m for _, m in size])
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(rows)), b.column("own").take(pa.array(rows)),
                 pa.array(np.array([n for n, _ in size], np.int64)[rows]), pa.array(np.concatenate(place), pa.int64()),
                 pa.array(np.concatenate(kmer).astype(np.uint64).view(np.int64))],
                names=["node", "own", "n", "place", "kmer"])

    return texts.select("node", "own", "t").mapInArrow(run, "node long, own long, n long, place long, kmer long")


def _across(spark: SparkSession, buckets: DataFrame, label: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of two classes that can reach the threshold, among the members of buckets with several classes."""
    owned = (buckets.select("key", "node").join(label.select("node", F.col("label").alias("own")), "node", "left")
             .select("key", "node", F.coalesce("own", "node").alias("own")))
    mixed = owned.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("key")
    nodes = owned.join(mixed, "key", "left_semi").select("node", "own").distinct()
    left = kept(spark, texts.join(nodes, texts["id"] == nodes["node"]).select("node", "own", "t"), "rest")
    first = _prefixes(spark, left, threshold)
    # by k-mer and class, so that pairs of one class are never formed
    groups = first.groupBy("kmer", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                              F.min("place").alias("at"))
    several = groups.groupBy("kmer").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("kmer")
    groups = kept(spark, groups.join(several, "kmer", "left_semi"), "groups")
    first = kept(spark, first.join(several, "kmer", "left_semi"), "prefixes")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("kmer", *[F.col(c).alias(c + tag) for c in df.columns if c != "kmer"])

    def room(n1: str, n2: str):
        # k-mers of the first text that the second may lack
        return F.col(n1) - least_common(F.col(n1), F.col(n2), threshold)

    meet = (side(groups, "1").join(side(groups, "2"), "kmer").where("own1 < own2")
            .where((F.col("at1") <= room("hi1", "lo2")) & (F.col("at2") <= room("hi2", "lo1")))
            .select("kmer", "own1", "own2", "lo2", "hi2", "at2"))
    # members that no length and place in the other class can reach go before they are paired
    near = (meet.join(side(first, "1"), ["kmer", "own1"])
            .where((F.col("place1") <= room("n1", "lo2")) & (F.col("at2") <= room("hi2", "n1"))))
    both = (near.join(side(first, "2"), ["kmer", "own2"])
            .where((F.col("place1") <= room("n1", "n2")) & (F.col("place2") <= room("n2", "n1"))))
    return both.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def classes(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(id, class, copy_of): the class (smallest id in it) of every row's id, and the id whose text is equal.

    One row per distinct id; see the module's rules for nulls and repeated ids.
    """
    sk = kept(spark, _sketched(docs, doc_id, text, threshold), "sketches")
    # equal texts: one node each, the smallest id
    first = kept(spark, sk.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select("h1", "h2", "node"), "equal")  # a table, so that adaptive execution splits the join
    member = kept(spark, sk.join(first, ["h1", "h2"], "left")
                  .select("id", F.coalesce("node", "id").alias("node"), "keys"), "members")
    nodes = member.where("id = node").select("node", F.explode("keys").alias("key")).distinct()
    count = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = kept(spark, nodes.join(count, "key").select("key", "node", "n"), "buckets")
    # how many others a node meets over all bands: the heart of a family has most
    weight = open_.groupBy("node").agg(F.sum("n").alias("w"))
    open_ = kept(spark, open_.join(weight, "node").select("key", "node", "w"), "buckets")

    buckets = open_
    equal = member.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    label: DataFrame | None = None
    texts: DataFrame | None = None
    while not open_.isEmpty():
        # the heaviest member leads (ties: the smallest id)
        lead = open_.groupBy("key").agg(F.max(F.struct("w", -F.col("node"))).alias("m")) \
            .select("key", (-F.col("m.col2")).alias("lead"))
        led = kept(spark, open_.join(lead, "key").where("node <> lead"), "led")
        pairs = led.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        if texts is None:  # only texts that meet others travel on; sorted by id at any size
            wanted = open_.select(F.col("node").alias("id")).distinct()
            texts = kept(spark, docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
                         .where("t is not null").join(wanted.hint("merge"), "id", "left_semi")
                         .groupBy("id").agg(F.min("t").alias("t")), "texts")
        found = kept(spark, _verify(pairs, texts, threshold), "found")
        if label is None:
            label = kept(spark, components(spark, equal.union(found)), "classes")
        else:
            following = merged(spark, label, found)
            if following is None:
                break
            label = following
        # who is not yet in the leader's class goes on
        left = (led.join(label.select(F.col("node"), F.col("label").alias("own")), "node", "left")
                .join(label.select(F.col("node").alias("lead"), F.col("label").alias("its")), "lead", "left")
                .where(~F.coalesce("own", "node").eqNullSafe(F.coalesce("its", "lead"))).select("key", "node", "w"))
        several = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        open_ = kept(spark, left.join(several, "key", "left_semi"), "buckets")
    if label is None:
        label = components(spark, equal)
    else:
        found = kept(spark, _verify(_across(spark, buckets, label, texts, threshold), texts, threshold), "found")
        label = merged(spark, label, found) or label
    out = (member.select("id", "node").alias("m")
           .join(label.alias("l"), F.col("m.id") == F.col("l.node"), "left")
           .select("m.id", F.coalesce("l.label", "m.id").alias("class"), F.col("m.node").alias("copy_of")))
    rest = docs.where(F.col(f"`{text}`").isNull() & F.col(f"`{doc_id}`").isNotNull()) \
        .select(F.col(f"`{doc_id}`").cast("long").alias("id"))
    rest = rest.select("id", F.col("id").alias("class"), F.col("id").alias("copy_of"))
    return out.union(rest).groupBy("id").agg(F.min("class").alias("class"), F.min("copy_of").alias("copy_of"))


def keep_first(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays: the one with the smallest id (rows without an id all stay)."""
    gone = classes(spark, docs, doc_id, text, threshold).where("id <> class").select("id").distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["id"], "left_anti")
