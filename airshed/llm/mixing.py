"""Mixing sources to target weights (operator 1).

Sizes are words.  Each source gets a target; a multivariate-hypergeometric
splitting tree deals its exact quota of blocks to the output shards.

1. Every document has a place: a 64-bit hash of its id and text.  A source of
   size s is cut into about ``blocks * s / total`` blocks by place, so all
   blocks of all sources hold about equally many words.
2. A source's blocks are permuted.  The mix takes whole epochs (all blocks),
   then the first blocks of one more epoch up to the target, the last of them
   up to a place (the cut-off).  Documents left over then fill the gap in
   passes: each takes, of those no larger than the gap, the first blocks and
   places that fit, until none is small enough.  One more document may go
   beyond the target if that brings the words closer to it.
3. The splitting tree halves the shard range again and again; at each node
   the left half draws its blocks from the node's quotas without replacement.
   Its leaves say how many blocks of each source a shard has; a source's draws
   are handed out in order, so shards are disjoint.
4. Rows find their epochs and shards by arithmetic on (place, one row per
   source): no row-level shuffle.  Shards are then shuffled locally.

Only one row per source and the block sums (at most ``blocks`` + number of
sources) reach the driver.  Every run with the same input and seed agrees.

Defined results: a null text has size 0; a null source is a source of its
own, after all others; rows that repeat (same id and text) share their place
and are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.quality import GAPS
from airshed.llm.tables import kept

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCKS = 8192
SHARDS = 16


def word_count(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(F.length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], epochs: float = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight; none above ``epochs`` times its size, the excess reshared by weight."""
    out: list[float] = [0.0] * len(sizes)
    open_, rest = set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > epochs * sizes[i]}
        for i in over or open_:
            out[i] = float(epochs * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts; columns add up to ``quotas``, rows differ by one block at most."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = total * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals")
    return np.vstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


@dataclass(frozen=True)
class Names:
    doc_id: str = "doc_id"
    text: str = "text"
    source: str = "source"


def _with_place(docs: DataFrame, n: Names, seed: int) -> DataFrame:
    """Size in words and place in [0, 2^62) of every row."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{n.doc_id}`"), F.col(f"`{n.text}`")), 2)
    return docs.withColumns({"__size": word_count(F.col(f"`{n.text}`")), "__place": place})


def _block(blocks: Column) -> Column:
    """Block of a place: the high 31 bits scaled to the number of blocks."""
    return F.shiftright(F.shiftright(F.col("__place"), 31) * blocks.cast("long"), 31)


def _rank() -> Column:
    """Rank of a row's block in its source's permutation."""
    return (_block(F.col("__blocks")) * F.col("__step")) % F.col("__blocks")


def _once_more() -> Column:
    """Is the row in the whole blocks of the last epoch, or before the cut-off of the next one?"""
    return (_rank() < F.col("__whole")) | ((_rank() == F.col("__whole")) & (F.col("__place") <= F.col("__cut")))


def _same_source(n: Names) -> Column:
    return F.col(f"d.`{n.source}`").eqNullSafe(F.col("s.__source"))


def _join_sources(rows: DataFrame, sources: DataFrame, n: Names) -> DataFrame:
    # a table of literals, one row per source: the planner knows its size and broadcasts it if it is small
    return rows.alias("d").join(sources.alias("s"), _same_source(n))


def _filled() -> Column:
    """Is the row taken by one of the passes that fill the gap?"""
    return F.exists("__passes", lambda p: (F.col("__size") <= p["limit"]) & (
        (_rank() < p["whole"]) | ((_rank() == p["whole"]) & (F.col("__place") <= p["cut"]))))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, shards: int = SHARDS, blocks: int = BLOCKS,
        epochs: int = MAX_EPOCHS, seed: int = 1, names: Names = Names()) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies, taken and shards (one per copy).

    ``weights`` go to the sources in code-point order (null last), repeated.
    Columns of ``docs`` with these names are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken", "shards")
    docs = docs.drop(*made)
    rows = _with_place(docs, names, seed)
    narrow = kept(spark, rows.select(F.col(f"`{names.source}`"), "__size", "__place"), "mix-sizes")
    # equal places (repeated rows) are added up before the shuffle
    totals = [(r[0], r[1]) for r in narrow.groupBy(f"`{names.source}`").agg(F.sum("__size")).collect()]
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(s or 0) for _, s in totals]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epochs)
    total = sum(sizes)
    count = [max(1, math.ceil(blocks * s / total)) if total else 1 for s in sizes]
    rng = np.random.default_rng(seed)
    step = [next(a for a in (int(rng.integers(1, c + 1)) for _ in iter(int, 1)) if math.gcd(a, c) == 1) for c in count]

    source_type = docs.schema[names.source].dataType.simpleString()
    plan = spark.createDataFrame(
        [(s, c, a) for (s, _), c, a in zip(totals, count, step, strict=True)],
        f"__source {source_type}, __blocks long, __step long")
    ranked = _join_sources(narrow, plan, names).withColumn("__rank", _rank())
    number = {s: i for i, (s, _) in enumerate(totals)}
    words = [np.zeros(c, np.int64) for c in count]
    for r in ranked.groupBy("__source", "__rank").agg(F.sum("__size").alias("n")).collect():
        words[number[r["__source"]]][r["__rank"]] = r["n"]

    full, whole, rest = [], [], []
    for s, t, w in zip(sizes, want, words, strict=True):
        e = int(t // s) if s else 0
        left = max(0.0, t - e * s)
        sums = np.cumsum(w)
        m = int(np.searchsorted(sums, left, side="right")) if left else 0  # blocks taken whole in the last epoch
        full.append(e)
        whole.append(m)
        rest.append(left - (int(sums[m - 1]) if m else 0) if m < len(w) else 0.0)

    # the last block: up to the place where the rest is used up (ties are one place)
    bounds = spark.createDataFrame(
        [(s, c, a, m, float(r)) for (s, _), c, a, m, r in zip(totals, count, step, whole, rest, strict=True)],
        f"__source {source_type}, __blocks long, __step long, __whole long, __rest double")
    edge = (_join_sources(narrow, bounds, names)
            .where(_rank() == F.col("__whole"))
            .groupBy("__source", "__place", "__rest").agg(F.sum("__size").alias("n")))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("__place")) - F.col("n")
    cut = {r["__source"]: (r["p"], r["n"]) for r in edge.withColumn("b", before).where("b + n <= __rest and __rest > 0")
           .groupBy("__source").agg(F.max("__place").alias("p"), F.sum("n").alias("n")).collect()}
    gap = {s: float(r - cut.get(s, (-1, 0))[1]) for (s, _), r in zip(totals, rest, strict=True)}
    passes: dict = {s: [] for s, _ in totals}
    extra: dict = {s: [] for s, _ in totals}
    last_epoch = {s: (c, a, m, cut.get(s, (-1, 0))[0]) for (s, _), c, a, m in zip(totals, count, step, whole, strict=True)}
    pass_type = "array<struct<limit:double,whole:long,cut:long>>"

    def left_over(open_: list) -> DataFrame:
        """Rows that nothing took yet, of the sources in ``open_``, with their source's gap."""
        missing = spark.createDataFrame(
            [(s, *last_epoch[s], passes[s], gap[s]) for s in open_], f"__source {source_type}, __blocks long, __step long, "
            f"__whole long, __cut long, __passes {pass_type}, __gap double")
        return _join_sources(narrow, missing, names).where(~_once_more() & ~_filled() & (F.col("__size") > 0))

    open_ = [s for s, _ in totals if gap[s] >= 1]
    while open_:
        fits = left_over(open_).where("__size <= __gap").withColumn("__rank", _rank())
        sums: dict = {}
        for r in fits.groupBy("__source", "__rank").agg(F.sum("__size").alias("n")).collect():  # blocks and sources
            sums.setdefault(r["__source"], []).append((r["__rank"], r["n"]))
        ends, limits = [], {s: gap[s] for s in open_}
        for s in open_:
            taken = 0
            for block, n in sorted(sums.get(s, [])):
                if taken + n > gap[s]:
                    ends.append((s, block, float(gap[s] - taken)))
                    break
                taken += n
            else:
                ends.append((s, count[number[s]], 0.0))   # all that is left fits
            gap[s] -= taken
        bounds = spark.createDataFrame(ends, f"__source {source_type}, __block long, __room double")
        inside = (fits.alias("f").join(bounds.alias("b"), F.col("f.__source").eqNullSafe(F.col("b.__source"))
                                       & (F.col("f.__rank") == F.col("b.__block")))
                  .groupBy("b.__source", "f.__place", "b.__room").agg(F.sum("f.__size").alias("n")))
        before = F.sum("n").over(Window.partitionBy("__source").orderBy("__place")) - F.col("n")
        tail = {r["__source"]: (r["p"], r["n"]) for r in inside.withColumn("b", before).where("b + n <= __room")
                .groupBy("__source").agg(F.max("__place").alias("p"), F.sum("n").alias("n")).collect()}
        went_on = []
        for s, block, room in ends:
            place, n = tail.get(s, (-1, 0))
            first = min((b for b, _ in sums.get(s, [])), default=None)
            passes[s].append((limits[s], block, place))
            gap[s] -= n
            if first is not None and (first < block or n) and block < count[number[s]] and gap[s] >= 1:
                went_on.append(s)
        open_ = went_on
    open_ = [s for s, _ in totals if gap[s] >= 1]
    if open_:  # one more, beyond the target, if that is nearer to it (repeated rows of a place count together)
        near = (left_over(open_).groupBy("__source", "__place", "__gap").agg(F.sum("__size").alias("n"))
                .where("n < 2 * __gap").groupBy("__source")
                .agg(F.min(F.struct(F.abs(F.col("n") - F.col("__gap")), "__place", "n")).alias("best"))).collect()
        for r in near:
            extra[r["__source"]].append(r["best"]["__place"])

    quotas = np.array([e * c + m + (s in cut) for (s, _), e, c, m in zip(totals, full, count, whole, strict=True)],
                      np.int64)
    dealt = np.cumsum(splitting_tree(quotas, shards, rng), axis=0) if len(quotas) else np.zeros((shards, 0), int)
    final = spark.createDataFrame(
        [(s, size, t, c, a, e, m, cut.get(s, (-1, 0))[0], passes[s], extra[s], [int(x) for x in dealt[:, i]])
         for i, ((s, _), size, t, c, a, e, m) in enumerate(
             zip(totals, sizes, want, count, step, full, whole, strict=True))],
        f"__source {source_type}, source_size long, target double, __blocks long, __step long, __full long, "
        f"__whole long, __cut long, __passes {pass_type}, __extra array<long>, __ends array<long>")
    keep = [F.col(f"d.`{c}`") for c in docs.columns]
    got = _join_sources(rows, final, names).select(
        *keep, F.col("__size").alias("size"), "source_size", "target", _rank().alias("__rank"), "__blocks", "__full",
        "__ends", "__place", _once_more().alias("__quota"),
        (_filled() | F.array_contains("__extra", F.col("__place"))).alias("__fill"))
    got = got.withColumn("copies", F.col("__full") + (F.col("__quota") | F.col("__fill")).cast("long"))
    # draw number of a copy: epoch * blocks + rank; its shard: how many shards end at or before it.
    # Documents that fill the gap lie outside the block quotas: their last copy goes to a shard by hash.
    shard = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(
            F.array().cast("array<long>")),
        lambda e: F.when((e == F.col("__full")) & ~F.col("__quota"), F.pmod(F.xxhash64("__place"), F.lit(shards)))
        .otherwise(F.least(F.size(F.filter("__ends", lambda x: x <= e * F.col("__blocks") + F.col("__rank"))),
                           F.lit(shards - 1))).cast("int"))
    return got.withColumns({"taken": F.col("copies") * F.col("size"), "shards": shard}).drop(
        "__rank", "__blocks", "__full", "__ends", "__place", "__quota", "__fill")


def deal(mixed: DataFrame, shards: int = SHARDS, seed: int = 1, names: Names = Names()) -> DataFrame:
    """One row per copy with its ``shard``, each shard in a random order of its own.

    A shard is cut into parts by a hash of (seed, shard, copy, document), about as
    many as the input has splits, so that a part stays as large as a split; a
    part lies in one partition, its rows in the order of that hash.
    """
    cols = [c for c in mixed.columns if c not in ("shards", "copies", "taken", "shard", "copy")]
    rows = mixed.select(*[F.col(f"`{c}`") for c in cols], F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed), "shard", "copy", F.col(f"`{names.doc_id}`"), F.col(f"`{names.text}`"))
    splits = mixed.rdd.getNumPartitions()
    parts = max(1, -(-splits // shards))
    rows = rows.withColumn("__order", order).withColumn("__part", F.pmod("__order", F.lit(parts)))
    return (rows.repartition(max(shards, splits), "shard", "__part").sortWithinPartitions("shard", "__part", "__order")
            .drop("__order", "__part"))
