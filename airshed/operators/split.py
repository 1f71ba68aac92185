"""M1 / M2: deterministic train/test split and k-fold assignment.

Both are functions of each row's key (city, time), never of the physical
layout, so a re-run, a lost executor or another partitioning gives the same
split.  ``randomSplit`` is not used: its result depends on partitioning.

Two modes:

* hash mode -- a row is in the test part when the first 32 bits of
  ``md5(key | seed)`` fall below ``test_size * 2^32``.  A pure projection: no
  shuffle, no driver round trip; the test size is ~``test_size * n``.
* exact mode (the default) -- the test part is exactly ``ceil(test_size * n)``
  rows: the smallest keys in md5 order.  :func:`cut_keys` finds the key at
  that position by counting key prefixes (no sort, no row moves); a row is in
  the test part when its key is smaller, a pure projection.  Folds use the
  keys at the ``ntile`` boundaries, so sizes differ by at most one, larger
  folds first.

Rows that share (city, time) are told apart by a hash of their whole content;
fully identical rows are one key and stay on the same side of every cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("city", "time")


def key_hash(seed: int | str, tag: str | None = None, key=KEY) -> Column:
    """Hex md5 of ``city|time|seed[|tag]`` (built-in md5, JVM side)."""
    parts: list[Column] = []
    for i, c in enumerate(key):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    parts += [F.lit("|"), F.lit(str(seed))]
    if tag:
        parts += [F.lit("|"), F.lit(tag)]
    return F.md5(F.concat(*parts))


DIGITS = 4            # hex digits counted per step: at most 65,536 counts reach the driver
SMALL = 1000          # a prefix with at most this many distinct keys is looked into


def row_key(df: DataFrame, h: Column) -> Column:
    """48 hex digits: the md5 of the key, then the hash of the whole row."""
    return F.concat(h, F.lpad(F.lower(F.hex(F.xxhash64(*df.columns))), 16, "0"))


def cut_keys(df: DataFrame, h: Column, cuts: Callable[[int], list[int]]) -> tuple[list[str | None], int]:
    """Keys at the 0-based positions ``cuts(n)`` of the ``n`` rows in key order.

    A row is before position r when its key is smaller than the r-th key
    (None: r is beyond the last row).  Counts per prefix find the prefix that
    holds each position; only rows with that prefix are looked at in the next
    step, until few keys are left.  Each step is a partial aggregation with a
    bounded result, whatever the number of rows or of rows per key.  ``df`` is
    read a few times: its columns must come out equal each time (sums of
    doubles may not; write such a table first).
    """
    def counted(rows: DataFrame, prefix: Column) -> list[tuple[str, int]]:
        got = rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["p"], r["n"]) for r in got)

    first = counted(df, F.substring(h, 1, DIGITS))
    total = sum(n for _, n in first)
    found: dict[int, str | None] = {}
    # open positions: (rank, prefix holding it, position inside the prefix)
    open_: list[tuple[int, str, int]] = []

    def place(rank: int, inside: int, counts: list[tuple[str, int]]) -> None:
        for p, n in counts:
            if inside < n:
                open_.append((rank, p, inside))
                return
            inside -= n

    ranks = cuts(total)
    for r in ranks:
        if r >= total:
            found[r] = None
        else:
            place(r, r, first)
    sizes = dict(first)
    while open_:
        waiting, open_ = open_, []
        prefixes = sorted({p for _, p, _ in waiting})
        length = len(prefixes[0])
        rows = df.where(F.substring(row_key(df, h), 1, length).isin(*prefixes))
        few = all(sizes[p] <= SMALL for p in prefixes)
        step = 48 if few else min(48, length + DIGITS)
        counts = counted(rows, F.substring(row_key(df, h), 1, step))
        sizes = dict(counts)
        for r, p, inside in waiting:
            place(r, inside, [(q, n) for q, n in counts if q.startswith(p)])
        if step == 48:
            found.update({r: p for r, p, _ in open_})
            open_ = []
    return [found[r] for r in ranks], total


def hash_threshold(fraction: float) -> str:
    v = min(max(int(math.floor(fraction * 2 ** 32)), 0), 2 ** 32 - 1)
    return format(v, "08x")


def split_hash(df: DataFrame, test_size: float = 0.2, seed: int = 42,
               flag: str = "is_test") -> DataFrame:
    """M1, hash mode: ``flag`` is true for ~``test_size`` of the rows."""
    h = F.substring(key_hash(seed), 1, 8)
    return df.withColumn(flag, h < F.lit(hash_threshold(test_size)))


def n_test_rows(n: int, test_size: float) -> int:
    return int(math.ceil(test_size * n))


def split_exact(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                flag: str = "is_test") -> DataFrame:
    """M1, exact mode: exactly ``ceil(test_size * n)`` test rows."""
    h = key_hash(seed)
    (cut,), _ = cut_keys(df, h, lambda n: [n_test_rows(n, test_size)])
    return df.withColumn(flag, F.lit(True) if cut is None else row_key(df, h) < F.lit(cut))


def fold_starts(n: int, k: int) -> list[int]:
    """0-based positions at which folds 2..k begin, as ``ntile(k)`` cuts n rows."""
    q, rem = divmod(n, k)
    return [f * q + min(f, rem) for f in range(1, k)]


def assign_folds(df: DataFrame, n_folds: int = 5, seed: int = 42,
                 exact: bool = True, fold_col: str = "fold") -> DataFrame:
    """M2: fold 1..k per row.  Exact: sizes differ by at most one, larger
    folds first.  Hash mode: ``pmod`` of the key hash (no shuffle)."""
    h = key_hash(seed, "cv")
    if not exact:
        v = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
        return df.withColumn(fold_col, (F.pmod(v, F.lit(n_folds)) + 1).cast("int"))
    keys, _ = cut_keys(df, h, lambda n: fold_starts(n, n_folds))
    fold = F.lit(1)
    for key in keys:
        if key is not None:
            fold = fold + (row_key(df, h) >= F.lit(key)).cast("int")
    return df.withColumn(fold_col, fold)
