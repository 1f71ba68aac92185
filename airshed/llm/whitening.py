"""Embedding whitening (operator 12), by spectrum slicing.

1. *Entries.*  Rows whose vector is null or holds null or non-finite entries are
   dropped; an entry c becomes the integer x = floor(64 c) + 1000000.  The
   *fit list* is every distinct x vector once, written as a table.
2. *Covariance.*  One aggregate takes n and the sums S; a second pass centres
   every vector by the integer nearest to S / n and adds up products per task,
   in integers; the remainder of the mean is taken off exactly, so the
   covariance (divisor n) is a rational number, rounded once.
3. *Spectrum slicing* on the driver, in the number of dimensions only: the
   inertia of V - s I, from its LDL' factors with Bunch-Kaufman pivots (1 x 1
   and 2 x 2), counts the eigenvalues above s.  Bisection on the counts isolates
   eigenvalue k; Rayleigh quotient iteration from inside that slice converges
   cubically; a quotient that leaves its slice sends the search back to
   bisection.  Eigenvalues that no shift separates are a cluster: their vectors
   are iterated orthogonally to the earlier ones.  Finally the counts on both
   sides of every eigenvalue certify its number.
4. *Projection.*  Every remaining row, and the fit list for the identity error,
   is multiplied in batches.

Defined results: repeated rows and ids are whitened alike, each on its own row;
vectors of another length than the most frequent one (ties: the longest) lie
in no common space and are dropped like null ones; empty vectors too.
Components without variance (eigenvalue below ``RANK`` times the largest) can't
be whitened and have no rows; an empty table gives no rows.  Entries beyond
2^40 are held there.  A deviation beyond 64 bits is null.  Other columns don't
matter and only the id is carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.llm.tables import kept

SCALE, OFFSET = 64, 1_000_000    # x = floor(SCALE * c) + OFFSET
HOLD = float(1 << 40)
COMPONENTS = 16
RANK = 1e-12
EPS = np.finfo(float).eps
_LONG = 2 ** 63 - 1


# ---------------------------------------------------------------- eigenvalues

def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix, from LDL' with Bunch-Kaufman pivots."""
    a = np.array(a, float)
    n, k, plus, minus = len(a), 0, 0, 0
    alpha = (1 + 17 ** 0.5) / 8
    while k < n:
        column = np.abs(a[k + 1:, k])
        two, swap = False, k
        if len(column) and column.max() > 0:
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(a[k, k]) < alpha * most:
                others = np.abs(a[k:, r])
                others[r - k] = 0
                sigma = others.max()
                if abs(a[k, k]) * sigma >= alpha * most * most:
                    pass
                elif abs(a[r, r]) >= alpha * sigma:
                    swap = r
                else:
                    two, swap = True, r
        at = k + 1 if two else k
        if swap != at:
            a[[at, swap], :] = a[[swap, at], :]
            a[:, [at, swap]] = a[:, [swap, at]]
        if two:  # an indefinite block: one eigenvalue of each sign
            block, low = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            plus, minus = plus + 1, minus + 1
            if len(low):
                a[k + 2:, k + 2:] -= low @ np.linalg.solve(block, low.T)
            k += 2
        else:
            d = a[k, k]
            plus, minus = plus + (d > 0), minus + (d < 0)
            if d and k + 1 < n:
                low = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(low / d, low)
            k += 1
    return int(plus), int(minus)


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues above ``s``."""
    return inertia(v - s * np.eye(len(v)))[0]


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray       # falling
    vectors: np.ndarray      # one column per component
    certified: bool          # the counts beside every eigenvalue agree with its number


def _rayleigh(v: np.ndarray, shift: float, against: np.ndarray, start: np.ndarray, norm: float):
    """(value, vector) that Rayleigh quotient iteration reaches, orthogonal to the columns of ``against``."""
    def clean(x):
        for _ in range(2):
            x = x - against @ (against.T @ x)
        size = np.linalg.norm(x)
        return x / size if size else None

    x, eye = clean(start), np.eye(len(v))
    if x is None:
        return None
    best = None
    for step in range(40):
        # the first steps keep the shift: inverse iteration towards the slice's eigenvalue
        s = shift if step < 3 else float(x @ v @ x)
        residual = np.linalg.norm(v @ x - (x @ v @ x) * x)
        if best is None or residual < best[0]:
            best = (residual, x)
        if step >= 4 and residual <= 4 * EPS * norm:
            break
        try:
            y = np.linalg.solve(v - s * eye, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (s + 2 * EPS * norm) * eye, x)
        if not np.all(np.isfinite(y)):
            break
        y = clean(y)
        if y is None:
            break
        x = y
    x = best[1]
    return float(x @ v @ x), x, best[0]


def leading(v: np.ndarray, count: int = COMPONENTS) -> Spectrum:
    """The leading eigenpairs with an eigenvalue above ``RANK`` times the bound of the largest."""
    n = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if n else 0.0   # bounds every eigenvalue
    if not norm:
        return Spectrum(np.zeros(0), np.zeros((n, 0)), True)
    count = min(count, n, above(v, RANK * norm))
    rnd = np.random.default_rng(0)
    known: dict[float, int] = {}

    def counted(s: float) -> int:
        if s not in known:
            known[s] = above(v, s)
        return known[s]

    tiny = 16 * n * EPS * norm
    values: list[float] = []
    vectors = np.zeros((n, 0))
    for k in range(1, count + 1):
        low, high = 0.0, norm * (1 + 1e-9)   # number k lies in (low, high]
        for s, c in known.items():
            if c >= k:
                low = max(low, s)
            else:
                high = min(high, s)
        while True:
            while not (counted(low) == k and counted(high) == k - 1) and high - low > tiny:
                middle = (low + high) / 2
                if counted(middle) >= k:
                    low = middle
                else:
                    high = middle
            # earlier vectors of the same cluster, or so near that the iteration could fall back on them
            near = [i for i, e in enumerate(values) if e - high <= 1e-3 * norm]
            got = _rayleigh(v, (low + high) / 2, vectors[:, near], rnd.standard_normal(n), norm)
            inside = got is not None and low - tiny <= got[0] <= high + tiny and got[2] <= 64 * n * EPS * norm
            if inside or high - low <= tiny / 8:
                break
            middle = (low + high) / 2   # it left the slice: halve it
            if counted(middle) >= k:
                low = middle
            else:
                high = middle
            if high - low <= tiny and got is not None:
                break
        values.append(got[0])
        vectors = np.c_[vectors, got[1]]
    order = np.argsort(-np.array(values), kind="stable")
    values, vectors = np.array(values)[order], vectors[:, order]
    certified = all(above(v, e + tiny) <= k <= above(v, e - tiny) - 1 for k, e in enumerate(values))
    return Spectrum(values, vectors, certified)


# ---------------------------------------------------------------- rows

def _matrix(batch: pa.RecordBatch, at: int, dims: int, kind) -> np.ndarray:
    return np.asarray(pc.list_flatten(batch.column(at)), kind).reshape(-1, dims)


def entries(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``x`` for its usable rows (see above), of any length; the others go."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), F.lit(HOLD)), F.lit(-HOLD)))
                       + F.lit(OFFSET))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).withColumn("x", held)


@dataclass(frozen=True)
class Fitted:
    n: int
    sums: list[int]
    spectrum: Spectrum
    trace: float
    identity_error: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and rest of S / n, per dimension."""
        whole = [round(Fraction(s, self.n)) for s in self.sums]
        return (np.array(whole, np.int64),
                np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole)]))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.mean
        return ((x - whole) - rest) @ (self.spectrum.vectors / np.sqrt(self.spectrum.values))


def covariance(fit: DataFrame, n: int, sums: list[int]) -> list[list[Fraction]]:
    """Exact covariance (divisor n) of the rows of ``fit``; products are added up per task."""
    dims = len(sums)
    whole = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(dims)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, total = np.array(whole, np.int64), None
        for batch in batches:
            x = _matrix(batch, 0, dims, np.int64) - centre
            most = int(np.abs(x).max(initial=0))
            # float products are exact below 2^53, integer ones below 2^63
            if most * most * max(1, len(x)) < 2 ** 53:
                part = (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
            elif most * most * max(1, len(x)) < 2 ** 63:
                part = (x.T @ x).astype(object)
            else:
                part = x.T.astype(object) @ x.astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                 pa.array([str(v) for v in total[upper]], pa.string())], ["i", "j", "s"])

    # dims (dims + 1) / 2 rows a task, and as many to the driver
    got = (fit.select("x").mapInArrow(work, "i int, j int, s string")
           .groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    rest = [Fraction(s, n) - w for s, w in zip(sums, whole)]
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for r in got:
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = Fraction(int(r["s"]), n) - rest[r["i"]] * rest[r["j"]]
    return out


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = np.asarray(pc.list_flatten(batch.column(0)), np.int64).reshape(len(batch), -1)
                # 2^40 at most per entry: a batch of 2^22 rows can't overflow
                part = x.sum(axis=0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string()),
                 pa.array(np.full(len(total), n))], ["i", "s", "n"])

    got = (fit.select("x").mapInArrow(work, "i int, s string, n long").groupBy("i")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect())  # dims rows
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]


def identity_error(fit: DataFrame, fitted: Fitted) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, dims = len(fitted.spectrum.values), len(fitted.sums)
    if not k:
        return 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = fitted.whitened(_matrix(batch, 0, dims, np.int64))
            total += w.T @ w   # the whitened mean is zero: rows were centred before the projection
        at = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "s"])

    got = (fit.select("x").mapInArrow(work, "i int, j int, s double")
           .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())   # k x k rows
    return max(abs(r["s"] / fitted.n - (r["i"] == r["j"])) for r in got)


def fit(spark: SparkSession, rows: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """Mean, spectrum and identity error of the distinct vectors ``x`` of ``rows`` (one length); None if there are none."""
    distinct = kept(spark, rows.select("x").dropDuplicates(["x"]), "fit-list")
    n, total = totals(distinct)
    if not n:
        return None
    exact = covariance(distinct, n, total)
    v = np.array([[float(e) for e in row] for row in exact])
    fitted = Fitted(n, total, leading(v, components), float(sum(exact[i][i] for i in range(len(total)))), 0.0)
    return Fitted(n, total, fitted.spectrum, fitted.trace, identity_error(distinct, fitted))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 per row; None beyond 64 bits."""
    if not len(x):
        return []
    most = max(max(abs(int(x.max())), abs(int(x.min()))) * n, max(map(abs, sums)))
    if 2 * most < 2 ** 62:
        d = x * np.int64(n) - np.array(sums, np.int64)
        if int(np.abs(d).max()) ** 2 * x.shape[1] <= _LONG:
            return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [s if s <= _LONG else None for s in (d * d).sum(axis=1).tolist()]


def whiten(spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per usable row and component."""
    source = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    usable = entries(source, "vector").select("id", "x")
    lengths = usable.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    schema = T.StructType([usable.schema["id"], T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    if first is None:
        return spark.createDataFrame([], schema)
    dims = first["dims"]
    usable = usable.where(F.size("x") == dims)
    fitted = fit(spark, usable, components)
    k = len(fitted.spectrum.values)
    share = fitted.spectrum.values / fitted.trace if k else np.zeros(0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1, dims, np.int64)
            m = len(x)
            deviation = pa.array(_deviations(x, fitted.n, fitted.sums), pa.int64())
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, fitted.n)), deviation.take(pa.array(again)),
                 pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(share, m)),
                 pa.array(np.full(m * k, fitted.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(work, schema)
