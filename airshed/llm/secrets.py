"""Secret scans (operator 13): fixed patterns, then a randomness test battery.

Patterns (kinds ``assign``, ``access`` and ``hex``; see ``BASE``) give the base
spans.  The method adds spans of kind ``random``: runs of 16 or more characters
of ``[A-Za-z0-9+/_=-]`` that touch no base span, whose encoding can be inferred
and whose symbols look drawn at random.

1. *Encoding*, the first that fits: ``hex`` (one letter case, letters and
   digits), ``base32`` (A-Z2-7, letters and digits), ``alnum`` (letters and
   digits, at least two of upper, lower, digit), ``base64`` (also ``+ /`` or
   trailing ``=``), ``base64url`` (also ``- _``).  Runs of one letter case, of a
   capital and small letters, or of digits alone have no encoding: they are
   words and numbers and aren't tested.
2. *Tests.*  The null hypothesis is an ordinary string; a small p-value speaks
   for randomness.  (a) Chi-squared uniformity over the alphabet: ordinary
   strings repeat symbols at a rate of ``2 / alphabet``, at least ``REPEAT``.
   (b) Runs of character classes: ordinary strings change class at half the
   rate of random ones in this alphabet, ``CHANGE`` at most.  (c) Serial correlation of symbol values: ordinary ones have
   ``SERIAL``.  Each p-value falls with the length of the string.
3. *Combination*: at least two of the three tests must speak for randomness
   (partial conjunction: twice the second smallest p-value).
4. *Length-aware false-discovery control*: Benjamini-Hochberg at ``q`` within
   every class of encoding and length (lengths from a power of two to the
   next), over all documents; p-values are rounded up to a grid of 50 steps a
   decade, so that counts per step (a bounded table) decide.

One pass over the texts writes base spans and tested runs per document; the
counts and the verdicts read that table.

Defined results: null and empty texts have no spans; one row per input row, so
repeated rows repeat; an empty table gives no rows; a whole text is scanned
whatever its length; other columns don't matter and only the id is carried
over (its type stays).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.llm.tables import kept

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 16
Q = 0.05
REPEAT = 0.065         # chance that two letters of ordinary text are equal
SPREAD = 0.0013        # sum of p^3 minus square of sum of p^2, for ordinary text: more variance of repeats
CHANGE = 0.25          # chance that neighbours in an ordinary string are of different classes (see class_runs)
SERIAL = 0.3           # lag-one correlation of symbol values in an ordinary string
STEPS = 50             # grid steps a decade of p
LAST = 1000            # the grid ends at 10^-20

# The base patterns (group 2 of ``assign`` has 8 or more characters).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
STEMS = ("password", "passwd", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _UPPER + _LOWER + _DIGITS
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|)=*")
ENCODINGS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("hex", _DIGITS + "abcdef", re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)")),
    ("base32", _UPPER + "234567", re.compile(r"(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+=*")),
    ("alnum", _ALNUM, re.compile(r"[A-Za-z0-9]+")),
    ("base64", _ALNUM + "+/", re.compile(r"[A-Za-z0-9+/]+=*")),
    ("base64url", _ALNUM + "-_", re.compile(r"[A-Za-z0-9_-]+=*")),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k), X ~ Binomial(n, p); the normal law with continuity correction beyond 1,000 trials."""
    if k <= 0:
        return 1.0
    if n > 1000:
        return _normal(-(k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                 + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def uniformity(values: list[int], size: int) -> float:
    """p-value of few repeats: the chi-squared statistic is (size / n) (2 pairs + n) - n, so either decides."""
    n = len(values)
    pairs = sum(c * (c - 1) for c in Counter(values).values()) / 2
    rate = max(2 / size, REPEAT)
    mean = n * (n - 1) / 2 * rate
    spread = SPREAD if rate == REPEAT else 0.0
    return _normal((pairs + 0.5 - mean) / math.sqrt(mean + n ** 3 * spread))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def class_runs(token: str, alphabet: str) -> float:
    """p-value of many changes between upper case, lower case, digits and signs."""
    shares = [n / len(alphabet) for n in Counter(map(_class, alphabet)).values()]
    ordinary = min(CHANGE, (1 - sum(s * s for s in shares)) / 2)
    kinds = [_class(c) for c in token]
    return _binomial_tail(len(kinds) - 1, ordinary, sum(a != b for a, b in zip(kinds, kinds[1:])))


def serial(values: list[int]) -> float:
    """p-value of a lag-one correlation near zero."""
    n = len(values)
    mean = sum(values) / n
    total = sum((v - mean) ** 2 for v in values)
    if not total:
        return 1.0
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / total
    r = min(abs(r), 0.999999)
    return _normal((math.atanh(r) - math.atanh(SERIAL)) * math.sqrt(n - 3))


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, combined p-value) of a run of characters, None without an encoding."""
    if PLAIN.fullmatch(token):
        return None
    for name, alphabet, pattern in ENCODINGS:
        if pattern.fullmatch(token):
            symbols = token.rstrip("=")
            if len(symbols) < MIN_LENGTH:
                return None
            place = {c: i for i, c in enumerate(alphabet)}
            if name == "hex":
                symbols = symbols.lower()
            values = [place[c] for c in symbols]
            tests = sorted((uniformity(values, len(alphabet)), class_runs(symbols, alphabet), serial(values)))
            return name, min(1.0, 2 * tests[1])
    return None


def grid_step(p: float) -> int:
    """Number of the grid value 10^(-step / 50) that is not below ``p``."""
    return min(LAST, max(0, math.floor(-math.log10(p) * STEPS))) if p > 0 else LAST


def _merged(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    """Disjoint covered stretches, by start."""
    out: list[list[int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def examine(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """Base spans, and (start, end, encoding, grid step) of the tested runs."""
    if not text:
        return [], []
    base = base_spans(text)
    tested = []
    covered = _merged(base)
    starts = [c[0] for c in covered]
    for m in RUN.finditer(text):
        i = bisect_left(starts, m.end())  # covered stretches before i begin before the run ends
        if i and covered[i - 1][1] > m.start():
            continue
        found = battery(m.group())
        if found:
            tested.append((m.start(), m.end(), found[0], grid_step(found[1])))
    return base, tested


_SPAN = "array<struct<start:long,end:long,kind:string>>"
_RUN = "array<struct<start:long,end:long,encoding:string,size:int,step:int>>"


def _examined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    df = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([df.schema["id"], T.StructField("base", T._parse_datatype_string(_SPAN)),
                           T.StructField("tested", T._parse_datatype_string(_RUN))])
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()),
                                   ("size", pa.int32()), ("step", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for value in batch.column(1):
                b, t = examine(value.as_py())
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
                tested.append([{"start": s, "end": e, "encoding": c, "size": (e - s).bit_length(), "step": g}
                               for s, e, c, g in t])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, base_type), pa.array(tested, run_type)], ["id", "base", "tested"])

    return df.mapInArrow(work, schema)


def thresholds(counts: list[tuple[str, int, int, int]], q: float) -> dict[tuple[str, int], int]:
    """Least accepted grid step per (encoding, size class), by Benjamini-Hochberg.

    ``counts`` holds (encoding, size class, step, number of runs)."""
    groups: dict[tuple[str, int], dict[int, int]] = {}
    for encoding, size, step, n in counts:
        groups.setdefault((encoding, size), {})[step] = n
    out = {}
    for key, steps in groups.items():
        total, reached = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            reached += steps[step]
            if 10 ** (-step / STEPS) * total <= q * reached:
                out[key] = step
    return out


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """(id, spans): every row's secrets as (start, end, kind, encoding, p), by start, then kind.

    Places are code points, the end exclusive; encoding and p are null for base spans.
    """
    seen = kept(spark, _examined(docs, doc_id, text), "secrets")
    # at most encodings x size classes x grid steps rows reach the driver
    counts = (seen.select(F.explode("tested").alias("r")).groupBy("r.encoding", "r.size", "r.step")
              .agg(F.count(F.lit(1)).alias("n")).collect())
    least = thresholds([(r["encoding"], r["size"], r["step"], r["n"]) for r in counts], q)

    def accepted(r: Column) -> Column:
        passed = F.lit(False)
        for (encoding, size), step in sorted(least.items()):  # one comparison per class
            passed = passed | ((r["encoding"] == encoding) & (r["size"] == size) & (r["step"] >= step))
        return passed

    spans = seen.select("id", "base", F.filter("tested", accepted).alias("found"))
    rank = {k: i for i, k in enumerate(KINDS)}
    base = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"),
        F.when(s["kind"] == "assign", rank["assign"]).when(s["kind"] == "access", rank["access"])
        .otherwise(rank["hex"]).alias("place"),
        s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast("string").alias("encoding"),
        F.lit(None).cast("double").alias("p")))
    found = F.transform("found", lambda r: F.struct(
        r["start"].alias("start"), F.lit(rank["random"]).alias("place"), r["end"].alias("end"),
        F.lit("random").alias("kind"), r["encoding"].alias("encoding"),
        F.pow(F.lit(10.0), -r["step"] / F.lit(float(STEPS))).alias("p")))
    ordered = F.array_sort(F.concat(base, found))
    return spans.select("id", F.transform(ordered, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["encoding"].alias("encoding"),
        s["p"].alias("p"))).alias("spans"))
