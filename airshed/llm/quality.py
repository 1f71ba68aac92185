"""Quality rules (operator 5).

A threshold table is compiled into Spark column expressions: word counts,
length, symbol, stop-word and line ratios, all built-in functions inside one
narrow projection chain (no user functions, no shuffle).

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged one by one alike; input columns stay as they are,
and an input column named like one of the new columns is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words (en, fr, de, es).
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "was", "on",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "pour", "dans", "est",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "für", "auf",
    "el", "los", "las", "y", "se", "por", "para", "con", "una", "como",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high`` (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are SQL over the counted columns below.
DEFAULT_RULES = (
    Rule("mean_word_length", "word_chars / n_words", 3, 10),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.03, None),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.3),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
_WORK = ("words", "lines", "h2", "h4", "h8", "runs", "starts")


def _paired(array: Column, shift: int, size: Column) -> Column:
    """Code of (element i, element i + shift) for every i that has both."""
    return F.when(size > 0, F.zip_with(F.slice(array, F.lit(1), size), F.slice(array, F.lit(1 + shift), size),
                                       lambda a, b: F.xxhash64(a, b))) \
        .otherwise(F.array().cast("array<bigint>"))


def count_text(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Add the counted columns (:data:`COUNTS`) of every whole text.

    Repeated words: each word is coded, codes are paired three times into one
    code per 8-word window, and only texts that hold a code twice sort their
    windows to find which words they cover.  Work columns are projected step
    by step so that no array is computed twice.
    """
    w = {name: f"__quality_{name}" for name in _WORK}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    size = F.size(w["words"])

    df = docs.select(
        *keep,
        F.length(F.translate(body, GAPS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda x: x != "").alias(w["words"]),
        F.filter(F.split(body, "\n"), lambda x: F.translate(x, GAPS, "") != "").alias(w["lines"]))
    df = df.withColumns({
        "n_words": size.cast("long"),
        "n_lines": F.size(w["lines"]).cast("long"),
        "n_dup_lines": (F.size(w["lines"]) - F.size(F.array_distinct(w["lines"]))).cast("long"),
        "n_stop_words": F.size(F.filter(w["words"], lambda x: F.lower(x).isin(*stop_words))).cast("long"),
        w["h2"]: F.transform(w["words"], lambda x: F.xxhash64(x))})
    n = F.col("n_words").cast("int")
    df = df.withColumn(w["h2"], _paired(F.col(w["h2"]), 1, n - 1)).drop(w["words"], w["lines"])
    df = df.withColumn(w["h4"], _paired(F.col(w["h2"]), 2, n - 3)).drop(w["h2"])
    df = df.withColumn(w["h8"], _paired(F.col(w["h4"]), 4, n - 7)).drop(w["h4"])
    # only texts with a repeated window go on: (code, place) sorted by code
    runs = F.sort_array(F.transform(w["h8"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty_runs = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(w["runs"], F.when(F.size(F.array_distinct(w["h8"])) < F.size(w["h8"]), runs)
                       .otherwise(empty_runs)).drop(w["h8"])
    r = F.col(w["runs"])
    # a window is repeated if a neighbour in the sorted run has its code
    starts = F.transform(r, lambda x, j: F.when(
        (x["h"] == F.get(r, j - 1)["h"]) | (x["h"] == F.get(r, j + 1)["h"]), x["i"]))
    df = df.withColumn(w["starts"], F.sort_array(F.filter(starts, lambda i: i.isNotNull()))).drop(w["runs"])
    s = F.col(w["starts"])
    # a window covers 8 words, or up to the next repeated window
    covered = F.aggregate(
        F.transform(s, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", covered).drop(w["starts"])


def judge(docs: DataFrame, text: str = "text", rules=DEFAULT_RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    A ratio whose divisor is 0 is null and fails no rule (the base rule
    already rejects a text without words).
    """
    counted = count_text(docs, text, stop_words)

    def fails(rule: Rule) -> Column:
        metric = F.expr(f"try_divide({rule.metric.replace('/', ',')})") if "/" in rule.metric else F.expr(rule.metric)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (metric < rule.low)
        if rule.high is not None:
            bad = bad | (metric > rule.high)
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.name))

    base = (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[fails(r) for r in rules]) if rules else F.array().cast("array<string>"),
                      lambda x: x.isNotNull())
    return (counted.withColumns({"base_failed": base, "failed_rules": failed})
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def keep_good(docs: DataFrame, text: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """Only the documents that pass; the input's columns.

    The verdict decides in a generator (a rejected row generates null): a
    plain filter would be pushed below the counting projections, and the
    counts inlined into it again and again.
    """
    row = "__quality_row"
    judged = judge(docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text, rules)
    return (judged.select(F.explode_outer(F.when(F.col("kept"), F.array(row))).alias(row))
            .where(F.col(row).isNotNull()).select(f"{row}.*"))
