"""URL filters (operator 2): domain rules, then a learned verdict.

A rule ``host/path`` fits its host and all subdomains if the url's path begins
with the rule's; the longest fitting rule decides.  Urls that no rule fits get
the verdict of a logistic regression on hashed character n-grams of host and
path, trained from a small labelled url table.

Everything runs as built-in expressions and ``pyspark.ml``: n-grams are put
together from the strings' characters, ``HashingTF`` hashes them, ``LogisticRegression`` is fitted on
at most ``MAX_TRAINING`` distinct labelled urls (those with the smallest
hashes; a bounded, repeatable sample in one partition, so fits agree).

Defined results: a null url, or one without ``://``, has an empty host and
path, which no rule with a path fits; repeated urls get equal verdicts; other
columns stay, but those named host, path, rule or verdict are replaced; an
empty table gives no rows; with no labelled urls, or labels of one kind only,
the learned verdict is that label (allow when there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airshed.llm.labelled_urls import LABELLED

ALLOW, BLOCK = "allow", "block"
NGRAMS = (3, 4, 5)
FEATURES = 1 << 15
MAX_TRAINING = 20_000


@dataclass(frozen=True)
class Rule:
    """``text`` is host, then path from the first slash on."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


RULES = (Rule("com/", ALLOW), Rule("example.com/en/", BLOCK), Rule("www.example.com/en/", ALLOW),
         Rule("net/es/", BLOCK), Rule("net/fr/", BLOCK))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    dotted = F.concat(F.lit("."), host_)
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that fits wins
        fits = dotted.endswith("." + r.host) & path_.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _grams(chars: str, mark: str, sizes=NGRAMS) -> Column:
    """Marked character n-grams of an array column of characters (a slice of a string would read it from its start)."""
    parts = [F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), _gram(chars, mark, n)))
             .otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.concat(*parts)


def _gram(chars: str, mark: str, n: int):
    return lambda i: F.concat(F.lit(mark), *[F.get(F.col(chars), i + k) for k in range(n)])


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(f"`{url}`")
    return df.withColumns({"host": host(u), "path": path(u)})


def _characters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _featured(df: DataFrame) -> DataFrame:
    # digits of a path tell pages apart, not kinds of pages
    plain = F.regexp_replace(F.col("path"), "[0-9]+", "0")
    ends = df.withColumns({"__h": _characters(F.concat(F.lit("^"), F.col("host"), F.lit("$"))),
                           "__p": _characters(F.concat(F.lit("^"), plain, F.lit("$")))})
    return ends.withColumn("__grams", F.concat(_grams("__h", "h"), _grams("__p", "p"))).drop("__h", "__p")


@dataclass
class Model:
    """A fitted classifier, or the one verdict that the labels have."""

    fitted: PipelineModel | None
    constant: str = ALLOW

    def verdict(self, df: DataFrame, into: str) -> DataFrame:
        """Adds ``into``; ``df`` has host and path."""
        if self.fitted is None:
            return df.withColumn(into, F.lit(self.constant))
        scored = self.fitted.transform(_featured(df))
        return scored.withColumn(into, F.when(F.col("__block") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW))).drop(
            "__grams", "__features", "__raw", "__probability", "__block")


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING) -> Model:
    """Fit on (host, path, label) rows; ``label`` is allow or block, others are left out."""
    rows = (labelled.where(F.col("label").isin(ALLOW, BLOCK)).select("host", "path", "label").distinct()
            .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_rows))
    rows = _featured(rows).select("__grams", (F.col("label") == BLOCK).cast("double").alias("__label")).coalesce(1)
    rows = rows.persist()
    try:
        kinds = [r[0] for r in rows.select("__label").distinct().collect()]
        if len(kinds) < 2:
            return Model(None, BLOCK if kinds == [1.0] else ALLOW)
        tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True)
        lr = LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__block",
                                rawPredictionCol="__raw", probabilityCol="__probability", regParam=0.001, maxIter=60)
        return Model(PipelineModel([tf, lr.fit(tf.transform(rows).repartition(1))]))
    finally:
        rows.unpersist()


def judge(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (replacing columns so named).

    ``labelled`` has url and label (allow or block); without it the table of
    :mod:`airshed.llm.labelled_urls` is used.
    """
    parts = with_parts(pages, url)
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "__decided": decided})
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(LABELLED, "url string, label string")
    model = train(with_parts(labelled).select("host", "path", "label"))
    return (model.verdict(judged, "__learned")
            .withColumn("verdict", F.coalesce("__decided", "__learned")).drop("__decided", "__learned"))
