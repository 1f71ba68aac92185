"""The pipeline against a brute-force version of each stage, and on hard rows."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from airshed.llm import mixing, quality
from tests.llm import test_decontam, test_neardup, test_spans
from tests.llm.cases import hard, white_words
from tests.llm.test_quality import repeat_words

SF = "/root/testdata/sf0.001"


def good(text):
    words, lines = white_words(text), [x for x in (text or "").split("\n") if white_words(x)]
    n = len(words)
    if n < 20 or 100 * repeat_words(words) > 30 * n:
        return False
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    return 3 * n <= sum(map(len, words)) <= 10 * n and sum(text.count(c) for c in quality.SYMBOLS) <= 0.1 * n \
        and stops / n >= 0.03 and (len(lines) - len(set(lines))) / len(lines) <= 0.3


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        done = stage(spark, docs, SF)
        out.append((docs.collect(), done.collect(), docs.columns, done.columns))
        docs = spark.createDataFrame(out[-1][1], done.schema)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "decontamination",
                                         "source mix"]
    for _, _, before, after in stages[:4]:
        assert before == after


def test_quality_stage(stages):
    before, after, _, _ = stages[0]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if good(r["text"])}
    assert 0 < len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after, _, _ = stages[1]
    classes = test_neardup.brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == set(classes.values())


def test_substring_stage(stages):
    before, after, _, _ = stages[2]
    want = test_spans.brute([(r["doc_id"], r["text"]) for r in before])
    got = {r["doc_id"]: r["text"] for r in after}
    assert got == {i: t for i, t in want.items() if i in got}
    assert all(not want[i].strip() for i in want.keys() - got.keys())
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_decontamination_stage(spark, stages):
    before, after, _, _ = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = test_decontam.brute([(r["doc_id"], r["text"]) for r in before], items)
    assert {r["doc_id"] for r in after} == {i for i, (h, _) in hits.items() if not h}


def test_mix_stage(stages):
    before, after, _, _ = stages[4]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += len(white_words(r["text"]))
    for r in after:
        taken[r["source"]] += r["size"]
        assert r["size"] == len(white_words(r["text"]))
    names = sorted(sizes)
    want = mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    largest = max(len(white_words(r["text"])) for r in before)
    for s, t in zip(names, want, strict=True):
        assert abs(taken[s] - t) <= largest / 2


def test_run_on_hard_rows(spark, tmp_dir):
    """Nulls, empty texts, repeated rows and extra columns go through all stages; an empty table too."""
    base = hard(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_dir}/a/benchmark.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_dir}/b/benchmark.parquet")
    base.write.parquet(f"{tmp_dir}/a/documents.parquet")
    base.where("false").write.parquet(f"{tmp_dir}/b/documents.parquet")
    assert {r["doc_id"] for r in cp.run(spark, f"{tmp_dir}/a").collect()} <= {7, 8}
    assert cp.run(spark, f"{tmp_dir}/b").count() == 0


def test_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
