import collections

import duckdb
import pytest

from airshed.llm import quality
from airshed.llm.queries import QUERIES, SQL
from tests.llm.cases import HARD, empty, hard, white_words


def repeat_words(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)})


def test_counts_of_hard_rows(spark):
    got = quality.judge(hard(spark)).collect()
    assert len(got) == len(HARD)
    texts = {i: t for i, t, _ in HARD}
    for r in got:
        words = white_words(texts[r["doc_id"]])
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if white_words(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeat_words(words)
        assert r["spans"] == "x-spans"
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))


@pytest.mark.parametrize("text", [
    "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g h i", "x " * 30, "a b c d e f g", "a b c d e f g h",
    "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 6 7 8 9 10 z 2 3 4 5 6 7 8 9"])
def test_repeated_windows(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.count_text(df).first()["n_repeat_words"] == repeat_words(white_words(text))


def test_each_rule_rejects(spark):
    good = " ".join(["the house of words and more is in it"] * 1) + " " + " ".join(f"plain{i}" for i in range(20))
    cases = [("good", good), ("mean_word_length", "the of " + "a" * 400 + " " + good),
             ("symbol_ratio", good + " ### $$$"), ("stop_word_ratio", " ".join(f"plain{i}" for i in range(40))),
             ("dup_line_ratio", good + "\nsame line" * 6)]
    got = {r["name"]: r for r in quality.judge(spark.createDataFrame(cases, "name string, text string")).collect()}
    assert got["good"]["kept"]
    for name, _ in cases[1:]:
        assert got[name]["failed_rules"] == [name] and not got[name]["kept"]


def test_keep_good_keeps_columns(spark):
    df = hard(spark)
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(empty(spark)).count() == 0


def test_no_user_functions_and_no_shuffle(spark):
    plan = quality.judge(hard(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sql(spark, tmp_dir):
    from airshed.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    got = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.sql(SQL["op5_quality_rules"]).project(", ".join(cols)).fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
