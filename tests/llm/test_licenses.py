import random

import duckdb
import pytest

from airshed.llm import licenses
from airshed.llm.queries import QUERIES, SQL
from tests.llm.cases import alnum, empty, hard, prose


def brute(text, threshold=licenses.THRESHOLD):
    """License -> best containment over the windows of each template's class."""
    words = alnum((text or "").lower())
    own = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    out = {}
    for t in licenses.TEMPLATES:
        w = alnum(t.text.lower())
        shingles = {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
        _, step, size = licenses._class(len(shingles))
        for start in range(0, len(own), step):
            share = len(shingles & set(own[start:start + size])) / len(shingles)
            if share >= threshold:
                out[t.license_id] = max(out.get(t.license_id, 0), share)
    return out


def texts():
    rnd = random.Random(2)
    out = []
    for i in range(120):
        words = " ".join(prose(i, rnd.randrange(60)))
        t = licenses.TEMPLATES[i % len(licenses.TEMPLATES)].text.split()
        if i % 3 == 1:
            t[rnd.randrange(len(t))] = "changed"
        if i % 3 == 2:
            t = t[:len(t) * 2 // 3]
        out.append((i, words + "\n" + " ".join(t).upper() + ",\n" + words))
    return out


def test_against_brute_force(spark):
    rows = texts()
    got = {}
    for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["id"], {})[r["license_id"]] = r["containment"]
    assert got == {i: b for i, t in rows if (b := brute(t))}
    assert len(got) >= 40  # the whole third at least: not a vacuous comparison


def test_bands_find_templates_of_every_size(spark):
    """Whole templates of 1 to 64 shingles, and long ones with a part changed, keep the stated probability."""
    rnd = random.Random(31)
    templates, rows = [], []
    for i in range(96):
        words = [f"t{i}x{rnd.randrange(10 ** 6)}" for _ in range(3 + rnd.choice([0, 1, 2, 4, 15, 31, 63]))]
        templates.append(licenses.Template(f"L{i}", " ".join(words)))
        around = " ".join(prose(i, 40))
        rows.append((2 * i, f"{around} {' '.join(words)} {around}"))
        if len(words) > 30:
            words[rnd.randrange(5, len(words) - 5)] = "changed"   # three shingles fewer
            rows.append((2 * i + 1, f"{around} {' '.join(words)} {around}"))
    got = {(r["id"], r["license_id"]) for r in licenses.scan(
        spark, spark.createDataFrame(rows, "doc_id long, text string"), tuple(templates)).collect()}
    assert got == {(d, f"L{d // 2}") for d, _ in rows}


def test_native_plan(spark):
    df = licenses.scan(spark, hard(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hard_rows(spark):
    rows = [(1, "All Rights RESERVED."), (1, "All Rights RESERVED."), (None, "released under the mit license")]
    got = licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, r["license_id"]) for r in got) == [(0, "MIT"), (1, "reserved")]
    assert licenses.scan(spark, hard(spark)).count() == 0
    assert licenses.scan(spark, empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(spark, hard(spark), templates=(licenses.Template("x", "too short"),))


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01")
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(con.sql(SQL["op3_license_scan"]).project(", ".join(cols)).fetchall())
