import hashlib
import random

import duckdb
import numpy as np
import pytest

from airshed.llm import decontam
from airshed.llm.queries import QUERIES, SQL
from tests.llm.cases import HARD, alnum, empty, hard, prose


def brute(docs, items, window=10):
    """Per document: hit word places and item ids."""
    known, out = {}, {}
    for item, t in items:
        w = alnum(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[a:a + n]), set()).add(item)
    sizes = {len(k) for k in known}
    for i, text in docs:
        words, hit, ids = alnum(text), set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                found = known.get(tuple(words[p:p + n]))
                if found:
                    hit.update(range(p, p + n))
                    ids |= found
        out[i] = (hit, sorted(map(str, ids)))
    return out


def table():
    rnd = random.Random(5)
    items = [(i, " ".join(prose(100 + i, rnd.choice([3, 9, 10, 14, 40])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, items[0][1]), (15, items[4][1].upper())]
    docs = [(i, " ".join(prose(i, rnd.randrange(0, 120)))) for i in range(40)]
    for i in range(0, 40, 3):  # plant passages: whole, cut, doubled
        w = items[i % 12][1].split()
        text = docs[i][1].split()
        at = rnd.randrange(len(text) + 1)
        text[at:at] = w[rnd.randrange(3):] + w[:rnd.randrange(12)]
        docs[i] = (i, ", ".join(text).upper() if i % 2 else " ".join(text))
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r for r in decontam.find(spark, d, b, exact=True, **kw).withColumn(
        "n_hit", decontam.covered_words()).collect()}


def test_against_brute_force(spark):
    docs, items = table()
    want, got = brute(docs, items), run(spark, docs, items)
    assert any(h for h, _ in want.values())
    for i, (hit, ids) in want.items():
        assert got[i]["n_hit"] == len(hit)
        assert sorted(got[i]["items"]) == ids
        assert {p for s in got[i]["spans"] for p in range(s["start"], s["start"] + s["length"])} == hit


def test_blocks_agree(spark):
    docs, items = table()
    items += items[:8] + [(20 + i, items[4][1]) for i in range(30)]  # repeated rows, a window of many items
    one, many = run(spark, docs, items), run(spark, docs, items, block_windows=60)
    for i in one:
        assert one[i]["n_hit"] == many[i]["n_hit"] and sorted(one[i]["items"]) == sorted(many[i]["items"])
        assert sorted(one[i]["spans"]) == sorted(many[i]["spans"])


def test_windows_of_items(spark):
    """Each (item, window) once; a long item's windows are spread over blocks."""
    rows = [(1, "a b c"), (1, "a b c"), (2, "a, B c d"), (3, " ".join(prose(1, 25_000, 10**9))), (4, None), (None, "é日 x")]
    got = decontam.cut_items(spark.createDataFrame(rows, "item_id long, text string"), window=3)
    small = sorted((r["id"] or "", r["words"]) for r in got.where("id IS NULL OR id < '3'").collect())
    assert small == [("", "é日 x"), ("1", "a b c"), ("2", "a b c"), ("2", "b c d")]
    assert got.where("id = '3'").count() == 24_998
    sizes = got.selectExpr("pmod(xxhash64(id, words), 10L) AS b").groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 3_000


@pytest.mark.parametrize("threshold", [1.0, 0.8, 0.5])
def test_prefix_filter_loses_no_window(threshold):
    """Containment over item-sized runs, against all runs; edits keep the order of the other words."""
    rnd = random.Random(9)
    items = [(str(i), " ".join(prose(i, 12, 50))) for i in range(6)]
    block = decontam.build_block(items, 3, threshold)
    texts = []
    for i in range(60):
        w = items[i % 6][1].split()
        if i % 3:
            w[rnd.randrange(12)] = "changed"
        texts.append(" ".join(prose(1000 + i, 20, 50) + w + prose(2000 + i, 20, 50)).encode())
    decontam.set_prefixes(block, {k: np.zeros(len(v), np.int64) for k, v in decontam._known(block).items()})
    ids, starts, ends = decontam._flatten(texts, block.vocabulary)
    got = {(w, b) for _, w, b, _, _ in decontam.probe(block, ids, starts, ends)}
    own = [t.split() for _, t in items]
    for d, t in enumerate(texts):
        words = t.decode().split()
        for b in range(len(words) - 11):
            there = {tuple(words[b + j:b + j + 3]) for j in range(10)}
            for w, mine in enumerate(own):
                s = {tuple(mine[j:j + 3]) for j in range(10)}
                if len(s & there) / len(s) >= threshold:
                    assert (w, b + int(starts[d])) in got


def test_hard_rows(spark):
    items = spark.createDataFrame([(1, "one"), (None, "the rest"), (2, None)], "item_id long, text string")
    got = decontam.find(spark, hard(spark), items, exact=True).collect()
    assert len(got) == len(HARD)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["items"] == ["1"] and by[4]["n_words"] == 1 and by[1]["n_words"] == 0 and by[1]["spans"] == []
    assert by[None]["items"] == [] and by[None]["spans"]  # an item without an id marks words only
    assert by[4]["size"] == "x-size"
    assert decontam.find(spark, empty(spark), items).count() == 0
    assert decontam.find(spark, hard(spark), items.where("false")).where("size(spans) > 0").count() == 0


def test_sql_and_digest(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = QUERIES["op7_decontamination"](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*cols).collect()))
    assert rows == sorted(con.sql(SQL["op7_decontamination"]).project(", ".join(cols)).fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r[cols.index("items_sha256")] for r in rows}
