import random
import re

import pytest
from pyspark.sql import functions as F

from airshed.llm import urls
from airshed.llm.labelled_urls import ALLOW, BLOCK, LABELLED
from airshed.llm.queries import QUERIES


def split(url):
    """Host and path by plain string search."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    tail = rest[cut:]
    ends = [tail.find(c) for c in "?#" if c in tail]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:min(ends, default=len(tail))]


def decide(host, path):
    best = None
    for r in urls.RULES:
        if ("." + host).endswith("." + r.host) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return (best.text, best.verdict) if best else (None, None)


CASES = [None, "", "no scheme", "http://", "http://A.Com", "http://a.com/", "https://www.EXAMPLE.com/en/x?y#z",
         "https://example.com/en/", "http://a.www.example.com/en/1", "http://notexample.com/en/1", "http://x.example.com/en",
         "http://a.net/es/1", "http://net/fr/", "http://a.net/fr", "a://b://c/d", "http://com/", "http://a.com?x=/",
         "http://a.com#/en/", "http://ÄB.com/é/日", "http://a\nb.com/\nc", "x" * 5000 + "://a.com/" + "y" * 50_000]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(CASES)
    for i, u in enumerate(CASES):
        host, path = split(u)
        rule, verdict = decide(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_no_labels(spark):
    df = spark.createDataFrame([("http://a.org/x",), (None,)], "url string")
    none = spark.createDataFrame([], "url string, label string")
    assert {r["verdict"] for r in urls.judge(df, none).collect()} == {"allow"}
    bad = spark.createDataFrame([("http://b.org", "block"), ("http://c.org", "other"), ("http://c.org", None)],
                                "url string, label string")
    assert {r["verdict"] for r in urls.judge(df, bad).collect()} == {"block"}
    assert urls.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("held", [0, 1])
def test_held_out_hosts(spark, held):
    """Hosts not in the labelled table are told apart by their character n-grams."""
    kinds = {"block": ["casino", "pills", "poker", "bets"], "allow": ["library", "museum", "garden", "weather"]}
    rows = [(f"http://{a}-{w}{i}.example.org/{k % 7}/p{i}.html", label)
            for k, (label, words) in enumerate(kinds.items()) for w in words for i in range(40)
            for a in (("win", "my", "top") if label == "block" else ("city", "my", "old"))]
    df = spark.createDataFrame(rows, "url string, label string").withColumn("part", F.pmod(F.xxhash64("url"), F.lit(2)))
    got = urls.judge(df.where(F.col("part") == held).drop("label"), df.where(F.col("part") != held))
    truth = df.where(F.col("part") == held).select("url", "label")
    right = got.join(truth, "url").agg(F.avg((F.col("verdict") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97


def words(urls_):
    """Letters-only words of the hosts, without the shared domain."""
    return {w for u in urls_ for w in re.findall("[a-z]+", split(u)[0].partition(".example.")[0])} - {"www", "m", "blog"}


def unseen(seed, n):
    """(url, label) with hosts of new syllables; the evidence lies in the path, or in how the host is put together."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        name = "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)) + rnd.choice(["", "n", "x"])
        sub = rnd.choice(["", "www.", "m.", "blog."])
        if i % 2:
            path = rnd.choice(["click/out", "redirect/offer", "track/click", "buy/cheap", "claim/prize", "order/now", "casino/bonus"])
        else:
            path = rnd.choice(["en", "de", "fr", "articles", "news/local", "library/catalog", "recipes", "lessons"])
        tld = rnd.choice(["com", "net", "org"])
        out.append((f"http://{sub}{name}.example.{tld}/{path}/{rnd.randrange(999)}", "block" if i % 2 else "allow"))
    return out


def test_hosts_without_shared_words(spark):
    """Hosts none of whose words are in the labelled table."""
    known = words([u for u, _ in LABELLED])
    rows = [(u, label) for u, label in unseen(4, 1200) if not words([u]) & known]
    assert len(rows) > 1000
    df = spark.createDataFrame(rows, "url string, label string")
    got = urls.judge(df).where("rule IS NULL").selectExpr("label", "verdict").collect()
    for kind in ("block", "allow"):
        own = [r["verdict"] == kind for r in got if r["label"] == kind]
        assert sum(own) / len(own) > 0.95, kind


def test_held_out_rows_of_the_table(spark):
    """Every fourth labelled url held out in turn (measured: 56 of 75 blocked, 65 of 75 allowed; folds are 0.79 or more)."""
    part = [(u, label, i % 4) for i, (u, label) in enumerate([(u, "block") for u in BLOCK] + [(u, "allow") for u in ALLOW])]
    df = spark.createDataFrame(part, "url string, label string, part int")
    right = {"block": 0, "allow": 0}
    for held in range(4):
        for r in urls.judge(df.where(f"part = {held}"), df.where(f"part <> {held}"), rules=()).collect():
            right[r["label"]] += r["verdict"] == r["label"]
    assert right["block"] >= 0.7 * 75 and right["allow"] >= 0.8 * 75


def test_hard_rows(spark):
    df = spark.createDataFrame([("http://A.org/" + "x" * 300_000, 1), ("http://A.org/" + "x" * 300_000, 1), (None, None),
                                ("", 2)], "url string, page_id long")
    df = df.selectExpr("*", *(f"'x' AS {c}" for c in ("host", "path", "rule", "verdict", "__h", "label", "features")))
    got = urls.judge(df).collect()
    assert len(got) == 4 and {r["label"] for r in got} == {"x"}
    assert len({r["verdict"] for r in got if r["host"] == "a.org"}) == 1
    assert {(r["host"], r["path"], r["rule"]) for r in got if not r["url"]} == {("", "", None)}
    assert urls.judge(df.where("false")).count() == 0


def test_whole_table(spark):
    """Rules exactly; learned verdicts against the hosts that a reader of the table would block."""
    unwanted = ("cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm", "ads-track")
    got = QUERIES["op2_url_filter"](spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(pages)
    learned = {"allow": [], "block": []}
    for r in got:
        host, path = split(pages[r["page_id"]])
        rule, verdict = decide(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if verdict:
            assert r["verdict"] == verdict
        else:
            kind = "block" if any(w in host for w in unwanted) else "allow"
            learned[kind].append(r["verdict"] == kind)
    assert learned["block"] and sum(learned["block"]) / len(learned["block"]) > 0.95
    assert sum(learned["allow"]) / len(learned["allow"]) > 0.99
