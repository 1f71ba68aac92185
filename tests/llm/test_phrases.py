"""Operator 11: against a brute-force count in plain Python and the registered SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from airshed.llm import phrases
from tests.llm import cases


def brute(rows, support, longest=3, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            cuts = [(10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return out


def texts(seed, n, vocabulary=25):
    rnd = random.Random(seed)
    ends = [" ", "  ", "\t", ". ", ", ", "! ", "\n", "\r\n", " ", " ", "\x0b"]
    out = []
    for i in range(n):
        words = [rnd.choice(["New", "York", "é", "Größe", "日本", *[f"w{j}" for j in range(vocabulary)]])
                 for _ in range(rnd.randrange(60))]
        if i % 3 == 0:
            words[10:10] = ["the", "United", "States", "of"]
        out.append((rnd.choice(["en", "en", "de", None, ""]), "".join(w + rnd.choice(ends) for w in words)))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("support,longest,top,held", [(3, 3, 2000, 10 ** 6), (6, 4, 25, 50), (10, 2, 10, 10 ** 6)])
def test_equals_brute_force(spark, monkeypatch, support, longest, top, held):
    rows = texts(support, 300) + [("fr", None), (None, ""), ("en", "\x1c .,;:!?\n a\x0bb\ta"), ("es", "one two " * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 3000)
    got = phrases.collocations(spark, docs, support=support, longest=longest, top=top)
    assert rows_of(got) == brute(rows, support, longest, top=top)


def test_scores_beyond_64_bits(spark):
    big = 10 ** 13
    df = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 3)],
                               "lang string, phrase string, words int, f long")
    assert phrases.scored(df).first()["score"] == 10 ** 6 * big * big // ((big + 7) * (big + 3))


def test_local_support_never_loses_a_phrase():
    rnd = random.Random(2)
    for _ in range(2000):
        parts = [rnd.random() ** 3 for _ in range(4)]
        total = sum(parts)
        least = [phrases.local_support(10, p / total) for p in parts]
        # the most that stays below local support everywhere stays below global support
        assert sum(x - 1 for x in least) < 10


def test_hard_rows_and_empty_table(spark):
    hard = cases.hard(spark).withColumnRenamed("source", "lang")
    want = brute([(r["lang"], r["text"]) for r in hard.select("lang", "text").collect()], 10)
    assert rows_of(phrases.collocations(spark, hard)) == want
    assert phrases.collocations(spark, hard.where("false")).collect() == []
