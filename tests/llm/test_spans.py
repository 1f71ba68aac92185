import random

import pytest

from airshed.llm import spans
from tests.llm.cases import CLASH, HARD, empty, hard, prose


def brute(docs, min_words=spans.MIN_WORDS):
    """(id, text) rows with unique ids: the kept text of each, by the definition."""
    cut = {i: spans.sentences((t or "").encode()) for i, t in docs}
    first = {}
    for i in sorted(cut):
        keys = cut[i][1]
        for p in range(len(keys) - spans.RUN + 1):
            first.setdefault(tuple(keys[p:p + spans.RUN]), (i, p))
    out = {}
    for i, t in docs:
        ranges, keys, sizes = cut[i]
        gone = [False] * len(keys)
        for p in range(len(keys) - spans.RUN + 1):
            if first[tuple(keys[p:p + spans.RUN])] != (i, p):
                gone[p:p + spans.RUN] = [True] * spans.RUN
        a = 0
        while a < len(gone):
            e = a
            while e < len(gone) and gone[e]:
                e += 1
            if e > a and sum(sizes[a:e]) < min_words:
                gone[a:e] = [False] * (e - a)
            a = max(e, a + 1)
        body = (t or "").encode()
        out[i] = b"".join(body[x:y] for (x, y), g in zip(ranges, gone, strict=True) if not g).decode() \
            if any(gone) else t
    return out


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n)).capitalize() + rnd.choice([". ", "! ", "?\n", ".\n"])


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    shared = ["".join(sentence(rnd, rnd.choice([4, 9, 20, 60])) for _ in range(6)) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [sentence(rnd, rnd.choice([1, 3, 8, 15, 40])) for _ in range(rnd.randrange(0, 12))]
        if i % 2:
            parts.insert(rnd.randrange(len(parts) + 1), shared[i % 5])
        if i % 7 == 0:
            parts += [shared[0], shared[0]]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    got = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert sum(r["n_removed"] for r in got) > 20


def test_long_passages_go_wherever_they_stand(spark):
    """A passage of over 50 words, sentence by sentence or inside a longer sentence, stays in one document."""
    passage = " ".join(prose(1, 60))
    docs = [(1, "Begin here. " + passage.capitalize() + ". The end."), (2, "Other text. " + passage.capitalize() + ".\nMore."),
            (3, " ".join(prose(2, 33)) + " " + passage + " " + " ".join(prose(3, 9)) + "."), (4, " ".join(prose(4, 80)) + ".")]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = passage.split()

    def longest(text):
        low = text.lower().replace(".", " ").split()
        best = 0
        for a in range(len(low)):
            for b in range(len(words)):
                n = 0
                while a + n < len(low) and b + n < len(words) and low[a + n] == words[b + n]:
                    n += 1
                best = max(best, n)
        return best
    assert longest(got[1]) == 60 and longest(got[2]) < 20 and longest(got[3]) < 30
    assert got[4] == docs[3][1]


def test_passages_of_51_words_in_running_text(spark):
    """Wherever it stands in sentences without end, a passage of 51 words goes in at least 99 % of the cases."""
    rnd = random.Random(8)
    docs = []
    for n in range(400):
        passage = prose(1000 + n, 51)
        for side in range(2):
            around = [prose(10_000 + 4 * n + 2 * side + i, rnd.randrange(10, 90)) for i in range(2)]
            docs.append((2 * n + side, " ".join([*around[0], *passage, *around[1]])))
    got = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")) \
        .select("doc_id", "words_removed").collect()
    removed = {r["doc_id"]: r["words_removed"] for r in got}
    later = [removed[2 * n + 1] for n in range(400)]
    assert not any(removed[2 * n] for n in range(400))
    assert sum(w == 0 for w in later) <= 4 and max(later) <= 51
    assert sum(later) / 400 > 36


def test_bitmap_keeps_every_shared_run(spark):
    rnd = random.Random(9)
    codes = [(rnd.randrange(-2**63, 2**63), rnd.randrange(-2**63, 2**63)) for _ in range(3000)]
    codes += [(-2**63, 1), (2**63 - 1, 2), (0, 3), (-1, 4), (spans.BITS, 5), (spans.BITS - 1, 6)]
    runs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(codes)], "h1 long, h2 long, place int")
    shared = runs.where("place % 2 = 0")
    met = {r["place"] for r in spans._met(runs, shared).collect()}
    assert met >= set(range(0, len(codes), 2)) and len(met) < len(codes) / 2 + 20
    assert spans._met(runs, shared.limit(0)).count() == 0


def test_short_repeats_stay(spark):
    docs = [(i, f"All rights reserved. No. Yes. {' '.join(prose(i, 40))}.") for i in range(5)]
    got = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(docs)


def test_sentences_tile_the_text():
    for _, t, _ in HARD:
        body = (t or "").encode()
        ranges, keys, sizes = spans.sentences(body)
        assert b"".join(body[a:b] for a, b in ranges) == (body if ranges else b"")
        assert all(len(k.split()) == s <= spans.PIECE for k, s in zip(keys, sizes, strict=True))


def test_hard_rows(spark):
    got = spans.remove_repeats(hard(spark)).collect()
    assert len(got) == len(HARD)
    texts = {(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 7}
    assert texts == {(i, t) for i, t, _ in HARD if i != 7}
    assert {r["size"] for r in got} == {"x-size"}
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "n_removed", "words_removed", "n_sentences", *CLASH}
    assert spans.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    rnd = random.Random(5)
    text = "".join(sentence(rnd, 20) for _ in range(4))
    rows = [(3, text), (3, text), (None, text), (None, text), (9, text), (3, "something else under the id.")]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted(((r["doc_id"] or 0), r["text"]) for r in got)
    assert left == sorted([(0, ""), (0, ""), (3, "something else under the id."), (3, text), (3, text), (9, "")])
