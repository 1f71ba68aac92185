import random

import public_tokenizers
import pytest
import sentencepiece

from airshed.llm import tokens
from tests.llm.cases import HARD, empty, hard

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def merger():
    return tokens.PairMerger(tokens.merge_table(PATH))


@pytest.mark.parametrize("text", [
    "", " ", "a", " a", "a  b", "   x    y", "a\nb", "ﬁ x", "é é", "　a", "<s>hi</s>", "<unk>", "<0x41>", "a​b",
    "▁x", "x ▁ y", "\x00a", "日本語 𝔘", "a ", "１２", "\r\n", " " * 50 + "a" + " " * 17, "▁" * 9 + " b", "a" * 5000])
def test_cases(library, merger, text):
    assert merger.count(text) == len(library.encode(text))


def test_random_texts(library, merger):
    rnd = random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice("ab ct h  e\nñé▁.,:()[]{}<>/=日𝔘 inong") for _ in range(rnd.randint(1, 60)))
        assert merger.count(text) == len(library.encode(text)), repr(text)


def test_memo_bound_changes_no_count(library):
    small = tokens.PairMerger(tokens.merge_table(PATH), memo_entries=3)
    text = "many different words go through a very small memo, and some come again and again"
    assert small.count(text) == len(library.encode(text))
    assert len(small.words) <= 3 and len(small.chunks) <= 3


def test_frame(spark, library):
    got = tokens.count_tokens(spark, hard(spark), PATH).collect()
    assert len(got) == len(HARD)
    want = sorted((len((t or "").encode()), len(library.encode(t or ""))) for _, t, _ in HARD)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and any(r["over_limit"] for r in got)
    assert tokens.count_tokens(spark, empty(spark), PATH).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark, docs, PATH).collect()}
    assert got == want
