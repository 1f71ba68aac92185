"""Hard rows that every operator must take, and small brute-force helpers."""

from __future__ import annotations

import random
import re

LONG = " ".join(f"word{i % 977} and the other." for i in range(30_000))

HARD = [
    (1, None, "src1"), (2, "", "src1"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "src2"), (5, "one", "src2"),
    (5, "one", "src2"), (None, "text without an id and the rest of it.", "src3"), (7, LONG, "src1"),
    (8, "Ünïcode 日本語 𝔘 and the rest line\x00nul", None), (9, "a\r\nb\r\n\r\na\r\n", ""),
]
SCHEMA = "doc_id long, text string, source string"
#: Columns named like those that operators add.
CLASH = ("n_words", "spans", "items", "size", "taken", "kept", "class", "id", "place", "words", "host", "t", "s", "u",
         "n_bytes", "source_size", "copies", "shards", "n_sentences", "key", "node")


def hard(spark):
    """The hard rows with extra columns of clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(HARD, SCHEMA)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH})


def empty(spark):
    return hard(spark).where("false")


def white_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def prose(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
