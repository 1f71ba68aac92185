import random

import pytest

from airshed.llm import chat
from airshed.llm.queries import QUERIES

TABLE = "/root/testdata/sf0.01/conversations.parquet"
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def model(spark):
    return chat.train(spark, chat.parts(spark, spark.read.parquet(TABLE)).where("conv_id % 3 <> 0"))


def test_held_out_roles(spark, model):
    """Roles of conversations that the model has not seen, whole transcripts."""
    right = n = 0
    for r in chat.parts(spark, spark.read.parquet(TABLE)).where("conv_id % 3 = 0").collect():
        raw = "\n".join(line for line, _ in chat._lines([t.asDict() for t in r["turns"]], r["conv_id"]))
        right += [role for role, _ in chat.parse(model, raw)] == [t["role"] for t in r["turns"]]
        n += 1
    assert right / n > 0.95


def test_marked_turns_are_exact(model):
    turns = [("user", "Where is it?\nI looked\neverywhere."), ("assistant", "There: on the table."), ("user", "Thanks")]
    raw = "\n".join(line for line, _ in chat.write_transcript(turns, 0))
    assert chat.parse(model, raw) == [("user", "Where is it?\nI looked\neverywhere."), *turns[1:]]


@pytest.mark.parametrize("text", [None, "", " \n\t\n"])
def test_blank_transcripts(model, text):
    assert chat.parse(model, text) == [] and chat.render(chat.parse(model, text)) == ""


def test_render_and_markers():
    assert chat.render([("user", "a <|user|> b")]) == "<|user|>\na < |user|> b\n<|end|>\n"
    assert chat.marker("**Human**: hi") == ("user", "hi") and chat.marker("[AI]: x") == ("assistant", "x")
    assert chat.marker("Note: x") == ("other", "Note: x") and chat.marker("plain") == ("none", "plain")


def test_viterbi_against_all_paths(model):
    import itertools
    seen = [o for o, _ in chat.observe(["User: a?", "more of it", "", "Assistant: well.", "Q: b"])]
    emit = model.score(seen)

    def value(path):
        v = model.start[path[0]] + emit[0][path[0]]
        for t in range(1, len(path)):
            v = v + model.move[path[t - 1], path[t]] + emit[t][path[t]]
        return v
    best = max(itertools.product(range(len(chat.STATES)), repeat=len(seen)), key=value)
    assert tuple(chat.viterbi(model, seen)) == best


def test_long_transcript(model):
    raw = "\n".join(f"{'User' if i % 2 else 'Assistant'}: turn {i}." for i in range(20_000))
    assert len(chat.parse(model, raw)) == 20_000


def joined(rows):
    """Roles and rendering of every conversation, its parts put together in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["part"])):
        roles, text = out.get(r["conv_id"], ([], ""))
        out[r["conv_id"]] = (roles + r["roles"], text + r["rendered"])
    return out


def test_long_conversations_stay_in_order(spark, model):
    """300 turns and 600 rows of one id are one row each, in the order of turn and text, repeats kept."""
    roles = ["user", "assistant"]
    rows = [(4, i, roles[i % 2], f"turn {i}.") for i in range(300)]
    rows += [(8, 0, "user", f"same turn {i:03}") for i in range(597)] + [(8, 0, "user", "same turn 005")] * 3
    raw = chat.transcripts(chat.parts(spark, spark.createDataFrame(rows, SCHEMA)))
    got = {r["conv_id"]: r for r in chat.format_transcripts(spark, raw, model).collect()}
    assert got[4]["roles"] == roles * 150 and got[4]["part"] == 0 and not got[4]["continued"]
    assert got[4]["rendered"] == "".join(f"<|{roles[i % 2]}|>\nturn {i}.\n<|end|>\n" for i in range(300))
    assert got[8]["roles"] == ["user"] * 600
    assert [line[-3:] for line in got[8]["rendered"].split("\n") if line.startswith("same")] == sorted(
        [f"{i:03}" for i in range(597)] + ["005"] * 3)


@pytest.mark.parametrize("part,fan", [(7, 4), (50, 256), (1, 3)])
def test_parts_equal_the_whole(spark, model, part, fan, monkeypatch):
    """However a conversation is cut, its parts' roles and rendering are the whole transcript's."""
    rnd = random.Random(part)
    monkeypatch.setattr(chat, "ROWS_A_TASK", 40)
    rows = [(c, rnd.randrange(60) if c % 2 else i, rnd.choice(["user", "assistant", "system", None]),
             rnd.choice([None, "", "\n", "Well\nindeed.", "why?\n\n", f"text {i}", "User: not me", "x " * 3000]))
            for c in range(9) for i in range(rnd.randrange(1, 130))]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = chat.parts(spark, df, part=part).persist()
    turns = {}
    for r in sorted(cut.collect(), key=lambda r: (r["conv_id"], r["part"])):
        assert r["before"] == len(turns.setdefault(r["conv_id"], []))
        turns[r["conv_id"]] += [(t["turn"], t["text"], t["role"]) for t in r["turns"]]
    def nulls_first(row):
        return tuple((x is not None, x) for x in row)
    for c, got in turns.items():
        assert got == sorted(((t, x, role) for i, t, role, x in rows if i == c), key=nulls_first)
    raw = chat.transcripts(cut)
    texts = {}
    for r in sorted(raw.collect(), key=lambda r: (r["conv_id"], r["part"])):
        texts.setdefault(r["conv_id"], []).append(r["text"])
    got = joined(chat.format_transcripts(spark, raw, model, fan=fan).collect())
    for c, pieces in texts.items():
        whole = chat.parse(model, "\n".join(pieces))
        assert got[c] == ([role for role, _ in whole], chat.render(whole))


def test_borders_against_whole_transcript(model):
    """Lines cut anywhere, also inside turns and at blank lines."""
    rnd = random.Random(3)
    for _ in range(200):
        lines = [rnd.choice(["", "User: a?", "more", "  code", "Bot: well.", "", "Note: x", "q?", "Assistant:"])
                 for _ in range(rnd.randrange(1, 30))]
        cuts = sorted(rnd.sample(range(1, len(lines)), min(len(lines) - 1, rnd.randrange(5))))
        pieces = ["\n".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
        found = chat.borders(model, [chat.summarise(model, p) for p in pieces])
        text = "".join(chat.render(chat.parse(model, p, b), b) for p, b in zip(pieces, found, strict=True))
        assert text == chat.render(chat.parse(model, "\n".join(lines)))


def test_hot_conversation_is_spread(spark, monkeypatch):
    """A conversation of any size is cut into parts of bounded size; repeats of one row are split too."""
    rows = [(1, i, "user", f"t{i}") for i in range(900)] + [(2, 0, "user", "again")] * 500
    rows += [(None, i, "user", "x") for i in range(30)] + [(None, 0, "user", "x")] * 5
    monkeypatch.setattr(chat, "ROWS_A_TASK", 100)
    got = chat.parts(spark, spark.createDataFrame(rows, SCHEMA), part=64).collect()
    assert sum(len(r["turns"]) for r in got) == len(rows)
    assert max(len(r["turns"]) for r in got) <= 2 * 64
    assert [len(r["turns"]) for r in got if r["conv_id"] is None] == [1] * 35
    assert len([r for r in got if r["conv_id"] == 1]) == 15


def test_hard_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "<|end|>"),
                                (None, None, None, None), (2, 0, "user", "word and " * 200_000)], SCHEMA)
    df = df.selectExpr("*", "1 AS part", "2 AS task", "3 AS n", "4 AS weight", "5 AS copies", "6 AS turns", "7 AS gap")
    parts = chat.parts(spark, df)
    model = chat.train(spark, parts)
    got = chat.format_transcripts(spark, chat.transcripts(parts), model).collect()
    assert sorted((r["conv_id"] or 0) for r in got) == [0, 1, 2]
    assert next(r for r in got if r["conv_id"] == 2)["rendered"].count("word") == 200_000
    none = chat.parts(spark, df.where("false"))
    model = chat.train(spark, none)
    assert chat.format_transcripts(spark, chat.transcripts(none), model).count() == 0


def test_whole_table(spark):
    got = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.01").collect()
    assert {r["conv_id"] for r in got} == {r["conv_id"] for r in spark.read.parquet(TABLE).collect()}
