"""Chat formatting (operator 9): roles from raw transcripts by a hidden Markov model.

A transcript is plain text; who speaks must be read off speaker markers
("User:", "Q:", "**AI**:"), blank lines and the look of the lines, and markers
may be missing.  States are role x (first line of a turn, further line); a
line's observations are its marker class, whether a blank line precedes it,
its length class, its last and first character classes.  Viterbi finds the
likeliest states; turns are then rendered canonically.

Transition and emission counts come from labelled turns, as one grouped count
in Spark over the first ``TRAINING_TURNS`` turns of at most ``MAX_TRAINING``
labelled conversations (those with the smallest hashes, a bounded repeatable
sample).  Emissions of a state are smoothed by one count spread like the first
(or further) lines of all roles (markers that name another role: ``MISNAMED`` of
it), moves by one each.

A conversation is ordered by (turn, text, role) and is one row (part 0) up to
``PART`` turns and KiB of text; a longer one comes in parts, cut by order.  All
parts are decoded as one sequence: a part is summarised by the best score from
each state of its first line to each of its last, the summaries are put together in groups of
``FAN``, level by level, and the likeliest path's states at the borders go back to
the parts.  ``rendered`` and ``roles`` of the parts, joined in order, are the
conversation's; ``continued`` tells that a part begins inside a turn.  Part
numbers rise but may skip.

Defined results: a null or blank transcript has no turns; a null text is an
empty turn, rendered without text, and a null role an unmarked one; rows that
repeat are turns of their own, next to each other; turns without a number come
first; rows without a conversation id are conversations of one turn; an empty
table gives no rows.  Other columns of the table, whatever their names, are not
read.  White space at the end of lines and lines without text are dropped.
Text that looks like a turn tag (``<|``) is rendered as ``< |``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.tables import kept

ROLES = ("system", "user", "assistant")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
FEATURES = ("marker", "gap", "length", "last", "begins")
PART = 16_384
FAN = 256
ROWS_A_TASK = 200_000
MAX_TRAINING = 2000
TRAINING_TURNS = 64
MISNAMED = 1e-4

# Speaker names and the class of their marker.
SPEAKERS = {
    "system": "system", "sys": "system", "context": "system", "instructions": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "prompt": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "a": "assistant", "answer": "assistant", "bot": "assistant",
    "model": "assistant", "agent": "assistant", "response": "assistant",
}
_MARKER = re.compile(r"^\s*(?:\*\*|\[|<|#+\s*)?([A-Za-z]{1,12})(?:\*\*|\]|>)?\s*:(?:\*\*)?\s?")

#: How transcripts are written: marker per role, and whether every second turn goes without one.
STYLES = (
    ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, False),
    ({"system": "[Context]: ", "user": "[Human]: ", "assistant": "[AI]: "}, False),
    ({"system": "", "user": "Q: ", "assistant": "A: "}, False),
    ({"system": "**System**: ", "user": "**User**: ", "assistant": "**Bot**: "}, True),
)


def marker(line: str) -> tuple[str, str]:
    """(class, line without its marker); a name that no list holds is ``other``."""
    m = _MARKER.match(line)
    if not m:
        return "none", line
    kind = SPEAKERS.get(m[1].lower())
    return (kind, line[m.end():]) if kind else ("other", line)


def observe(lines: list[str], gap: str = "start") -> list[tuple[tuple[str, ...], str]]:
    """(observations, text without marker) of every line that is not blank; ``gap`` is what comes before."""
    out = []
    for line in lines:
        if not line.strip():
            gap = "blank" if gap != "start" else gap
            continue
        kind, rest = marker(line)
        n = len(rest.split())
        end = rest.rstrip()[-1:]
        first = rest.lstrip()[:1]
        out.append(((kind, gap, str(min(4, n.bit_length())) if n < 32 else "5",
                     end if end in "?!.:," else "other",
                     "upper" if first.isupper() else "lower" if first.islower() else "digit" if first.isdigit()
                     else "sign"), rest))
        gap = "none"
    return out


@dataclass(frozen=True)
class Model:
    start: np.ndarray       # log probabilities over STATES
    move: np.ndarray        # from, to
    emit: list[dict[str, np.ndarray]]  # per feature: value -> log probabilities; "" stands for unseen values

    def score(self, seen: list[tuple[str, ...]]) -> np.ndarray:
        return np.array([sum(e.get(v, e[""]) for e, v in zip(self.emit, o, strict=True)) for o in seen])


def fit(counts: dict[tuple[str, str, int], int]) -> Model:
    """Model from counts keyed (kind, value, state): kinds ``start``, ``move`` (value: state before) and FEATURES."""
    n = len(STATES)
    start, move = np.ones(n), np.ones((n, n))
    values: list[dict[str, np.ndarray]] = [{} for _ in FEATURES]
    for (kind, value, state), c in counts.items():
        if kind == "start":
            start[state] += c
        elif kind == "move":
            move[int(value), state] += c
        else:
            values[FEATURES.index(kind)].setdefault(value, np.zeros(n))[state] += c
    for i, (role, _) in enumerate(STATES):  # a further line follows a line of its own role
        for j, (to, first) in enumerate(STATES):
            if not first and to != role:
                move[i, j] = 0
    start[[j for j, (_, first) in enumerate(STATES) if not first]] = 0
    emit = []
    firsts = np.array([first for _, first in STATES])
    for feature, v in zip(FEATURES, values, strict=True):
        # a rare role is smoothed towards what first (or further) lines of all roles look like
        total = sum(v.values(), np.zeros(n))
        every = np.array([total[firsts == f].sum() for f in firsts]) + len(v) / 2
        table = {"": np.zeros(n)}  # a value that no training line has tells nothing
        for k, x in v.items():
            pooled = np.array([x[firsts == f].sum() + 0.5 for f in firsts]) / every
            if feature == "marker" and k in ROLES:  # a marker that names another role is no sign of this one
                pooled *= [1 if role == k else MISNAMED for role, _ in STATES]
            table[k] = np.log((x + pooled) / (total + 1))
        emit.append(table)
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), emit)


def viterbi(model: Model, seen: list[tuple[str, ...]], first: int | None = None, last: int | None = None) -> list[int]:
    """Likeliest state of every line (ties: the first state), from and to the given states if any."""
    if not seen:
        return []
    emit = model.score(seen)
    best, back = model.start + emit[0], np.zeros((len(seen), len(STATES)), np.int8)
    if first is not None:
        best = _only(first)
    for t in range(1, len(seen)):
        paths = best[:, None] + model.move
        back[t] = paths.argmax(axis=0)
        best = paths.max(axis=0) + emit[t]
    out = [int(best.argmax()) if last is None else last]
    for t in range(len(seen) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return out[::-1]


def _only(state: int) -> np.ndarray:
    return np.where(np.arange(len(STATES)) == state, 0.0, -np.inf)


@dataclass(frozen=True)
class Border:
    """What the rest of a conversation decides about a part: gap before it, states of its first and last line,
    and whether its last turn goes on."""

    gap: str
    first: int
    last: int
    open: bool

    @property
    def continued(self) -> bool:
        return not STATES[self.first][1]


def parse(model: Model, text: str | None, border: Border | None = None) -> list[tuple[str, str]]:
    """(role, text) turns of a transcript, or of a part of one (the first may belong to a turn begun before)."""
    lines = (text or "").split("\n")
    seen = observe(lines, border.gap) if border else observe(lines)
    found = [o for o, _ in seen]
    path = viterbi(model, found, border.first, border.last) if border else viterbi(model, found)
    turns: list[tuple[str, list[str]]] = []
    for state, (_, rest) in zip(path, seen, strict=True):
        role, first = STATES[state]
        if first or not turns:
            turns.append((role, []))
        if rest.strip():
            turns[-1][1].append(rest.strip() if first else rest.rstrip())
    return [(role, "\n".join(lines)) for role, lines in turns]


def render(turns: list[tuple[str, str]], border: Border | None = None) -> str:
    out = []
    for k, (role, text) in enumerate(turns):
        if k or not (border and border.continued):
            out.append(f"<|{role}|>\n")
        if text:
            out.append(text.replace("<|", "< |") + "\n")
        if k < len(turns) - 1 or not (border and border.open):
            out.append("<|end|>\n")
    return "".join(out)


@dataclass(frozen=True)
class Summary:
    """A part, or several in a row, as the rest of the conversation sees it."""

    lines: int                  # lines that are not blank
    seen: tuple[str, ...]       # observations of the first of them; its gap depends on what comes before
    lead: bool                  # blank lines before the first
    trail: bool                 # blank lines after the last
    path: np.ndarray | None     # best score from each state of the first line to each of the last


EMPTY = Summary(0, (), True, True, None)


def summarise(model: Model, text: str | None) -> Summary:
    lines = (text or "").split("\n")
    seen = [o for o, _ in observe(lines, "none")]
    if not seen:
        return EMPTY
    path = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
    for emit in model.score(seen)[1:]:
        path = _through(path, model.move) + emit
    return Summary(len(seen), seen[0], seen[0][1] == "blank", not lines[-1].strip(), path)


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores over two steps in a row."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _entered(model: Model, s: Summary, gap: str) -> np.ndarray:
    """Scores of the first line's observations, given the gap before."""
    if gap != "start" and s.lead:
        gap = "blank"
    return model.score([(s.seen[0], gap, *s.seen[2:])])[0]


def _after(s: Summary, gap: str) -> str:
    if s.lines:
        return "blank" if s.trail else "none"
    return gap if gap == "start" else "blank"


def compose(model: Model, parts: list[Summary]) -> Summary:
    """The summary of parts in a row."""
    head, path, gap, lead = None, None, "none", False
    for s in parts:
        if s.lines and head is None:
            head, path = s, s.path
            lead = lead or s.lead
        elif s.lines:
            path = _through(_through(path, model.move) + _entered(model, s, gap), s.path)
        elif head is None:
            lead = True
        gap = _after(s, gap)
    if head is None:
        return EMPTY
    return Summary(sum(s.lines for s in parts), head.seen, lead, gap == "blank", path)


def borders(model: Model, parts: list[Summary], whole: Border | None = None) -> list[Border | None]:
    """The likeliest path's border of each part (None: a part without lines), inside that of the ``whole``."""
    gap = whole.gap if whole else "start"
    ends, live = None, []
    for k, s in enumerate(parts):
        if s.lines:
            if ends is not None:
                entry = (ends[:, None] + model.move).max(axis=0) + _entered(model, s, gap)
            else:
                entry = _only(whole.first) if whole else model.start + _entered(model, s, gap)
            live.append((k, gap, entry, ends))
            ends = (entry[:, None] + s.path).max(axis=0)
        gap = _after(s, gap)
    out: list[Border | None] = [None] * len(parts)
    if not live:
        return out
    last, goes_on = (whole.last, whole.open) if whole else (int(ends.argmax()), False)
    for k, gap, entry, before in reversed(live):
        first = int((entry + parts[k].path[:, last]).argmax())
        out[k] = Border(gap, first, last, goes_on)
        if before is not None:
            last, goes_on = int((before + model.move[:, first]).argmax()), out[k].continued
    return out


def write_transcript(turns: list[tuple[str | None, str | None]], style: int,
                     before: int = 0) -> list[tuple[str, int | None]]:
    """Lines of a raw transcript and their states (None: blank, or no role); ``before`` turns come earlier."""
    marks, gappy = STYLES[style % len(STYLES)]
    out: list[tuple[str, int | None]] = []
    for i, (role, text) in enumerate(turns, before):
        mark = marks.get(role or "", "")
        if gappy and i % 2:
            mark = ""
        if i and (not mark or gappy):
            out.append(("", None))
        for k, line in enumerate((text or "").split("\n")):
            known = role in ROLES and (line.strip() or k == 0 and mark)
            out.append(((mark if k == 0 else "") + line, STATES.index((role, k == 0)) if known else None))
    return out


def _counted(lines: list[tuple[str, int | None]]) -> Counter:
    """Training counts of one labelled transcript."""
    states = [s for line, s in lines if line.strip()]
    out: Counter = Counter()
    before = None
    for (seen, _), state in zip(observe([line for line, _ in lines]), states, strict=True):
        if state is not None:
            out[("start", "", state) if before is None else ("move", str(before), state)] += 1
            for kind, value in zip(FEATURES, seen, strict=True):
                out[(kind, value, state)] += 1
        before = state
    return out


def parts(spark: SparkSession, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
          role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """(conv_id, part, before, turns): turns in order, ``before`` of them in earlier parts.

    Repeated rows are counted first.  Rows are sorted by range, so a conversation
    of any size is spread over tasks; each task adds its sizes up and the
    sums of earlier tasks (at most one row a task) give a row's place.
    """
    order = ["conv_id", "turn", "text", "role"]
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.col(f"`{text}`").alias("text"), F.col(f"`{role}`").alias("role"))
    rows = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1) + F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 1024)
    rows = rows.withColumn("weight", weight.cast("long"))
    rows = rows.withColumn("most", F.greatest(F.lit(1), F.floor(part / F.col("weight"))).cast("long"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most")))))
    rows = rows.select(*order, "weight", "chunk", F.least("most", F.col("n") - F.col("chunk") * F.col("most")).alias("copies"))
    rows = kept(spark, rows, "turns")
    tasks = max(1, -(-rows.count() // ROWS_A_TASK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        now, size, turns = None, 0, 0
        for b in batches:
            sizes, counts = [], []
            for c, w, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "weight", "copies")), strict=True):
                if c != now:
                    now, size, turns = c, 0, 0
                sizes.append(size)
                counts.append(turns)
                size, turns = size + w * n, turns + n
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([task] * len(sizes), pa.int32()), pa.array(sizes, pa.int64()),
                 pa.array(counts, pa.int64())], names=[*b.schema.names, "task", "size", "earlier"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = (rows.where("conv_id IS NOT NULL").repartitionByRange(tasks, *order, "chunk")
              .sortWithinPartitions(*order, "chunk")
              .mapInArrow(place, f"conv_id {kind}, turn long, text string, role string, weight long, chunk long, "
                                 "copies long, task int, size long, earlier long"))
    placed = kept(spark, placed, "placed")
    sums = placed.groupBy("conv_id", "task").agg(F.sum(F.col("weight") * F.col("copies")).alias("size0"),
                                                 F.sum("copies").alias("earlier0"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "task", F.sum("size0").over(before).alias("size0"),
                          F.sum("earlier0").over(before).alias("earlier0")).where("size0 IS NOT NULL")
    one = F.struct("turn", "text", "role")
    copies = F.col("copies").cast("int")
    ordered = (placed.join(F.broadcast(carried), ["conv_id", "task"], "left")
               .withColumns({"part": F.floor((F.col("size") + F.coalesce("size0", F.lit(0))) / part),
                             "before": F.col("earlier") + F.coalesce("earlier0", F.lit(0))})
               .groupBy("conv_id", "part")
               .agg(F.min("before").alias("before"),
                    F.sort_array(F.collect_list(F.struct("turn", "text", "role", "chunk", copies.alias("copies")))).alias("turns"))
               .withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(
                   F.struct(t["turn"], t["text"], t["role"]), t["copies"])))))
    alone = rows.where("conv_id IS NULL").withColumn("turns", F.explode(F.array_repeat(F.array(one), copies)))
    zero = F.lit(0).cast("long")
    return ordered.unionByName(alone.select("conv_id", zero.alias("part"), zero.alias("before"), "turns"))


def _lines(turns: list[dict], conv_id, before: int = 0) -> list[tuple[str, int | None]]:
    style = hash(conv_id) if isinstance(conv_id, int) else len(str(conv_id))
    return write_transcript([(t["role"], t["text"]) for t in turns], style, before)


def train(spark: SparkSession, labelled: DataFrame, max_transcripts: int = MAX_TRAINING,
          max_turns: int = TRAINING_TURNS) -> Model:
    """Fit on the first ``max_turns`` turns of at most ``max_transcripts`` conversations of :func:`parts`."""
    sample = (labelled.where("part = 0").select("conv_id", F.slice("turns", 1, max_turns).alias("turns"))
              .orderBy(F.xxhash64("conv_id"), "conv_id", "turns").limit(max_transcripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for r in b.to_pylist():
                total.update(_counted(_lines(r["turns"], r["conv_id"])))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
            names=["kind", "value", "state", "n"])

    counts = sample.mapInArrow(run, "kind string, value string, state int, n long") \
        .groupBy("kind", "value", "state").agg(F.sum("n").alias("n"))
    return fit({(r["kind"], r["value"], r["state"]): r["n"] for r in counts.collect()})


def transcripts(ordered: DataFrame) -> DataFrame:
    """(conv_id, part, text): raw transcripts of :func:`parts`, in several marker styles, to be joined by line feeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(line for line, _ in _lines(r["turns"], r["conv_id"], r["before"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(texts, pa.string())],
                                             names=["conv_id", "part", "text"])

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, part long, text string")


def _summaries(spark: SparkSession, raw: DataFrame, sent, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [summarise(sent.value, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pandas(_frame(b.column("conv_id").to_pylist(), b.column("part").to_pylist(), found),
                                             schema=_arrow(b.schema.field("conv_id").type), preserve_index=False)

    return kept(spark, raw.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}"), "summaries")


_SUMMARY = "part long, lines long, seen array<string>, lead boolean, trail boolean, path array<double>"


def _arrow(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind), ("part", pa.int64()), ("lines", pa.int64()), ("seen", pa.list_(pa.string())),
                      ("lead", pa.bool_()), ("trail", pa.bool_()), ("path", pa.list_(pa.float64()))])


def _frame(ids: list, numbers: list, found: list[Summary]) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": ids, "part": numbers, "lines": [s.lines for s in found],
                         "seen": [list(s.seen) for s in found], "lead": [s.lead for s in found],
                         "trail": [s.trail for s in found],
                         "path": [[] if s.path is None else s.path.ravel().tolist() for s in found]})


def _read(frame: pd.DataFrame) -> list[Summary]:
    n = len(STATES)
    return [Summary(int(r.lines), tuple(r.seen), bool(r.lead), bool(r.trail), np.array(r.path).reshape(n, n))
            if r.lines else EMPTY for r in frame.itertuples()]


def seams(spark: SparkSession, raw: DataFrame, sent, fan: int = FAN) -> DataFrame:
    """(conv_id, part, gap, first, last, open) of every part with lines, for conversations of several parts."""
    kind = raw.schema["conv_id"].dataType.simpleString()
    levels = [_summaries(spark, raw, sent, kind)]

    def up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _frame([key[0]], [key[1]], [compose(sent.value, _read(frame.sort_values("part")))])

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        r = frame.iloc[0]
        whole = None if pd.isna(r["gap"]) else Border(r["gap"], int(r["first"]), int(r["last"]), bool(r["open"]))
        found = borders(sent.value, _read(frame), whole)
        rows = [(c, p, b.gap, b.first, b.last, b.open)
                for c, p, b in zip(frame["conv_id"], frame["part"], found, strict=True) if b]
        return pd.DataFrame(rows, columns=["conv_id", "part", "gap", "first", "last", "open"])

    above = F.floor(F.col("part") / fan)
    while (levels[-1].agg(F.max("part")).first()[0] or 0) >= fan:
        nodes = levels[-1].groupBy("conv_id", above.alias("above")).applyInPandas(up, f"conv_id {kind}, {_SUMMARY}")
        levels.append(kept(spark, nodes, "summaries"))
    shape = f"conv_id {kind}, part long, gap string, first int, last int, open boolean"
    solved = spark.createDataFrame([], shape)
    for k, level in enumerate(reversed(levels)):
        found = solved.withColumnRenamed("part", "above")
        # the topmost level has one group a conversation and nothing above
        how = "left" if k == 0 else "inner"
        nodes = level.withColumn("above", above).join(found, ["conv_id", "above"], how)
        solved = kept(spark, nodes.groupBy("conv_id", "above").applyInPandas(down, shape), "seams")
    return solved


def format_transcripts(spark: SparkSession, raw: DataFrame, model: Model, fan: int = FAN) -> DataFrame:
    """(conv_id, part, continued, n_turns, roles, rendered) of raw (conv_id, part, text).

    ``raw`` is read several times, so it should be a written table.  Rows with
    part 0 only are transcripts of their own; where a conversation has several
    parts, its part numbers must differ.
    """
    sent = spark.sparkContext.broadcast(model)
    raw = raw.select("conv_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "text")
    several = raw.where("part > 0").select("conv_id").distinct()
    solved = seams(spark, raw.join(several, "conv_id", "left_semi"), sent, fan)
    kind = raw.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in b.to_pylist():
                border = None if r["gap"] is None else Border(r["gap"], r["first"], r["last"], r["open"])
                found.append((border, parse(sent.value, r["text"], border)))
            on = [bool(border and border.continued) for border, _ in found]
            roles = [[role for role, _ in turns][int(c):] for c, (_, turns) in zip(on, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("part"), pa.array(on, pa.bool_()),
                 pa.array([len(r) for r in roles], pa.int64()), pa.array(roles, pa.list_(pa.string())),
                 pa.array([render(turns, border) for border, turns in found], pa.string())],
                names=["conv_id", "part", "continued", "n_turns", "roles", "rendered"])

    return raw.join(solved, ["conv_id", "part"], "left").mapInArrow(
        run, f"conv_id {kind}, part long, continued boolean, n_turns long, roles array<string>, rendered string")
