"""Token counts (operator 4): byte-pair merging with a heap and a linked list.

The count of a text is its initial symbols minus the merges done; no token
identifiers are produced.  The merge table is the piece list of a published
tokenizer file whose path is a parameter; the driver reads it once and
broadcasts it (its size is fixed by the vocabulary: 32,000 pieces).

Exactness: a merge of neighbouring characters ``x y`` needs a piece that
contains ``xy``.  Where no piece does, the text can be cut without changing
any merge; so each text is cut at spaces and then at such impossible pairs,
and the counts of the short chunks are kept in a bounded memo per worker.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE = "▁"  # the piece alphabet's sign for a space
#: Entries of the per-worker memo; it is emptied when full, which changes no count.
MEMO_ENTRIES = 400_000
LIMIT = 4096


def merge_table(model_path: str) -> dict[str, float]:
    """Score of every mergeable piece (control, unknown and byte pieces left out)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.encode(" a ", out_type=str)[0] != SPACE or "".join(sp.encode("ﬁ", out_type=str)) != SPACE + "ﬁ":
        raise ValueError("only models without text normalisation and with a dummy leading space are supported")
    ids = range(sp.get_piece_size())
    return {sp.id_to_piece(i): sp.get_score(i) for i in ids
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class PairMerger:
    """Counts tokens of whole texts for one merge table."""

    def __init__(self, scores: dict[str, float], memo_entries: int = MEMO_ENTRIES):
        self.scores = scores
        self.joins = frozenset(p[i:i + 2] for p in scores for i in range(len(p) - 1))
        self.memo_entries = memo_entries
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Symbols left after merging; a symbol outside the table counts as its bytes."""
        scores, n = self.scores, len(chunk)
        if n == 1 or chunk in scores and n == 2:
            return 1 if chunk in scores else len(chunk.encode())
        piece = list(chunk)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            s = scores.get(chunk[i:i + 2])
            if s is not None:
                heap.append((-s, i, i + 1, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, size = heapq.heappop(heap)
            # stale if either side was merged away or has grown since
            if piece[i] is None or piece[j] is None or after[i] != j or len(piece[i]) + len(piece[j]) != size:
                continue
            piece[i] += piece[j]
            piece[j] = None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                s = scores.get(piece[i] + piece[k])
                if s is not None:
                    heapq.heappush(heap, (-s, i, k, size + len(piece[k])))
            h = before[i]
            if h >= 0:
                s = scores.get(piece[h] + piece[i])
                if s is not None:
                    heapq.heappush(heap, (-s, h, i, len(piece[h]) + size))
        extra = sum(len(p.encode()) - 1 for p in piece if p is not None and p not in scores)
        return n - merges + extra

    def word(self, word: str) -> int:
        """Tokens of one word (a run without cuts at spaces), through the memo."""
        joins, chunks, total, start = self.joins, self.chunks, 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1:i + 1] not in joins:
                chunk = word[start:i]
                n = chunks.get(chunk)
                if n is None:
                    n = self.merged(chunk)
                    if len(chunk) <= 32:
                        if len(chunks) >= self.memo_entries:
                            chunks.clear()
                        chunks[chunk] = n
                total += n
                start = i
        return total

    def count(self, text: str) -> int:
        """Tokens of a text: a leading space is put before it, an empty one has none."""
        if not text:
            return 0
        words, memo, total = text.split(" "), self.words, 0
        if "" in words or SPACE in text:  # runs of spaces may merge with each other
            marked = SPACE + text.replace(" ", SPACE)
            parts, start = [], 0
            for i in range(1, len(marked)):
                if marked[i] == SPACE and marked[i - 1] != SPACE:
                    parts.append(marked[start:i])
                    start = i
            parts.append(marked[start:])
            return sum(self._known(p, memo) * k for p, k in Counter(parts).items())
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(memo) >= self.memo_entries:
                    memo.clear()
                if len(w) <= 32:
                    memo[w] = n
            total += n
        return total

    def _known(self, marked: str, memo: dict[str, int]) -> int:
        n = memo.get(marked[1:]) if marked[0] == SPACE and SPACE not in marked[1:] else None
        return self.word(marked) if n is None else n


_WORKER: dict[str, PairMerger] = {}  # one merger (and memo) per worker process


def _merger(name: str, scores: Broadcast) -> PairMerger:
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = PairMerger(scores.value)
    return _WORKER[name]


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit of every whole text.

    A null text counts as empty (0 bytes, 0 tokens).  One narrow pass, no
    shuffle; a task holds one Arrow batch, the merge table and its memos.
    """
    table = merge_table(model_path)
    name = hashlib.sha1(repr(sorted(table.items())).encode()).hexdigest()
    scores = spark.sparkContext.broadcast(table)
    src = docs.select(*[f"`{c}`" for c in keep], docs[f"`{text}`"].alias("__text"))
    out = T.StructType([*[src.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(name, scores)
        for b in batches:
            texts = b.column("__text")
            sizes, counts = [], []
            for t in texts:
                s = t.as_py() or ""
                sizes.append(len(s.encode()))
                counts.append(merger.count(s))
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, out)
