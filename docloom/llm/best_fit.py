"""Best-fit-decreasing packing of the whole corpus into sequences of at most LENGTH tokens.

Which sequence a piece goes to depends on the lengths alone, and there are only LENGTH different ones.  So the packing is planned
for all pieces of the corpus at once from their histogram, however many there are: lengths fall, and a segment tree over
the remaining capacities (its leaves count the open sequences by what they have left) gives the tightest one that still
fits, in logarithmic time.  Sequences that were filled alike are a run and take their pieces together, as many to each as
best fit would give it one after another; a run is split only where a length's pieces end, so runs and steps are bounded by
LENGTH and not by the corpus.  The result is what packing piece by piece would give.

Tasks tokenise a text once, cut what is longer than LENGTH and number the pieces of each length in their own order; the
counts by task and length are summed to each task's first number, and a piece finds its sequence and place in the
plan by its number.  No text is sorted or moved, no key is hot.

Words are tokenised once a worker: the tokenizer drops white space and never looks across it, so what stands between
blanks is looked up, in memory of a fixed size, and given to the tokenizer where it is new.

Defined cases: null text is empty and gives just the end id; texts of any length are taken whole; repeated rows are
packed one by one, also those without a doc_id; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, materialize

END_ID = 0
LENGTH = 2048
#: Entries of a worker's memory of words in each of its two halves (some 150 bytes each), and the longest word it takes.
REMEMBERED, LONGEST = 1 << 19, 64
#: Pieces sent on at once.
HELD = 512
TOKENIZER = "word_bpe_49k.json"
#: Signs behind a letter at a word's end: no token goes over that place (but for special tokens), so the word before is looked up by itself.
TAIL = re.compile(rb"(?<=[a-z])[^A-Za-z'\x80-\xff]+\Z")


# -- the plan --


class Capacities:
    """A segment tree over remaining capacities 0 to `size`: counts of open sequences, and the tightest that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        at = self.leaves + capacity
        while at:
            self.total[at] += count
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open sequence has."""
        at = self.leaves + least
        if not self.total[at]:
            # up to the first right sibling with something in it, then down its left side
            while at > 1 and (at & 1 or not self.total[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.total[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(histogram: dict[int, int], size: int = LENGTH) -> tuple[dict[int, np.ndarray], int]:
    """(steps, sequences): for each length its steps (first piece, first sequence, pieces to a sequence, offset), pieces
    numbered from 0 in each length, and how many sequences there are."""
    open_, runs, steps, made = Capacities(size), {}, {}, 0

    def leave(capacity: int, first: int, count: int) -> None:
        if count:
            runs.setdefault(capacity, []).append((first, count))
            open_.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        left, rows = histogram[length], []
        while left:
            room = open_.tightest(length)
            if room is None:
                room, each = size, size // length
                first, count = made, -(-left // each)
                made += count
            else:
                first, count = runs[room].pop()
                open_.add(room, -count)
            each = room // length
            taken = min(left, count * each)
            rows.append((histogram[length] - left, first, each, size - room))
            left -= taken
            full, rest = divmod(taken, each)
            leave(room - each * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + (rest > 0), count - full - (rest > 0))
        steps[length] = np.array(rows, np.int64).reshape(-1, 4)
    return steps, made


# -- tokens --


@lru_cache(maxsize=1)
def _tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(TOKENIZER))


class Words(dict):
    """What the tokenizer makes of what stands between blanks, as little-endian 16-bit ids; the older half is dropped when full."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found, tail = self.older.get(word), TAIL.search(word) if b"<|" not in word else None
        if found is None and tail:
            found = self[word[: tail.start()]] + self[tail[0]]
        elif found is None:
            found = np.array(_tokenizer().encode(word.decode(errors="replace"), add_special_tokens=False).ids, "<u2").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _words() -> Words:
    """One memory for all tasks that a worker runs."""
    return Words()


_END = np.array([END_ID], "<u2").tobytes()


def token_ids(text: bytes, words: Words) -> np.ndarray:
    """The ids of a UTF-8 text, then the end id.  The tokenizer lowers case itself, but knows special tokens by theirs."""
    parts = (text if b"<|" in text else text.lower()).split()
    return np.frombuffer(b"".join([*map(words.__getitem__, parts), _END]), "<u2")


_TOKENS = "doc_id bigint, piece int, start bigint, length int, part int, number bigint, ids binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _TOKENS.split(", ")])


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, seen, part, out = _words(), [0] * (LENGTH + 1), TaskContext.get().partitionId(), []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = token_ids(text.as_py() or b"", words)
            for piece, start in enumerate(range(0, len(ids), LENGTH)):
                cut = ids[start : start + LENGTH]
                n = len(cut)
                out.append((doc_id, piece, start, n, part, seen[n], cut.tobytes()))
                seen[n] += 1
                if len(out) >= HELD:
                    yield _pieces(out)
                    out = []
    yield _pieces(out)


# -- Spark --


def _placed(steps: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                of = np.flatnonzero(length == n)
                first, run, each, begin = steps[n].T
                at = np.searchsorted(first, number[of], side="right") - 1
                nth = number[of] - first[at]
                sequence[of] = run[at] + nth // each[at]
                offset[of] = begin[at] + nth % each[at] * n
            for k in range(0, batch.num_rows, HELD):
                part = batch.slice(k, HELD)
                wide = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in part.column("ids")]
                columns = [part.column(c) for c in ("doc_id", "piece", "start")]
                columns += [part.column("length").cast(pa.int64()), pa.array(sequence[k : k + HELD]), pa.array(offset[k : k + HELD]), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, sequence_id, offset, and the piece's ids as little-endian
    32-bit numbers.  Only documents of more than LENGTH tokens are cut."""
    rows = docs.select("doc_id", F.col(text).cast("string").cast("binary").alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenised, _TOKENS), "tokens")
    counts = materialize(tokens.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    steps, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    firsts = F.broadcast(firsts) if counts.count() <= broadcast_rows else firsts
    numbered = tokens.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", (F.col("number") + F.col("first")).alias("number"), "ids")
    schema = "doc_id bigint, piece int, start bigint, length bigint, sequence_id bigint, offset bigint, ids binary"
    return numbered.mapInArrow(_placed(steps), schema)
