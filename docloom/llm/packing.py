"""Packing documents into fixed-length sequences along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to few dimensions and the place of the
result on a Hilbert curve is its key.  The corpus is range-sorted by (key, doc_id) and every range lays its
documents end to end, cutting freely at each full sequence: neighbours on the curve share sequences and only
the last sequence of a range is short.  Ranges hold some four million tokens, so padding is a few in ten thousand;
there are at most MAX_RANGES of them, larger beyond that, so that the driver never holds more than their bounds and
Spark's sample for them (at most a million rows of three numbers).

Ids travel once, as two bytes each, and are written before the range sort, so texts are tokenised once.

Defined cases: null text is empty and gives just the end id; texts of any length or content, long runs of blanks
included, are tokenised as the defining tokenizer does; repeated rows are packed one by one; ties of the key
are ordered by doc_id; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

END_ID = 1
LENGTH = 2048
RANGE_TOKENS, MAX_RANGES = 1 << 22, 20_000
#: Pieces sent on at once.
HELD = 512
#: Buckets of the hashed vector, dimensions and bits a dimension of the curve.
BUCKETS, DIMS, BITS = 256, 4, 12
SEED = 20
#: What only the defining tokenizer takes: code points on which the fast one wasn't compared with it, the special
#: token, and long runs of white space, over which the fast one's pattern recurses once a character.
UNUSUAL, SPECIAL = re.compile("[^\x00-ɏ]"), "<|endoftext|>"
RUN = 4096
LONG_RUN = re.compile(rf"\s{{{RUN}}}")


def _exact_only(text: str) -> bool:
    return bool(UNUSUAL.search(text)) or SPECIAL in text or len(text) >= RUN and bool(LONG_RUN.search(text))
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


@lru_cache(maxsize=1)
def _fast() -> Callable[[str], list[int]]:
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=1)
def _exact():
    """The defining tokenizer; only loaded where a text needs it."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def token_ids(text: str | None) -> np.ndarray:
    """uint16 ids of the text, then the end id.

    Both encoders hold one vocabulary and pattern; see _exact_only for what the fast one doesn't take.
    """
    t = text or ""
    ids = _exact().encode(t, add_special_tokens=False).ids if _exact_only(t) else _fast()(t)
    ids.append(END_ID)
    return np.array(ids, np.uint16)


@lru_cache(maxsize=1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, BUCKETS, 1 << 16).astype(np.int64), rng.normal(size=(BUCKETS, DIMS))


def project(ids: np.ndarray) -> np.ndarray:
    """The hashed, length-one vector of a document in DIMS dimensions."""
    bucket, matrix = _projection()
    counts = np.sqrt(np.bincount(bucket[ids], minlength=BUCKETS))
    return (counts / np.sqrt((counts * counts).sum())) @ matrix


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer points (n x d, each below 2^bits), as int64.

    Works from the highest bit down: reflect the cell so that the curve enters at its origin, gather the Gray-coded
    cell number, and decode the whole at the end.
    """
    x = points.astype(np.int64).copy()
    n, d = x.shape
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[:, d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(points: np.ndarray) -> np.ndarray:
    """Real points to curve places: each dimension is cut evenly over (-3, 3)."""
    cells = np.clip((points + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            ids = [token_ids(t) for t in part.column(1).to_pylist()]
            keys = curve_keys(np.array([project(x) for x in ids]))
            columns = [part.column(0), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "ids"])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    arrays = [pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lays the documents of one range end to end; holds the pieces of a few hundred sequences at a time."""
    first = TaskContext.get().partitionId() << 32
    at, sequence, out = 0, 0, []
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
            n, start = len(ids), 0
            view = memoryview(ids).cast("B")
            while start < n:
                length = min(n - start, LENGTH - at)
                out.append((doc_id, start, length, n, first + sequence, at, view[4 * start : 4 * (start + length)].tobytes()))
                start, at = start + length, at + length
                if at == LENGTH:
                    at, sequence = 0, sequence + 1
                if len(out) == HELD:
                    yield _pieces(out)
                    out = []
    yield _pieces(out)


def tokenised(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, n, ids): ids as little-endian 16-bit values."""
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(_tokenised, "doc_id bigint, key bigint, n bigint, ids binary")


def pack(docs: DataFrame, text: str = "text", range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """The pieces of every document: doc_id, start, length, doc_tokens, sequence_id, offset, and the piece's ids as
    little-endian 32-bit numbers."""
    ids = materialize(tokenised(docs, text), "tokens")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, min(MAX_RANGES, -(-total // range_tokens)))
    laid = ids.repartitionByRange(ranges, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n")
    return laid.select("doc_id", "ids").mapInArrow(_packed, PIECES)
