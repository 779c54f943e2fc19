"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairs cost linear time:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The words of the whole text are hashed into `WORDS` places with counts scaled to length one; behind them stand the
structure statistics and the length that the table gives (metadata).  Labels, language, source and id are no inputs.

It is fitted on the driver from the features of at most `SAMPLE` labelled documents, chosen by a hash of their id
from those that aren't held out; scoring is one pass over the texts.  Everything follows from the seed.

Defined cases: null text is empty; an empty text has only its statistics and gets a score like any other; null
metadata counts as zero; labels that are null or of absent documents are not used, several labels of a document count as 1
only if all are 1; without labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows score alike; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 15
RANK = 8
SAMPLE = 12_000
EPOCHS = 6
SEED = 4
THRESHOLD = 0.3
SYMBOLS = re.compile(rb"[#*$%&|<>]")
DIGITS = re.compile(rb"[0-9]")
UPPER = re.compile(rb"[A-Z]")
STOPS = re.compile(rb"[.!?]")
#: The dense features: a constant scale keeps each near one.
DENSE = ("log_words", "word_length", "symbols", "digits", "upper", "stops", "distinct", "repeats", "dup_lines", "lines", "log_chars")


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): sparse, the dense features last at WORDS, WORDS + 1, ..."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    some = max(1, n)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    places, counts = np.unique(hashed & np.uint32(WORDS - 1), return_counts=True)
    values = counts / np.sqrt(max(1.0, float((counts * counts).sum())))
    repeats = 0.0
    if n > 2:
        h = hashed.astype(np.uint64)
        windows = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        repeats = 1.0 - len(np.unique(windows)) / len(windows)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = max(1, len(raw))
    dense = (
        np.log1p(n) / 8,
        len(raw) / some / 10,
        min(3.0, len(SYMBOLS.findall(raw)) / some),
        10 * len(DIGITS.findall(raw)) / size,
        10 * len(UPPER.findall(raw)) / size,
        5 * min(1.0, len(STOPS.findall(raw)) / some),
        len(places) / some,
        repeats,
        1 - len(set(lines)) / max(1, len(lines)),
        10 * min(0.3, len(lines) / some),
        np.log1p(max(0, n_chars or 0)) / 10,
    )
    return np.concatenate((places.astype(np.int32), np.arange(WORDS, WORDS + len(DENSE), dtype=np.int32))), np.concatenate((values, dense)).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[places] * values[:, None]
        sums = v.sum(axis=0)
        return float(self.bias + self.linear[places] @ values + 0.5 * ((sums * sums).sum() - (v * v).sum()))

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.raw(places, values), -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = SEED) -> Model:
    """Adagrad on the logistic loss in batches."""
    width = WORDS + len(DENSE)
    rng = np.random.Generator(np.random.PCG64(seed))
    share = float(labels.mean()) if len(labels) else 0.5
    model = Model(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32))
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias = float(np.log(share / (1 - share)))
        return model
    model.bias = float(np.log(share / (1 - share)))
    model.factors = rng.normal(0, 0.02, (width, RANK)).astype(np.float32)
    seen_b, seen_w, seen_v = 1e-6, np.full(width, 1e-6, np.float32), np.full((width, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            places = np.concatenate([rows[i][0] for i in part])
            values = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            v = model.factors[places]
            vx = v * values[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            out = model.bias + np.add.reduceat(model.linear[places] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - labels[part]) / len(part)
            each = np.repeat(error, sizes)
            slope = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            used, back = np.unique(places, return_inverse=True)
            gw = np.bincount(back, each * values, len(used)).astype(np.float32) + decay * model.linear[used]
            gv = np.stack([np.bincount(back, slope[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * model.factors[used]
            gb = float(error.sum())
            seen_b += gb * gb
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            model.bias -= rate * gb / seen_b**0.5
            model.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= rate * gv / np.sqrt(seen_v[used])
    return model


def held_out(doc_id: str = "doc_id"):
    """Fold of the evaluation: these documents' labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "places", "values"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", n_chars: str = "n_chars", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents that aren't held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(text).cast("string").alias("text"), F.col(n_chars).cast("long").alias("n"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", "n")
    found = rows.mapInArrow(_featured, "doc_id bigint, label int, places binary, values binary").collect()
    found = {(r.doc_id, bytes(r.places), bytes(r["values"])): r for r in sorted(found, key=lambda r: (r.doc_id, bytes(r.places), bytes(r["values"])))}.values()
    sparse = [(np.frombuffer(r.places, "<i4"), np.frombuffer(r["values"], "<f4")) for r in found]
    return fit(sparse, np.array([float(r.label == 1) for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            out = [m.score(*features(t, n)) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col(text).cast("string").alias("text"), F.col(n_chars).cast("long").alias("n"))
    out = rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    return score(docs, train(docs, labels, text, n_chars), text, n_chars)
