"""A small sentence network: trained by tasks that run side by side, applied by Spark's batch inference.

Token ids are hashed to BUCKETS embeddings, which are averaged and go through one hidden layer to the probability of class 1.

Training runs in one barrier stage over all examples.  Every task holds its part of them in files of its own, works out the gradient of
its own minibatch block by block, and gathers those of all others; all sum them in the order of the tasks, so they hold the same
weights after each step and only the first task returns them.  Equal examples are counted and kept once, and their copies are dealt to all tasks.  The loss is focal and weighted by class, the rate warms up
and falls, weights decay, and what is best on a held-out share of the examples is kept.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docloom.operators import extract
from docloom.operators.aggregates import class_weights
from docloom.operators.keys import hash_number
from docloom.operators.scorers import token_ids
from docloom.sources.sinks import stored

BUCKETS, WIDTH, HIDDEN = 2048, 8, 16
#: Tasks that train side by side: what they gather in a step is that many gradients of some 130 KB.
TASKS = 8
#: Lengths that token lists are padded to for inference; the last is where they are cut.
LENGTHS = (16, 64, 512)
#: Examples whose gradient is worked out at once: with 512 tokens each that is some 70 MB.
BLOCK = 4096
_SHAPES = {"embedding": (BUCKETS, WIDTH), "hidden": (WIDTH, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}

Weights = dict[str, np.ndarray]
Exchange = Callable[[np.ndarray], list[np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """Of training; the names are those of `parameters.training_parameters` where it has them.  A step takes a second at least, as
    Spark's barriers look for each other once a second, so batches are large and steps few: where a task has more than `epoch_steps`
    batches of `batch_size`, its batches are larger, and every epoch still goes through all examples."""

    epochs: int = 12
    batch_size: int = 1024
    epoch_steps: int = 8
    learning_rate: float = 0.05
    warmup_ratio: float = 0.1
    weight_decay: float = 1e-4
    fixed_gamma: float = 2.0
    train_val_split: float = 0.15
    patience: int = 2
    seed: int = 42


@dataclass
class Examples:
    """Token lists end to end, and for each list its length, class, weight, whether it is held out and how often it stands (once, if not given)."""

    flat: np.ndarray
    lengths: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    held: np.ndarray
    copies: np.ndarray | None = None
    starts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def rows(self, held: bool) -> np.ndarray:
        """Of the examples that are held out or of the others, each as often as it stands."""
        found = np.flatnonzero(self.held == held)
        return found if self.copies is None else np.repeat(found, self.copies[found])

    def take(self, rows: np.ndarray) -> Examples:
        parts = [self.flat[a : a + n] for a, n in zip(self.starts[rows].tolist(), self.lengths[rows].tolist(), strict=True)]
        return Examples(np.concatenate(parts) if parts else self.flat[:0], self.lengths[rows], self.labels[rows], self.weights[rows], self.held[rows])


def initial(seed: int) -> Weights:
    rng = np.random.Generator(np.random.PCG64(seed))
    return {k: rng.normal(scale=0.3, size=s) if len(s) > 1 or k == "out" else np.zeros(s) for k, s in _SHAPES.items()}


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES])


def unpacked(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[k], at = flat[at : at + size].reshape(shape), at + size
    return out


def _forward(w: Weights, x: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(x.lengths)), x.lengths)
    ids = (x.flat % BUCKETS).astype(np.int64)
    pooled = np.stack([np.bincount(rows, w["embedding"][ids, k], len(x.lengths)) for k in range(WIDTH)], axis=1) / np.maximum(x.lengths, 1)[:, None]
    hidden = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
    logit = hidden @ w["out"] + w["out_bias"][0]
    return rows, pooled, hidden, 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def losses(p: np.ndarray, labels: np.ndarray, gamma: float) -> np.ndarray:
    """The focal loss: examples that are right by much count little."""
    right = np.clip(np.where(labels == 1, p, 1 - p), 1e-12, 1)
    return -((1 - right) ** gamma) * np.log(right)


def gradient(flat: np.ndarray, x: Examples, gamma: float) -> np.ndarray:
    """The sum over examples of the weighted loss's gradient, then the sum of their weights and losses."""
    if not len(x.lengths):
        return np.zeros(len(flat) + 2)
    w = unpacked(flat)
    rows, pooled, hidden, p = _forward(w, x)
    right = np.clip(np.where(x.labels == 1, p, 1 - p), 1e-12, 1)
    by_right = gamma * (1 - right) ** (gamma - 1) * np.log(right) if gamma else 0.0
    slope = (by_right - (1 - right) ** gamma / right) * np.where(x.labels == 1, 1, -1) * p * (1 - p) * x.weights
    inner = slope[:, None] * w["out"] * (1 - hidden**2)
    share = (inner @ w["hidden"].T) / np.maximum(x.lengths, 1)[:, None]
    ids = (x.flat % BUCKETS).astype(np.int64)
    embedding = np.stack([np.bincount(ids, share[rows, k], BUCKETS) for k in range(WIDTH)], axis=1)
    out = {"embedding": embedding, "hidden": pooled.T @ inner, "hidden_bias": inner.sum(axis=0), "out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True)}
    return np.concatenate([packed(out), [x.weights.sum(), (losses(p, x.labels, gamma) * x.weights).sum()]])


def loss(flat: np.ndarray, x: Examples, gamma: float) -> np.ndarray:
    """What `gradient` ends with."""
    return np.array([x.weights.sum(), (losses(_forward(unpacked(flat), x)[3], x.labels, gamma) * x.weights).sum()])


def by_blocks(f: Callable[[np.ndarray, Examples, float], np.ndarray], flat: np.ndarray, x: Examples, rows: np.ndarray, gamma: float) -> np.ndarray:
    """`gradient` or `loss` of those rows."""
    found = (f(flat, x.take(rows[k : k + BLOCK]), gamma) for k in range(0, len(rows), BLOCK))
    return reduce(np.add, found, np.zeros(2 if f is loss else len(flat) + 2))


def fit(x: Examples, exchange: Exchange, rank: int, s: Settings) -> tuple[Weights, list[float]]:
    """The weights of the best epoch and the held-out losses, from this task's examples and what `exchange` gathers of all."""
    mine, held = x.rows(False), x.rows(True)
    most = max(int(a[0]) for a in exchange(np.array([len(mine)], float)))
    steps = min(s.epoch_steps, -(-most // s.batch_size))
    size = -(-most // max(1, steps))
    flat, first, second = packed(initial(s.seed)), 0.0, 0.0
    best, history, total, done = flat, [], max(1, steps * s.epochs), 0
    warm = max(1, int(total * s.warmup_ratio))
    held_loss = lambda: by_blocks(loss, flat, x, held, s.fixed_gamma)

    def judge(summed: np.ndarray) -> bool:
        """Notes the held-out loss of the weights that an epoch ended with; whether to stop."""
        nonlocal best
        history.append(float(summed[1] / max(summed[0], 1e-12)))
        if history[-1] <= min(history):
            best = flat
        return len(history) - 1 - int(np.argmin(history)) >= s.patience

    stopped = False
    for epoch in range(s.epochs):
        order = np.random.Generator(np.random.PCG64([s.seed, epoch, rank])).permutation(mine)
        for k in range(steps):
            part = order[k * size : (k + 1) * size]
            # the loss of the epoch before travels with the first gradient of the next
            summed = reduce(np.add, exchange(np.concatenate([by_blocks(gradient, flat, x, part, s.fixed_gamma), held_loss() if k == 0 else np.zeros(2)])))
            if k == 0 and epoch and (stopped := judge(summed[-2:])):
                break
            g, done = summed[:-4] / max(summed[-4], 1e-12), done + 1
            rate = s.learning_rate * (done / warm if done <= warm else (total - done + 1) / max(1, total - warm + 1))
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = first / (1 - 0.9**done) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
            flat = flat - rate * (move + s.weight_decay * flat)
        if stopped:
            break
    if not stopped:
        judge(reduce(np.add, exchange(held_loss())))
    return unpacked(best), history


def _gathered(context: BarrierTaskContext) -> Exchange:
    def exchange(values: np.ndarray) -> list[np.ndarray]:
        return [np.frombuffer(base64.b64decode(m)) for m in context.allGather(base64.b64encode(values.astype("<f8").tobytes()).decode())]

    return exchange


def _read(batches: Iterator[pa.RecordBatch]) -> Examples:
    """The columns are mapped from files of the task's own temporary folder, which are gone with it."""
    kinds = {"flat": np.int16, "lengths": np.int32, "label": np.int32, "weight": np.float64, "held": np.bool_, "copies": np.int32}
    files = {name: tempfile.TemporaryFile() for name in kinds}  # noqa: SIM115
    for batch in batches:
        ids = batch.column(0)
        values = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("label", "weight", "held", "copies")}
        values |= {"flat": ids.flatten().to_numpy(zero_copy_only=False) % BUCKETS, "lengths": np.diff(ids.offsets.to_numpy())}
        for name, kind in kinds.items():
            files[name].write(values[name].astype(kind).tobytes())
    found = []
    for name, kind in kinds.items():
        found.append(np.asarray(np.memmap(files[name], kind, "r")) if files[name].tell() else np.zeros(0, kind))
        files[name].close()
    return Examples(*found)


def _trained(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        weights, history = fit(_read(batches), _gathered(context), context.partitionId(), s)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([packed(weights).astype("<f8").tobytes()]), pa.array([history])], names=["weights", "history"])

    return run


def prepared(examples: DataFrame, tokenizer: str, s: Settings, most: int | None, tasks: int) -> DataFrame:
    """(ids, label, weight, held, copies): the examples (text, label), equal ones as one row a task, dealt to `tasks` parts and put in
    order by hash.  With `most`, only so many, those of the smallest hashes."""
    place = hash_number("text", "label", seed=s.seed)
    rows = examples.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", F.col("label").cast("int").alias("label"))
    if most is not None:
        rows = rows.orderBy(place, "text", "label").limit(most)
    rows = stored(rows.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n")))
    weights = F.broadcast(class_weights(rows, "label", times="n").select("label", "weight"))
    held = F.pmod(F.floor(F.col("place") / 97), F.lit(10_000)) < int(s.train_val_split * 10_000)
    rows = rows.join(weights, "label").select(token_ids(F.col("text"), tokenizer, LENGTHS[-1]).alias("ids"), "label", "weight", place.alias("place"), "n")
    # the copies of a common sentence are not one task's
    dealt = rows.select("ids", "label", "weight", held.alias("held"), "place", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(tasks)).cast("int") - 1)).alias("k"))
    dealt = dealt.withColumn("copies", F.ceil((F.col("n") - F.col("k")) / tasks).cast("int"))
    dealt = dealt.repartitionById(tasks, F.pmod(F.col("place") + F.col("k"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("place", "label", "ids", "copies").select("ids", "label", "weight", "held", "copies")


def train(examples: DataFrame, tokenizer: str, settings: Settings | None = None, most: int | None = None, tasks: int | None = None) -> tuple[Weights, list[float]]:
    """(weights, held-out loss of each epoch) from all examples (text, label 0 or 1); `most` is for trials on fewer.

    The tasks of a barrier stage must all run at once, so there are no more than the cluster has cores."""
    s = settings or Settings()
    tasks = tasks or min(TASKS, examples.sparkSession.sparkContext.defaultParallelism)
    row = prepared(examples, tokenizer, s, most, tasks).mapInArrow(_trained(s), "weights binary, history array<double>", barrier=True).collect()[0]
    return unpacked(np.frombuffer(row.weights, "<f8")), list(row.history)


def save(spark: SparkSession, weights: Weights, path: str) -> str:
    spark.createDataFrame([(bytearray(packed(weights).astype("<f8").tobytes()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> Weights:
    return unpacked(np.frombuffer(spark.read.parquet(path).first().weights, "<f8"))


def probabilities(weights: Weights, ids: np.ndarray) -> np.ndarray:
    """Of token lists in the rows of a matrix, padded with -1."""
    lengths = (ids >= 0).sum(axis=1)
    none = np.zeros(len(ids))
    return _forward(weights, Examples(ids[ids >= 0].astype(np.int64), lengths, none, none, none))[3]


def predicted(rows: DataFrame, weights: Weights, batch_size: int = 512) -> DataFrame:
    """`rows` (ids, ...) with `score`.  Lists of like length share batches: they are padded to the next of LENGTHS."""

    def load_model() -> Callable[[np.ndarray], np.ndarray]:
        return lambda ids: probabilities(weights, ids)

    parts, low = [], -1
    for width in LENGTHS:
        score = predict_batch_udf(load_model, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
        mine = rows.where((F.size("ids") > low) & (F.size("ids") <= width))
        parts.append(mine.withColumn("score", score(F.slice(F.concat("ids", F.array_repeat(F.lit(-1), width)), 1, width))))
        low = width
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Network:
    """An extractor (`extract.Extractor`): sentences whose probability reaches the threshold; each distinct sentence is scored once."""

    weights: Weights
    tokenizer: str
    threshold: float = 0.5

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        # read for the distinct sentences and for their places: written, so that texts are cleaned once
        rows = stored(extract.explode_sentences(docs, keys, text, extract.T.model_sentences))
        tokens = stored(rows.select("sentence").distinct().select("sentence", token_ids(F.col("sentence"), self.tokenizer, LENGTHS[-1]).alias("ids")))
        scored = predicted(tokens, self.weights).select("sentence", "score").where(F.col("score") >= self.threshold)
        return extract.hits(rows.join(scored, "sentence"), keys)
