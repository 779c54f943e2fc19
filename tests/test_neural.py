import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark import BarrierTaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.operators import neural
from docloom.operators.extract import Extractor

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def examples(spark):
    good = [(f"the court allows the appeal of claimant {i} today", 1) for i in range(120)]
    return spark.createDataFrame(good + [(f"people walked along river number {i} in summer", 0) for i in range(360)] + [(None, 1), ("no label", None), ("", 0)], "text string, label int")


def random_examples(n, seed=1):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 9, n)
    return neural.Examples(rng.integers(0, 50_000, lengths.sum()), lengths, rng.integers(0, 2, n), rng.random(n) + 0.5, rng.random(n) < 0.2)


@pytest.mark.parametrize("gamma", [0.0, 1.5, 2.0])
def test_gradient_equals_differences(gamma):
    x, flat = random_examples(20), neural.packed(neural.initial(3))
    found = neural.gradient(flat, x, gamma)
    for at in [*(x.flat[:5] % neural.BUCKETS * neural.WIDTH + 2), len(flat) - 1, len(flat) - 3, len(flat) - 25, neural.BUCKETS * neural.WIDTH + 4]:
        low, high = flat.copy(), flat.copy()
        low[at] -= 1e-5
        high[at] += 1e-5
        want = (neural.gradient(high, x, gamma)[-1] - neural.gradient(low, x, gamma)[-1]) / 2e-5
        assert abs(found[at] - want) < 1e-6


def side_by_side(parts, settings):
    """`fit` of all parts in one process, step by step."""
    barrier, slots, out = threading.Barrier(len(parts)), [None] * len(parts), [None] * len(parts)

    def work(rank):
        def exchange(values):
            slots[rank] = values.copy()
            barrier.wait()
            got = list(slots)
            barrier.wait()
            return got

        out[rank] = neural.fit(parts[rank], exchange, rank, settings)

    threads = [threading.Thread(target=work, args=(r,)) for r in range(len(parts))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_tasks_side_by_side_equal_one_process(spark):
    s = neural.Settings(epochs=4, batch_size=16)
    weights, history = neural.train(examples(spark), TOKENIZER, s, tasks=3)
    rows = neural.prepared(examples(spark), TOKENIZER, s, 20_000, 3)
    by = {}
    for r in rows.withColumn("part", F.spark_partition_id()).collect():
        by.setdefault(r.part, []).append(r)
    parts = []
    for k in range(3):
        mine = by[k]
        parts.append(neural.Examples(np.array([i for r in mine for i in r.ids]), np.array([len(r.ids) for r in mine]), np.array([r.label for r in mine]), np.array([r.weight for r in mine]), np.array([r.held for r in mine])))
    for other, losses in side_by_side(parts, s):
        assert losses == history and all((other[k] == weights[k]).all() for k in weights)
    assert history[-1] < 0.5 * history[0]


def test_training_stops_early():
    noise = neural.Examples(*[getattr(random_examples(300, 2), f) for f in ("flat", "lengths", "labels", "weights", "held")])
    s = neural.Settings(epochs=40, batch_size=16, learning_rate=0.05)
    (weights, history), *_ = side_by_side([noise], s)
    assert len(history) == int(np.argmin(history)) + 1 + s.patience < 40
    held = noise.take(np.flatnonzero(noise.held))
    assert neural.gradient(neural.packed(weights), held, s.fixed_gamma)[-1] / held.weights.sum() == pytest.approx(min(history))


def test_examples_are_bounded(spark):
    assert neural.prepared(examples(spark), TOKENIZER, neural.Settings(), 50, 2).count() == 50


def test_all_examples_are_trained_on(spark, monkeypatch):
    """Each as often as it stands, and those of a common sentence by all tasks."""

    def counted(_):
        def run(batches):
            context = BarrierTaskContext.get()
            found = neural._gathered(context)(np.array([neural._read(batches).copies.sum()], float))
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([[float(a[0]) for a in found]])], names=["weights", "history"])

        return run

    monkeypatch.setattr(neural, "_trained", counted)
    monkeypatch.setattr(neural, "unpacked", lambda flat: flat)
    texts = F.when(F.col("id") < 9_001, F.lit("one very common line")).otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    rows = spark.range(25_000).select(texts.alias("text"), F.lit(1).alias("label")).union(spark.createDataFrame([("one very common line", 0), (None, 1)], "text string, label int"))
    _, parts = neural.train(rows, TOKENIZER, tasks=3)
    assert sum(parts) == 25_001 and max(parts) < 1.1 * min(parts)


def test_copies_weigh_as_examples_do():
    x, s = random_examples(60), neural.Settings(epochs=3, batch_size=16)
    copies = np.arange(60) % 4 + 1
    twice = x.take(np.repeat(np.arange(60), copies))
    (weights, losses), *_ = side_by_side([neural.Examples(x.flat, x.lengths, x.labels, x.weights, x.held, copies)], s)
    (wanted, history), *_ = side_by_side([twice], s)
    assert losses == history and all((weights[k] == wanted[k]).all() for k in wanted)


def test_an_epoch_takes_all_examples_in_few_steps(monkeypatch):
    x, s, seen = random_examples(900), neural.Settings(epochs=1, batch_size=8, epoch_steps=5), []
    monkeypatch.setattr(neural, "BLOCK", 32)
    neural.fit(x, lambda values: seen.append(values) or [values], 0, s)
    steps = seen[1:-1]
    assert len(steps) == 5 and sum(v[-4] for v in steps) == pytest.approx(x.weights[~x.held].sum())
    flat = neural.packed(neural.initial(s.seed))
    assert steps[0][-2:] == pytest.approx(neural.gradient(flat, x.take(x.rows(True)), s.fixed_gamma)[-2:])
    rows = x.rows(False)
    assert neural.by_blocks(neural.gradient, flat, x, rows, 2.0) == pytest.approx(neural.gradient(flat, x.take(rows), 2.0))
    assert (neural.by_blocks(neural.gradient, flat, x, rows[:0], 2.0) == 0).all()


def test_scores_equal_brute_force(spark, tmp_path):
    weights = neural.load(spark, neural.save(spark, neural.initial(5), str(tmp_path / "weights")))
    sentence = "The Claimant walked along the river today"
    texts = [". ".join(f"{sentence} {'again and ' * (k * j * 37 % 400)} once more" for k in range(6)) + "." for j in range(9)] + [None, "", "Too short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = neural.Network(weights, TOKENIZER, 0.0)
    assert isinstance(model, Extractor)
    got = model.extract(docs, ["id"], "text").collect()
    tok = Tokenizer.from_file(TOKENIZER)
    tok.enable_truncation(512)
    assert len({len(r.text) for r in got}) > 5 and max(len(tok.encode(r.text, add_special_tokens=False).ids) for r in got) == 512
    for r in got:
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids) % neural.BUCKETS
        hidden = np.tanh(weights["embedding"][ids].mean(axis=0) @ weights["hidden"] + weights["hidden_bias"])
        assert abs(r.score - 1 / (1 + np.exp(-(hidden @ weights["out"] + weights["out_bias"][0])))) < 1e-9
    assert model.extract(docs.where("id > 8"), ["id"], "text").count() == 0


def test_a_trained_network_tells_classes_apart(spark):
    weights, _ = neural.train(examples(spark), TOKENIZER, tasks=2)
    docs = spark.createDataFrame([(1, "The court allows the appeal of claimant nine. People walked along some river in summer.")], "id int, text string")
    assert [r.text for r in neural.Network(weights, TOKENIZER).extract(docs, ["id"], "text").collect()] == ["The court allows the appeal of claimant nine."]
