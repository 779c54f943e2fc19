import numpy as np

from docloom.llm import factorization as fm
from tests.llm.data import documents, empty

LABELS = "doc_id bigint, quality int"


def test_pairs_cost_linear_time_but_equal_the_sum():
    rng = np.random.Generator(np.random.PCG64(0))
    width = fm.WORDS + len(fm.DENSE)
    m = fm.Model(0.3, rng.normal(size=width), rng.normal(size=(width, fm.RANK)))
    places, values = fm.features("some words and some more ### of them", 36)
    slow = m.bias + m.linear[places] @ values
    for i in range(len(places)):
        for j in range(i):
            slow += m.factors[places[i]] @ m.factors[places[j]] * values[i] * values[j]
    assert np.isclose(m.raw(places, values), slow)


def area(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = fm.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    x, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert area(x, y) > 0.9
    assert (np.array([r.predicted for r in rows]) == y).mean() > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_edge_cases(spark):
    docs = documents(spark)
    for rows in ([], [(1, 1)], [(1, 1), (2, 0), (7, 0), (8, 1), (None, 1), (9, None), (4, 0), (999, 1)]):
        got = fm.classify(docs, spark.createDataFrame(rows, LABELS)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert fm.classify(empty(spark), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


def test_labels_of_held_out_documents_are_not_used(spark):
    import zlib

    docs = documents(spark)
    held = [i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, i % 2) for i in range(1, 11)]
    a = fm.classify(docs, spark.createDataFrame(rows, LABELS))
    b = fm.classify(docs, spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in rows], LABELS))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.doc_id for r in a.collect() if r.held_out} == set(held)


def test_query_equals_brute_force_over_pairs(spark, sf):
    """Every score of the query again, with the pairs summed one by one and features counted from words."""
    import math
    import re
    from collections import Counter
    from zlib import crc32

    from docloom.llm import factorization as fm
    from docloom.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = fm.train(docs, labels)
    got = {r.doc_id: r for r in queries.op4_factorization(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text))[:: max(1, len(rows) // 40)]:
        raw = r.text.encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        counts = Counter(crc32(w) % fm.WORDS for w in words)
        length = math.sqrt(sum(c * c for c in counts.values())) or 1.0
        x = {k: c / length for k, c in counts.items()}
        places, values = fm.features(r.text, r.n_chars)
        x |= dict(zip(places[-len(fm.DENSE) :].tolist(), values[-len(fm.DENSE) :].tolist(), strict=True))
        total = float(model.bias) + sum(float(model.linear[k]) * v for k, v in x.items())
        keys = sorted(x)
        if len(keys) > 400:
            continue
        v = {k: model.factors[k].astype(float) * x[k] for k in keys}
        total += sum(float(v[a] @ v[b]) for i, a in enumerate(keys) for b in keys[i + 1 :])
        want = 1 / (1 + math.exp(-total))
        assert abs(got[r.doc_id].score - want) < 1e-4
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3) and got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
