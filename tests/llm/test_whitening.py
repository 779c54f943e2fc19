import math

import numpy as np
import pytest

from docloom.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, n int, dim string"


def check(got, rows, components=32):
    """The contract's values, computed on whole numbers and doubles by other means."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    z = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-13 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == n * k
    assert {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    for (i, _), dev, row in zip(kept, deviations, z @ u / np.sqrt(np.maximum(e, 1e-300)), strict=True):
        for c in range(1, k + 1):
            r = by[i, c]
            assert any(q.deviation == dev for q in r) and all(abs(q.explained - e[c - 1] / e.sum()) < 1e-6 for q in r)
            gaps = np.diff(e)[max(0, c - 2) : c]
            if (np.abs(gaps) > 1e-3 * e[0]).all():
                assert any(abs(abs(q.whitened) - abs(row[c - 1])) < 1e-6 for q in r)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # the output's own covariance
    wide = np.array([r.whitened for r in sorted(got, key=lambda r: (r.deviation, r.vec_id is None, r.vec_id or 0, r.component))])
    if len({r.vec_id for r in got}) == n:
        wide = wide.reshape(n, k)
        assert np.abs(np.cov(wide.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-6
    return k


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("width", "block"), [(16, 1024), (3, 7), (64, 1)])
def test_odd_vectors(spark, monkeypatch, width, block):
    monkeypatch.setattr(whitening, "ROWS", block)
    monkeypatch.setattr(whitening, "HELD", 50)
    rng = np.random.default_rng(1)
    d = 10
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + 5)]
    rows += [(500, [1.0] * d), (500, [1.0] * d), (None, [2.0] * d), (501, None), (502, [None] * d), (503, [float("nan")] + [0.0] * (d - 1)), (504, [float("inf")] + [0.0] * (d - 1)), (505, [0.0] * (d - 1) + [-float("inf")])]
    got = whitening.whiten(frame(spark, rows + [(506, []), (507, [1.0, 2.0])]).repartition(3), width=width).collect()
    assert check(got, rows) == d


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 40)))]
    assert check(whitening.whiten(frame(spark, rows)).collect(), rows) == 32
    flat = [(i, v[:6] + v[:6]) for i, v in rows]
    assert check(whitening.whiten(frame(spark, flat)).collect(), flat) == 6


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(50, 3)) * [1, 1e3, 1e5] + [0, 1e6, 0])]
    rows[7] = (7, [3e38, 0.0, 0.0])
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation is None for r in got} == {True}
    del rows[7]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_query_over_all_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert check(queries.op12_whitening(spark, sf).collect(), rows) == 32
