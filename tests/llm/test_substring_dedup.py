import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import substring_dedup as d
from tests.llm.data import documents, empty

N = d.LENGTH


def brute(rows):
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - N + 1):
            w = raw[s : s + N]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - N + 1):
            if least[raw[s : s + N]] < order(i):
                gone[s : s + N] = b"\1" * N
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted([(r.doc_id, r.n_bytes, sum(x.high - x.low for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()], key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randrange(8, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 30))]
        t = rng.choice([" ", "\n", ""]).join(parts)
        if out and rng.random() < 0.2:
            t = rng.choice(out)
            if rng.random() < 0.7 and t:
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice(["", "#", " x "]) + t[k + 1 :]
        if rng.random() < 0.1:
            t += "a" * rng.randrange(40, 200) + "ab" * rng.randrange(0, 60)
        out.append(t)
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, t, "en", "a", 1, None, None) for i, t in zip(ids, out, strict=True)]


@pytest.mark.parametrize(("seed", "hot", "batch_hot", "part"), [(1, 4096, 32, 1 << 21), (2, 2, 1, 500), (3, 3, 2, 97)])
def test_equals_brute_force(spark, seed, hot, batch_hot, part):
    rows = texts(seed, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, size bigint").repartition(5)
    got = digest(d.remove_repeats(docs, hot=hot, hot_batch=batch_hot, part=part))
    assert got == brute([(r[0], r[1]) for r in rows])
    assert any(x[2] for x in got)


def test_edge_cases(spark):
    extra = [(3, "q" * 60, "en", "a", 1, None, None), (30, "x" + "q" * 70, "en", "a", 1, None, None), (None, "q" * 50 + "z", "en", "a", 1, None, None)]
    docs = documents(spark, extra)
    got = digest(d.remove_repeats(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert d.remove_repeats(empty(spark)).count() == 0


def test_every_string_has_one_anchor():
    rng = np.random.Generator(np.random.PCG64(3))
    raw = rng.integers(0, 3, 3000).astype(np.uint8)
    starts, ends = np.array([0, 40, 90, 1500]), np.array([40, 90, 1500, 3000])
    text, place, low, high, _ = d.anchors(d._eights(raw), starts, ends)
    strings = sorted(s for a, b in zip(low, high, strict=True) for s in range(a, b + 1))
    assert strings == [s for a, b in zip(starts, ends, strict=True) for s in range(a, b - N + 1)]
    assert ((low <= place) & (place + d.GRAM <= high + N)).all()
    assert (starts[text] <= low).all() and (high + N <= ends[text]).all()


def test_an_anchor_over_many_batches_is_decided_as_in_one():
    rng = np.random.Generator(np.random.PCG64(8))
    for case in range(60):
        n = int(rng.integers(1, 80))
        a = np.sort(rng.integers(0, rng.choice([1, 2, 6]), n))
        c, key, low = rng.integers(0, rng.choice([1, 2, 20]), n), rng.integers(0, rng.choice([1, 2, 30]), n), rng.integers(0, 1000, n)
        kind = np.where(rng.random(n) < 0.05, d.SPEAKS, d.OCCURRENCE)
        order = np.lexsort((low, key, c, a))
        a, c, key, at = a[order], c[order], key[order], d._at(low, low + 5, kind)[order]
        rows = lambda batches: sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
        want = rows(d._decide([a, c, key, at], 0))
        for size in (1, 3, 1000):
            parts = [d._batch(*(x[k : k + size] for x in (a, c, key, at))) for k in range(0, n, size)]
            assert rows(d._by_anchor(0)(iter(parts))) == want, case


def test_an_open_anchor_holds_no_more_than_decides():
    state = d._Open(0)
    size = 1000
    for k in range(50):
        c, key = np.full(size, k // 25), np.arange(k * size, (k + 1) * size)
        list(state.add(np.zeros(size, np.int64), c, key, d._at(key * 0, key * 0 + 5, d.OCCURRENCE)))
        assert sum(len(x[0]) for x in state.held) <= size


def test_shards_in_files_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 256), ("IN_MEMORY", 100)):
        monkeypatch.setattr(d.suffix, name, value)
    monkeypatch.setattr(d, "SEGMENTS_AT_ONCE", 7)
    rows = texts(4, 150)
    segments = [(k, s, r[1].encode()[s : s + 76]) for k, r in enumerate(rows) for s in range(0, max(0, len(r[1].encode()) - 76), 9)]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int64()), pa.array([i[0] for i in x], pa.int64()), pa.array([i[1] for i in x], pa.int32()), pa.array([i[2] for i in x], pa.binary())], names=["shard", "key", "low", "segment"])
    parts = [batch(segments), batch([])] if len(segments) < 20 else [batch(segments[:10]).slice(3), batch(segments[:3]), batch([]), batch(segments[10:])]
    gone = set()
    for b in d._sorted_shard(0, 300)(iter(parts)):
        gone |= {(r["key"], x) for r in b.to_pylist() for x in range(r["low"], r["high"])}
    least, want = {}, set()
    strings = [(k, s + i, x[i : i + N]) for k, s, x in segments for i in range(len(x) - N + 1)]
    for k, _, w in strings:
        least[w] = min(least.get(w, k), k)
    for k, s, w in strings:
        if least[w] < k:
            want |= {(k, x) for x in range(s, s + N)}
    assert gone == want and want


def test_very_long_texts(spark):
    """Texts of several parts that share a passage, and one that repeats a string throughout."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    shared, hot = prose(3000), "the same string of more than fifty bytes, again and again. "
    rows = [(1, prose(40_000) + shared), (2, shared + prose(40_000)), (3, hot * 4000), (4, prose(50) + hot * 3), (5, prose(100) + hot * 2 + shared[:100])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digest(d.remove_repeats(docs, part=1 << 16)) == brute(rows)
