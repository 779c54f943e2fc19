import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from docloom.llm import near_dedup
from tests.llm.test_near_dedup import brute_components


def group(n, seed=5):
    """Texts of 300 words that share all but some seven far words with one text, so most pairs are below 0.8 but not far from it."""
    rng, words, rows = random.Random(seed), [f"w{i}" for i in range(300)], []
    for k in range(n):
        copy = list(words)
        for p in rng.sample(range(10, 290, 10), rng.randint(3, 7)):
            copy[p] = f"new{k}x{p}"
        rows.append((k, " ".join(copy)))
    return rows


def test_rows_made_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAST", near_dedup.BLOCKS)
    made, sizes = defaultdict(dict), (50, 150)
    plain = near_dedup.materialize

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        made[name][n] = made[name].get(n, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    for n in sizes:
        rows = group(n)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        want = brute_components([t for _, t in rows], [i for i, _ in rows])
        assert [c for _, c in sorted((r.doc_id, r.component_id) for r in got)] == want and 2 < len(set(want)) < n
    met, shared = made.pop("meetings"), made.pop("shared")
    # at most the lists themselves, a row a set and block
    assert all(shared[n] <= near_dedup.BLOCKS * n for n in sizes)
    assert all(met[n] <= near_dedup.EARLY * n for n in sizes)
    assert all(x[sizes[1]] <= 5 * max(x.get(sizes[0], 0), sizes[0]) for x in made.values()), dict(made)


def test_chance_meetings_of_unlike_sets_make_no_rows(spark):
    marks = np.random.Generator(np.random.PCG64(8)).integers(0, 256, (2500, near_dedup.BITS // 8), dtype=np.uint8)
    distinct = spark.createDataFrame([(i, 300, bytes(m)) for i, m in enumerate(marks)], "fp bigint, n bigint, print binary")
    assert near_dedup.meetings(distinct, 1e6).count() > 100
    assert near_dedup.meetings(distinct, 1e6, near_dedup.FAR).count() == 0


def lists(sizes, seed=9):
    """Rows (band, fp, w0, w1, w2) of anchors of these sizes whose sets are around few centres; some fps repeat."""
    rng, rows = np.random.Generator(np.random.PCG64(seed)), []
    for band, size in enumerate(sizes):
        centres = rng.integers(0, 256, (4, 24), dtype=np.uint8)
        for _ in range(size):
            flips = np.packbits(rng.random(192) < rng.choice([0.05, 0.2]))
            rows.append((band, int(rng.integers(0, 3 * size)), *(centres[rng.integers(0, 4)] ^ flips).view(np.int64).tolist()))
    return sorted(rows, key=lambda r: r[:2])


def brute_tied(rows, far):
    out = set()
    for band in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == band]
        root = {r[1]: r[1] for r in own}
        for a in own:
            for b in own:
                if sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[2:], b[2:], strict=True)) <= far:
                    low, high = sorted((root[a[1]], root[b[1]]))
                    root = {k: low if v == high else v for k, v in root.items()}
        for first in set(root.values()):
            out |= {(band, first, fp, k) for k, fp in enumerate(sorted(f for f, r in root.items() if r == first)) if k}
    return out


def met(rows, batch, *settings):
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(["band", "fp", "w0", "w1", "w2"])})
    out = pa.Table.from_batches(near_dedup._met(*settings)(iter(table.to_batches(max_chunksize=batch))))
    return sorted(zip(*(c.to_pylist() for c in out.columns), strict=True))


def test_sets_tied_at_anchors_equal_brute_force():
    rows = lists([1, 2, 1, 5, 40, 3, 1, 70, 9, 33, 32])
    for far in (20, near_dedup.FAR, 192):
        want = sorted(brute_tied(rows, far))
        assert want
        for batch in (1, 7, 1000):
            for paired in (2, 32):
                assert met(rows, batch, paired, 1000, far) == want


def test_anchors_that_a_task_cannot_hold_are_one_family():
    rows = lists([3, 50, 4, 60, 2])
    want = {(band, first, fp) for band, first, fp, _ in brute_tied([r for r in rows if r[0] in (0, 2, 4)], 40)}
    for band in (1, 3):
        fps = sorted({r[1] for r in rows if r[0] == band})
        want |= {(band, fps[0], fp) for fp in fps[1:]}
    for batch in (1, 7):
        assert {r[:3] for r in met(rows, batch, 32, 20, 40)} == want


def test_a_cell_gives_as_many_links_as_tie_its_components():
    members = list(range(1, 31))
    rows = [(1, side, fp, fp, members) for side in (0, 1) for fp in range(40)] + [(2, side, fp, fp, members + [fp] * (fp > 99)) for side in (0, 1) for fp in (200, 201)]
    cells = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["cell", "side", "fp", "root", "members"])
    got = [p for b in near_dedup._compared(iter([cells])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == 40 and len({x for p in got for x in p}) == 42
