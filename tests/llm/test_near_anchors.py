import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from docloom.llm import near_dedup
from tests.llm.data import documents
from tests.llm.test_near_dedup import brute_components, planted
from tests.llm.test_simhash import WORD


def test_fingerprint_starts_with_the_simhash_of_five_word_shingles():
    for _, text in planted()[:20]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(len(words) - 4)}
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int.from_bytes(near_dedup.fingerprint(near_dedup.shingles(text))[:8].tobytes(), "little") == want


def nearest(word):
    """The word of the Golay code within three bits, by dividing every candidate by the generator."""
    for error in near_dedup.ERRORS.tolist():
        v = word ^ error
        for i in range(22, 10, -1):
            v ^= 0b101011100011 << (i - 11) if v >> i & 1 else 0
        if not v:
            return (word ^ error) >> 11


def brute_anchors(mark, block):
    bits = [*np.unpackbits(mark).tolist(), 0]
    first, second = (nearest(int("".join(str(bits[p]) for p in places), 2)) for places in near_dedup.PLACES[block])
    return block << 24 | first << 12 | second


def test_anchors_are_the_nearest_words_of_a_perfect_code():
    errors = near_dedup.ERRORS.tolist()
    assert len(set(errors)) == 2048 and max(e.bit_count() for e in errors) == 3
    marks = np.random.Generator(np.random.PCG64(4)).integers(0, 256, (3, near_dedup.BITS // 8), dtype=np.uint8)
    assert near_dedup.anchors(marks, 5, 15).tolist() == [[brute_anchors(m, k) for k in range(5, 15)] for m in marks]


def test_sets_of_similarity_0_8_meet():
    rng = np.random.Generator(np.random.PCG64(7))
    for common, other, blocks in ((267, 33, near_dedup.BLOCKS), (40, 5, near_dedup.BLOCKS), (4, 0.5, near_dedup.FEW_BLOCKS)):
        for _ in range(60):
            u = rng.integers(0, 1 << 63, common + int(2 * other), dtype=np.uint64)
            sets = [np.sort(s) for s in (u[: common + int(other)], np.concatenate([u[:common], u[common + int(other) :]]))]
            a, b = near_dedup.anchors(np.array([near_dedup.fingerprint(s) for s in sets]), 0, blocks)
            assert (a == b).any()
    assert near_dedup.missed(np.arccos(8 / 9) / np.pi) < 1e-4 and near_dedup.missed(0.1875, near_dedup.FEW_BLOCKS) < 1e-4


def test_meetings_equal_brute_force(spark):
    sets = {near_dedup._name(s): s for _, t in planted()[:60] for s in [near_dedup.shingles(t)]}
    marks = {int(np.uint64(f).astype(np.int64)): near_dedup.fingerprint(s) for f, s in sets.items()}
    at = defaultdict(list)
    for f, row in zip(marks, near_dedup.anchors(np.array(list(marks.values())), 0, near_dedup.BLOCKS).tolist(), strict=True):
        for band in row:
            at[band].append(f)
    want = {(band, min(fps), f, k) for band, fps in at.items() for k, f in enumerate(sorted(fps)) if k}
    distinct = spark.createDataFrame([(f, 300, bytes(m)) for f, m in marks.items()], "fp bigint, n bigint, print binary")
    assert {tuple(r) for r in near_dedup.meetings(distinct, 2000).collect()} == want and max(w[3] for w in want) > 3


def test_large_anchors_equal_brute_force(spark, monkeypatch):
    """Every anchor of three sets or more is compared block by block."""
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    monkeypatch.setattr(near_dedup, "LEAST", near_dedup.BLOCKS)
    rows = documents(spark, [(5000 + i, t, "en", "a", 1, None, None) for i, t in planted()]).where("doc_id is not null")
    docs = rows.collect()
    want = brute_components([r.text for r in docs], [r.doc_id for r in docs])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows).collect()} == {r.doc_id: c for r, c in zip(docs, want, strict=True)}


def test_only_rows_with_a_near_one_at_their_anchor_go_on(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(3))
    for paired, held, size, near in ((32, 1 << 20, 1, 20), (32, 1 << 20, 7, 20), (32, 1 << 20, 1000, 64), (2, 1 << 20, 5, 20), (4, 1, 3, 20)):
        monkeypatch.setattr(near_dedup, "PAIRED", paired)
        monkeypatch.setattr(near_dedup, "HELD", held)
        word = lambda: int(rng.integers(0, 3)) * 0x1555555555555555 ^ int(rng.integers(0, 1 << 16))
        rows = sorted((int(rng.integers(0, 40)), int(rng.integers(0, 4)) * int(rng.integers(0, 2)), i, word()) for i in range(110))
        at = defaultdict(list)
        for r in rows:
            at[r[0]].append(r)
        want = [r for r in rows if any(o[1] != r[1] and (o[3] ^ r[3]).bit_count() <= near for o in at[r[0]])]
        table = pa.table(list(map(list, zip(*rows, strict=True))), names=["band", "fp", "own", "w0"])
        got = [tuple(r.values()) for r in pa.Table.from_batches(near_dedup._shared(near)(iter(table.to_batches(max_chunksize=size)))).to_pylist()]
        # anchors beyond the sizes go on as a whole
        assert got == want if (paired, held) == (32, 1 << 20) else set(want) <= set(got) <= set(rows)
        assert len(got) == len(set(got)) < len(rows) and want
