import itertools
import random
import tempfile
import tracemalloc

import numpy as np
import pytest

from docloom.llm import suffix


def sort(raw, depth, memory):
    text = np.concatenate((np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, [0])).astype(np.uint16)
    with tempfile.TemporaryDirectory() as folder:
        out = list(suffix.Induced(text, depth, folder, memory).suffixes())
    return np.concatenate([a for a, _ in out]), np.concatenate([x for _, x in out])


@pytest.mark.parametrize("block", [3, 8, 1 << 19])
def test_order_and_common_prefixes_equal_brute_force(monkeypatch, block):
    """Tiny blocks and queues that hold few tuples send everything through files."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "IN_MEMORY", 0 if block < 10 else 1 << 23)
    rng = random.Random(block)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 26])
        raw = bytes(rng.randrange(letters) + rng.choice([0, 97]) for _ in range(rng.randrange(1, 60)))
        depth = rng.choice([2, 5, 50])
        at, lcp = sort(raw, depth, rng.choice([4, 10, 1000]))
        assert sorted(at.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + depth] for i in at]
        assert cut == sorted(cut, reverse=True)
        for k in range(1, len(at)):
            n = 0
            while n < min(len(cut[k]), len(cut[k - 1])) and cut[k][n] == cut[k - 1][n]:
                n += 1
            assert lcp[k] == n


def test_repeated_equals_brute_force():
    rng = random.Random(9)
    words = [bytes(rng.randrange(97, 105) for _ in range(3)) for _ in range(5)]
    raw = b"".join(rng.choice(words) for _ in range(400))
    starts = np.array(sorted(rng.sample(range(len(raw) - 10), 700)))
    owners = np.array([rng.randrange(6) for _ in starts])
    got = suffix.repeated(np.frombuffer(raw, np.uint8), owners, starts, 10)
    least = {}
    for s, o in zip(starts, owners, strict=True):
        w = raw[s : s + 10]
        least[w] = min(least.get(w, o), o)
    assert got.tolist() == [bool(least[raw[s : s + 10]] < o) for s, o in zip(starts, owners, strict=True)]
    assert got.any() and not got.all()


@pytest.mark.parametrize("memory", [50, 400])
def test_places_beyond_memory_are_split_in_files(monkeypatch, memory):
    monkeypatch.setattr(suffix, "BLOCK", 64)
    monkeypatch.setattr(suffix, "IN_MEMORY", 0)
    rng = random.Random(memory)
    for raw in (bytes(rng.randrange(97, 99) for _ in range(4000)), b"ab" * 2000, b"abcdefghijklmnopqrstuvwxyzyx" * 150, bytes(rng.randrange(256) for _ in range(4000))):
        at, lcp = sort(raw, 20, memory)
        cut = [raw[i : i + 20] for i in at]
        assert cut == sorted(cut, reverse=True) and sorted(at.tolist()) == list(range(len(raw)))
        same = [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y, strict=False))) for x, y in itertools.pairwise(cut)]
        assert lcp[1:].tolist() == same


def test_memory_does_not_grow_with_the_shard(monkeypatch):
    """Peak memory of a shard of 4 MB is less than a tenth of what it takes in memory.  What is left of its growth is the list of
    blocks in files, which are tiny here (8,192 tuples; 524,288 in use)."""
    monkeypatch.setattr(suffix, "BLOCK", 1 << 13)
    monkeypatch.setattr(suffix, "IN_MEMORY", 1 << 13)
    rng = np.random.Generator(np.random.PCG64(5))

    def peak(n, memory, limit):
        monkeypatch.setattr(suffix, "IN_MEMORY", limit)
        text = rng.integers(97, 101, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        with tempfile.TemporaryDirectory() as here:
            owners = np.memmap(f"{here}/o", np.int64, "w+", shape=(n,))
            owners[:] = np.arange(n) * 8 // n
            owners[-50:] = suffix.NOBODY
            tracemalloc.start()
            gone = suffix.repeated_places(text, owners, 50, here, memory)
            found = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert gone[n // 2 : n - 50].all() and not gone[: n // 2].any()
        return found

    small, large, held = peak(1 << 20, 1 << 14, 1 << 13), peak(1 << 22, 1 << 14, 1 << 13), peak(1 << 22, 1 << 23, 1 << 23)
    assert large < held / 10 and large - small < 1 << 22, (small, large, held)
