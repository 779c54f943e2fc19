import random
import re

import numpy as np
import xxhash

from docloom.llm import simhash
from docloom.llm.components import connected_components
from tests.llm.data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_equals_definition(spark):
    for r in documents(spark).collect():
        assert simhash.fingerprint(r.text) == brute_print(r.text)


def test_anchors_meet_for_every_close_pair():
    rng = np.random.Generator(np.random.PCG64(1))
    for bits in (0, 1, 2, 3):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
        y = x.copy()
        for i in range(400):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        lists = []
        for z in (x, y):
            rows, keys, home = simhash.anchors(z)
            lists.append([({*keys[rows == i]}, {*keys[(rows == i) & home]}) for i in range(400)])
        for (all_x, home_x), (all_y, home_y) in zip(*lists, strict=True):
            assert home_x & all_y or home_y & all_x


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    fps = [0]
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 7)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                f ^= 1 << b
    rows = [(i * 7 % 1000, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    pairs = {(min(a, b), max(a, b)) for a, b in simhash.links(distinct.select("fp").distinct()).collect()}
    signed = sorted({r[1] for r in rows})
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert pairs == want and want


def test_near_duplicates_and_keep_first(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200", "changed")
    docs = documents(spark, [(50, base, "en", "a", 1, None, None), (49, near, "en", "b", 1, None, None), (48, base.upper(), "en", "b", 1, None, None)])
    rows = docs.where("doc_id is not null").collect()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
    want = brute_components([brute_print(r.text) for r in rows], [r.doc_id for r in rows])
    assert found == {r.doc_id: c for r, c in zip(rows, want, strict=True)}
    assert found[50] == found[48] == 48 and found[3] == found[4] == found[5] == 3
    for limit in (1000, 0):
        kept = simhash.keep_first(docs.where("doc_id is not null"), broadcast_rows=limit)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_null_id_and_empty_table(spark):
    assert simhash.near_duplicates(documents(spark)).count() == documents(spark).count()
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (6, 5)]
    found = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(200))


def test_hot_anchors_are_split_exactly(spark):
    """Fingerprints that share a half, or nearly so: the split finds the same links as brute force."""
    rng = np.random.Generator(np.random.PCG64(12))
    half, base = 0x5A5A1234, [int(x) for x in rng.integers(0, 1 << 32, 12)]
    fps = set()
    for b in base:
        for _ in range(25):
            flips = [int(x) for x in rng.choice(64, int(rng.integers(0, 4)), replace=False)]
            for low in (True, False):
                x = half | b << 32 if low else b | half << 32
                for f in flips:
                    x ^= 1 << f
                fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    for hot in (2, 10_000):
        got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df, hot).collect()]
        assert set(got) == want and len(want) > 500


def test_a_very_long_text_is_counted_whole():
    """More shingles than are counted at once."""
    words = [f"w{i * i % 5_021}" for i in range(150_000)]
    counts = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    assert simhash.fingerprint(" ".join(words)) == sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)
