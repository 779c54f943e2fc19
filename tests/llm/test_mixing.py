import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing
from tests.llm.data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_by_hand():
    got = mixing.targets({"a": 100, "b": 100, "c": 100, None: 100})
    assert got == pytest.approx({"a": 400 * 5 / 13 + 0, "b": 400 * 2 / 13, "c": 400 / 13, None: 400 * 5 / 13})
    got = mixing.targets({"a": 10, "b": 100, "c": 290})
    assert got == pytest.approx({"a": 30, "b": 370 * 2 / 3, "c": 370 / 3})
    assert mixing.targets({"a": 0, "b": 7}) == pytest.approx({"a": 0, "b": 7})
    assert mixing.targets({}) == {}


def split(quotas, shards, seed):
    """shards x sources."""
    nodes = sorted(mixing.split_quotas(quotas, 0, shards, seed), key=lambda n: n[0])
    assert [n[:2] for n in nodes] == [(i, i + 1) for i in range(shards)]
    return np.array([n[3] for n in nodes])


def test_tree_splits_exactly():
    quotas = np.array([1000, 3, 0, 77])
    out = split(quotas, 9, 42)
    assert (out.sum(axis=0) == quotas).all() and np.ptp(out.sum(axis=1)) <= 1 and (out >= 0).all()
    assert (out == split(quotas, 9, 42)).all()
    assert not (out == split(quotas, 9, 43)).all()


def test_tree_goes_on_from_its_nodes():
    quotas = np.array([1000, 3, 0, 77])
    nodes = list(mixing.split_quotas(quotas, 0, 37, 42, stop=5))
    assert all(high - low <= 5 for low, high, *_ in nodes) and len(nodes) > 7
    below = [x for low, high, start, have in nodes for x in mixing.split_quotas(have, low, high, 42, 1, start)]
    whole = list(mixing.split_quotas(quotas, 0, 37, 42))
    assert sorted((n[0], *map(tuple, n[2:])) for n in below) == sorted((n[0], *map(tuple, n[2:])) for n in whole)
    at = np.zeros(4, np.int64)
    for _, _, start, have in sorted(whole, key=lambda n: n[0]):
        assert (start == at).all()
        at = at + have


def test_shards_draw_what_the_tree_gives_them(spark, monkeypatch):
    """All draws again by brute force: quotas from the blocks' words, shards from the tree, words from the block."""
    for name, value in (("BLOCK_WORDS", 200), ("SHARD_BLOCKS", 5), ("NODE_SHARDS", 3)):
        monkeypatch.setattr(mixing, name, value)
    rows = [(100 + i, " ".join(["w"] * (i % 13 + 1)), "en", "abc"[i % 3] if i % 7 else None, 1, None, None) for i in range(2000)]
    docs = documents(spark, rows).where("doc_id >= 100")
    sources, _, shards = mixing.plan(docs)
    info = {r._mx_source: r for r in sources.collect()}
    got = mixing.draws(docs).select("*", mixing._key("source").alias("k")).collect()
    spot = docs.select("doc_id", mixing._key("source").alias("_mx_source"), mixing._place(42).alias("_mx_place")).join(sources, "_mx_source")
    block = dict(spot.select("doc_id", mixing.block_number()).collect())
    words = defaultdict(Counter)
    for r in got:
        words[r.k][block[r.doc_id]] += r["size"]
    quotas = []
    for k in sorted(info):
        n, aim = info[k]._mx_blocks, round(info[k]._mx_target)
        left, number = aim, 0
        while left > 0 and number < 3 * n:
            left -= words[k][number % n]
            number += 1
        quotas.append(number)
        cut = words[k][(number - 1) % n] + left
        assert (number - 1) % n == info[k]._mx_last and cut == info[k]._mx_words or left == 0 or number == 3 * n
    tree = split(np.array(quotas), shards, 42)
    assert shards > 10 and len(info) == 4
    ends = {k: np.cumsum(tree[:, i]) for i, k in enumerate(sorted(info))}
    drawn = {k: defaultdict(set) for k in info}
    for r in got:
        n = info[r.k]._mx_blocks
        want = [number for number in range(block[r.doc_id], int(ends[r.k][-1]), n)]
        assert {(d.round * n + d.block, d.shard) for d in r.draws} <= {(x, int(np.searchsorted(ends[r.k], x, "right"))) for x in want}
        whole = [x for x in want if x != ends[r.k][-1] - 1]
        assert len(r.draws) >= len(whole) and all(d.words == r["size"] for d in r.draws if d.round * n + d.block in whole)
        for d in r.draws:
            drawn[r.k][d.shard].add(d.round * n + d.block)
    for i, k in enumerate(sorted(info)):
        assert [len(drawn[k][s]) for s in range(shards)] == tree[:, i].tolist()
    # another tree gives other draws
    monkeypatch.setattr(mixing, "split_quotas", lambda q, low, high, seed, stop=1, start=None: iter([(low, high if stop > 1 else low + 1, q * 0 if start is None else start, q)]))
    moved = {d.shard for r in mixing.draws(docs).collect() for d in r.draws}
    assert moved == {0}


def test_partitions_are_shards(spark, monkeypatch):
    for name, value in (("BLOCK_WORDS", 200), ("SHARD_BLOCKS", 5)):
        monkeypatch.setattr(mixing, name, value)
    rows = [(100 + i, f"t{i} " * (i % 13 + 1), "en", "abc"[i % 3], 1, None, None) for i in range(1000)]
    docs = documents(spark, rows).where("doc_id >= 100")
    want = Counter((d.shard, r.doc_id) for r in mixing.draws(docs).collect() for d in r.draws)
    got = mixing.mix(docs)
    assert got.rdd.getNumPartitions() == len({s for s, _ in want})
    assert Counter((r.p, r.doc_id) for r in got.select("doc_id", F.spark_partition_id().alias("p")).collect()) == want


def test_takes_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 20)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 5)
    rows = [(100 + i, " ".join(["w"] * (i % 13)), "en", "abc"[i % 3] if i % 7 else None, 1, None, None) for i in range(300)]
    docs = documents(spark, rows)
    got = mixing.draws(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "size", "source_size", "target", "draws"})
    taken = got.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])).collect()
    assert len(taken) == docs.count()
    by = defaultdict(lambda: [0, 0, 0, 0.0])
    for r in taken:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken <= 3 * r["size"]
        x = by[r.source]
        x[0] += r.taken
        x[1] += r["size"]
        x[2], x[3] = r.source_size, r.target
    want = mixing.targets({s: x[1] for s, x in by.items()})
    for s, x in by.items():
        assert x[1] == x[2] and x[3] == pytest.approx(want[s]) and abs(x[0] - want[s]) <= 1
    again = mixing.draws(docs.repartition(7)).select("doc_id", "draws")
    assert sorted(map(str, again.collect())) == sorted(str(x) for x in got.select("doc_id", "draws").collect())
    # a shard gets a block of a source at most once a round
    shards = Counter(d.shard for r in taken for d in r.draws)
    assert len(shards) > 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == Counter({s: x[0] for s, x in by.items()})


def test_empty_table(spark):
    assert mixing.draws(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


def test_first_words_keep_white_space(spark):
    df = spark.createDataFrame([(" a\n b  c d ", 3)], "t string, n long")
    assert df.select(mixing.first_words("t", F.col("n"))).first()[0] == " a\n b  c"
