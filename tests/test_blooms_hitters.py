import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import aggregates, blooms, dedup, hitters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_knows_its_keys(spark):
    keys = spark.range(0, 60_000, 3).select(F.col("id").alias("k"))
    n = keys.count()
    found = blooms.bloom(keys, "k", n)
    assert found.count() == blooms.parts_for(n) == 4 and {len(r.words) for r in found.collect()} == {blooms.WORDS}
    rows = spark.range(60_000).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k bigint"))
    got = {r.k: r._maybe for r in blooms.tested(rows, "k", found, n).collect()}
    assert len(got) == 60_001 and got[None] is False
    assert all(got[k] for k in range(0, 60_000, 3))
    assert sum(got[k] for k in range(60_000) if k % 3) < 0.03 * 40_000


@pytest.mark.parametrize(("few", "most"), [(1_000_000, 1 << 27), (0, 1 << 27), (0, 0)])
def test_tables_are_split_alike_by_every_way(spark, monkeypatch, few, most):
    monkeypatch.setattr(blooms, "FEW_KEYS", few)
    monkeypatch.setattr(blooms, "MOST_BYTES", most)
    rows = spark.createDataFrame([(f"t{i}", i % 500 if i % 7 else None, i) for i in range(3000)], "text string, id bigint, n int")
    bad = spark.createDataFrame([(i,) for i in range(0, 700, 2)] + [(None,), (2,)], "id bigint")
    clean, unused = dedup.split_by_keys(rows, bad, "id")
    data = [tuple(r) for r in rows.collect()]
    assert sorted(map(tuple, clean.collect()), key=lambda r: r[2]) == [r for r in data if r[1] is None or r[1] % 2]
    assert sorted(map(tuple, unused.collect()), key=lambda r: r[2]) == [r for r in data if r[1] is not None and r[1] % 2 == 0]
    assert clean.columns == rows.columns == unused.columns


def test_texts_of_clean_rows_stay_where_they_were_read(spark, monkeypatch, tmp_path):
    """Too many keys to broadcast: of the two branches of the clean rows only that of what may be bad is shuffled."""
    monkeypatch.setattr(blooms, "FEW_KEYS", 0)
    spark.range(2000).select("id", F.repeat(F.lit("text"), 50).alias("text")).write.parquet(str(tmp_path / "t"))
    rows, bad = spark.read.parquet(str(tmp_path / "t")), spark.range(0, 4000, 4)
    keys = dedup.KeySet(bad, "id")
    clean, _ = keys.split(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sure = blooms.tested(rows, "id", keys.filter, keys.n).where("NOT _maybe").drop("_maybe")
        assert "hashpartitioning" not in plan(sure) and "BroadcastHashJoin" in plan(sure)
        assert "hashpartitioning" in plan(clean)
        assert sure.count() >= 1400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id for r in clean.collect()} == {i for i in range(2000) if i % 4}


def test_empty_sets_and_tables(spark, monkeypatch):
    for few in (0, 10):
        monkeypatch.setattr(blooms, "FEW_KEYS", few)
        rows, none = spark.createDataFrame([("a", 1)], "t string, id int"), spark.createDataFrame([], "id int")
        assert dedup.split_by_keys(rows, none, "id")[0].count() == 1
        assert dedup.split_by_keys(rows.where("id = 2"), spark.createDataFrame([(1,)], "id int"), "id")[1].count() == 0


def test_summaries_lose_no_more_than_they_say():
    rng = random.Random(8)
    for _ in range(50):
        counts = Counter(str(min(rng.randint(0, 60), rng.randint(0, 60))) for _ in range(500))
        held = dict(counts)
        lost = hitters.summarise(held, 10)
        assert len(held) <= 10 and all(counts[v] - lost <= held.get(v, 0) <= counts[v] for v in counts)


@pytest.mark.parametrize("capacity", [2, 30, 5000])
def test_top_values_equal_counting_all(spark, monkeypatch, capacity):
    monkeypatch.setattr(hitters, "CAPACITY", capacity)
    monkeypatch.setattr(hitters.most_frequent, "__defaults__", (capacity,))
    rng = random.Random(capacity)
    values = [f"v{min(int(rng.expovariate(0.05)), 2000)}" for _ in range(4000)] + [None] * 150 + [f"once{i}" for i in range(3000)]
    rng.shuffle(values)
    rows = spark.createDataFrame(list(enumerate(values)), "seen int, v string").repartition(4)
    seen, counts = {}, Counter(values)
    for i, v in enumerate(values):
        seen.setdefault(v, i)
    want = sorted(counts, key=lambda v: (-counts[v], seen[v]))[:12]
    assert [(r.v, r["count"]) for r in aggregates.top_values(rows, "v", "seen", 12).collect()] == [(v, counts[v]) for v in want]
    found = hitters.most_frequent(rows, "v", 12, capacity)
    assert found.count() < 500 or capacity == 5000


def test_evenly_frequent_values_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(hitters, "LARGEST", 64)
    monkeypatch.setattr(hitters.most_frequent, "__defaults__", (4,))
    rows = spark.createDataFrame([(i, f"v{i % 400}") for i in range(1200)], "seen int, v string")
    assert hitters.most_frequent(rows, "v", 5, 4) is None
    assert [r.v for r in aggregates.top_values(rows, "v", "seen", 5).collect()] == [f"v{i}" for i in range(5)]
    assert aggregates.top_values(rows.where("seen < 0"), "v", "seen", 5).count() == 0
