import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import aggregates, quantiles
from docloom.operators.quantiles import percentiles

INF, NAN = float("inf"), float("nan")


def order(v):
    return (math.isnan(v), 0.0 if math.isnan(v) else v)


def sorted_percentile(values, q):
    v = sorted(values, key=order)
    p = (len(v) - 1) * q
    a, b = v[math.floor(p)], v[math.ceil(p)]
    return a if p == math.floor(p) or a == b or (math.isnan(a) and math.isnan(b)) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b


def groups():
    rng = random.Random(6)
    return {
        "even": [float(k) for k in range(2000)],
        "normal": [rng.gauss(0, 1) for _ in range(1501)],
        "powers": [2.0**k for k in range(-30, 30)],
        "steps": [rng.choice([1.0, 1.0 + 2**-52, 5.0]) for _ in range(999)],
        "equal": [7.5] * 800,
        "odd": [INF] * 300 + [-INF] * 300 + [NAN] * 200 + [rng.random() for _ in range(301)],
        "huge": [rng.choice([-1.7e308, 1.7e308, 0.0]) for _ in range(700)],
        "tiny": [5e-324 * k for k in range(1000)],
        "one": [3.0],
        "two": [3.0, 4.0],
        None: [float(k * k) for k in range(600)],
    }


@pytest.mark.parametrize("q", [0.5, 0.995])
def test_percentiles_equal_sorting(spark, monkeypatch, q):
    """Every group but the smallest holds more different values than may be sorted at once."""
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 3 if q == 0.5 else 100)
    rows = [(g, v) for g, values in groups().items() for v in values] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.percentile for r in percentiles(df, ["g"], "v", q, exact=20, bins=64).collect()}
    assert set(got) == set(groups())
    for g, values in groups().items():
        want = sorted_percentile(values, q)
        assert got[g] == want or math.isnan(got[g]) and math.isnan(want), g


def test_neighbours_in_two_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + [1000] * 50], "v double")
    assert percentiles(df, [], "v", 0.5, exact=3, bins=4).first().percentile == 500.0


def test_no_buffer_holds_a_group(spark):
    """More different values than are sorted at once: what is collected is a bounded list."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.25)).alias("m")).collect()}
    out = percentiles(df, ["g"], "v", 0.25, exact=100)
    assert {r.g: r.percentile for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(df, ["g"], "v", 0.5).count() == 0 and percentiles(df, [], "v", 0.5).count() == 0
    assert aggregates.axis_maximum(df, ["v"]).first().maximum == 0.0
    nulls = spark.createDataFrame([("a", None), (None, 2.0)], "g string, v double")
    assert sorted((r.g or "", r.n, r.median) for r in aggregates.describe(nulls, ["g"], "v").collect()) == [("", 1, 2.0), ("a", 0, None)]
    assert aggregates.describe(nulls, [], "v").first().median == 2.0
