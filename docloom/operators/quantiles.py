"""Exact percentiles by histograms that are refined until few values are left.

Sorting a group, or holding its different values in one aggregation buffer, needs memory that grows with the group.  Here the rank
that a percentile asks for is narrowed down instead: a pass counts the values of the range it may lie in by BINS bins of one
width, with the least and the largest value in each, and the bin that holds the rank is the next range.  A pass ends in BINS
partial counts a task and group whatever the number of values; those left when a range holds EXACT values at most are
sorted.  Groups that small to begin with take no pass at all.  A range always loses values, as its least and largest are never in
one bin; smooth values take a pass for each factor of BINS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.sinks import stored

#: Bins of a histogram, and how many values are sorted at once.
BINS, EXACT = 1024, 10_000
#: Groups up to which their ranges may be broadcast (some 100 bytes each).
FEW_GROUPS = 100_000
_INF = float("inf")


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value between two finite ones; infinite values and NaN, which is above all, have bins of their own."""
    scale = F.when(F.abs(high - low) < _INF, 1.0).otherwise(0.5)
    part = (v * scale - low * scale) / (high * scale - low * scale)
    inside = F.when(high > low, F.least(F.floor(part * bins), F.lit(bins - 1))).otherwise(0)
    return F.when(F.isnan(v), bins + 1).when(v == _INF, bins).when(v == -_INF, -1).otherwise(inside).cast("int")


def percentiles(df: DataFrame, group: list[str], column: str, q: float, exact: int = EXACT, bins: int = BINS) -> DataFrame:
    """(group..., percentile): the q-percentile of each group's values as doubles, interpolated between its two neighbours.

    Nulls are left out and groups of nothing else give no row; null groups are groups; NaN is above all other values."""
    keys = [f"_k{i}" for i in range(len(group))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.lit(0).alias("_all"), F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    keys.append("_all")
    finite = F.when(F.abs("_v") < _INF, F.col("_v"))
    of_range = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")]
    place = (F.col("_c") - 1) * F.lit(float(q))
    at = {"_p": place, "_r1": F.floor(place), "_r2": F.ceil(place), "_below": F.lit(0).cast("bigint")}
    now = stored(rows.groupBy(*keys).agg(*of_range).withColumns(at))
    hint = F.broadcast if now.count() <= FEW_GROUPS else (lambda d: d)
    names = {k: f"_of{k}" for k in keys}

    def within(ranges: DataFrame) -> DataFrame:
        """The rows in the range of their group, with the range."""
        r = ranges.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in ranges.columns if c not in keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        return rows.join(hint(r), same & (F.col("_v") >= F.col("_mn")) & (F.col("_v") <= F.col("_mx"))).drop(*names.values())

    settled, done = [], []
    while True:
        settled.append(now.where((F.col("_mn") == F.col("_mx")) | (F.col("_c") <= exact)))
        wide = now.where((F.col("_mn") != F.col("_mx")) & (F.col("_c") > exact))
        if wide.isEmpty():
            break
        carried = ["_p", "_r1", "_r2", "_below"]
        binned = within(wide.select(*keys, *carried, "_lo", "_hi", "_mn", "_mx")).withColumn("_bin", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins))
        counted = binned.groupBy(*keys, *carried, "_bin").agg(*of_range)
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("_below", F.col("_below") + before)
        holds = lambda r: (F.col(r) >= F.col("_below")) & (F.col(r) < F.col("_below") + F.col("_c"))
        met = counted.where(holds("_r1") | holds("_r2"))
        # neighbours in two bins are the largest of one and the least of the other
        both = stored(met.groupBy(*keys, "_p", "_r1", "_r2").agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("_below", "_c", "_mn", "_mx", "_lo", "_hi")).alias("_a"),
            F.max(F.struct("_below", "_c", "_mn", "_mx", "_lo", "_hi")).alias("_b"),
        ))
        one = both.where("_n = 1").select(*keys, "_p", "_r1", "_r2", "_a.*")
        done.append(both.where("_n = 2").select(*keys, "_p", "_r1", "_r2", F.col("_a._mx").alias("_v1"), F.col("_b._mn").alias("_v2")))
        now = one
    found = reduce(DataFrame.unionByName, settled)
    equal = found.where(F.col("_mn") == F.col("_mx")).select(*keys, "_p", "_r1", "_r2", F.col("_mn").alias("_v1"), F.col("_mn").alias("_v2"))
    few = within(found.where(F.col("_mn") != F.col("_mx")).select(*keys, "_p", "_r1", "_r2", "_below", "_mn", "_mx"))
    few = few.groupBy(*keys, "_p", "_r1", "_r2", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    nth = lambda r: F.get("_s", (F.col(r) - F.col("_below")).cast("int"))
    every = reduce(DataFrame.unionByName, [few.select(*keys, "_p", "_r1", "_r2", nth("_r1").alias("_v1"), nth("_r2").alias("_v2")), equal, *done])
    value = F.when((F.col("_r1") == F.col("_r2")) | (F.col("_v1") == F.col("_v2")), F.col("_v1")).otherwise((F.col("_r2") - F.col("_p")) * F.col("_v1") + (F.col("_p") - F.col("_r1")) * F.col("_v2"))
    return every.select(*[F.col(k).alias(c) for c, k in zip(group, keys[:-1], strict=True)], value.alias("percentile"))
