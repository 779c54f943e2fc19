"""Counting, statistics and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.hitters import SMALL, most_frequent
from docloom.operators.quantiles import percentiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def section_statistics(long: DataFrame, section: str = "section", doc: str = "doc_id", score: str = "score", least: float = 0.0) -> DataFrame:
    """For each section and for all (section null): records, records that reach `least`, and documents with such."""
    kept = F.col(score) >= least
    return long.rollup(section).agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("filtered"), F.countDistinct(F.when(kept, F.col(doc))).alias("documents_with_extractions"))


def top_values(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The n most frequent values; ties by first occurrence in `order`.

    Only values that may be among them are counted one by one (`hitters`), so what is shuffled doesn't grow with the different values;
    where values are so evenly frequent that summaries can't tell, all are counted."""
    found = most_frequent(df.where(F.col(column).isNotNull()), column, n)
    rows = df
    if found is not None:
        small = (found.agg(F.sum(F.octet_length("value").cast("long") + 64)).first()[0] or 0) <= SMALL
        rows = df.join(F.broadcast(found) if small else found, F.col(column).cast("string") == F.col("value"), "left_semi").unionByName(df.where(F.col(column).isNull()))
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_seen"))
    return counted.orderBy(F.desc("count"), "_seen", column).limit(n).drop("_seen")


def dictionary_counts(df: DataFrame, column: str, dictionary: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """(category, value, count) for every entry of a fixed dictionary, 0 where absent."""
    entries = df.sparkSession.createDataFrame([(c, v) for c, values in dictionary for v in values], "category string, value string")
    counts = df.where(F.col(column).isin([v for _, values in dictionary for v in values])).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return entries.join(counts, "value", "left").select("category", "value", F.coalesce("count", F.lit(0)).alias("count"))


def axis_maximum(df: DataFrame, columns: list[str], q: float = 0.995) -> DataFrame:
    """The largest q-quantile of the columns, rounded up to a multiple of 5, or of 10 above 100."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_x")).select("_x.*")
    top = F.greatest(F.lit(0.0), F.max("percentile"))
    return percentiles(long, ["axis"], "v", q).agg(top.alias("q")).select(F.when(F.col("q") > 100, F.ceil(F.col("q") / 10) * 10).otherwise(F.ceil(F.col("q") / 5) * 5).cast("double").alias("maximum"))


def histogram(df: DataFrame, column: str, width: float, most: float) -> DataFrame:
    """(bin, count) of bins of one width over 0 .. most, the last closed on both sides; rows outside are left out."""
    last = int(-(-most // width)) - 1
    bins = F.least(F.floor(F.col(column) / width), F.lit(last)).cast("bigint")
    return df.where(F.col(column).between(0, (last + 1) * width)).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def describe(df: DataFrame, group: list[str], column: str, denominator: str | None = None) -> DataFrame:
    """count, mean, median and sample deviation, and the mean ratio to `denominator` where that isn't 0."""
    more = [F.avg(F.try_divide(F.col(column), F.col(denominator))).alias("mean_ratio")] if denominator else []
    means = df.groupBy(*group).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), *more)
    middle = percentiles(df, group, column, 0.5).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("percentile").alias("median"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.lit(True))
    rest = ["mean_ratio"] if denominator else []
    return means.join(middle, same, "left").select(*group, "n", "mean", "median", "std", *rest)


def outliers(df: DataFrame, group: str, column: str, key: str, deviations: float = 2.0, n: int = 3) -> DataFrame:
    """Of each group the n largest values above mean + deviations * sample deviation.

    The limits, one row a group, are joined by the planner's choice."""
    limits = df.groupBy(group).agg((F.avg(column) + deviations * F.stddev_samp(column)).alias("_limit"))
    over = df.join(limits, group).where(F.col(column) > F.col("_limit")).drop("_limit")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(column), key))
    return over.withColumn("rank", rank).where(F.col("rank") <= n)


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(rows, columns, count) with margins: null stands for all."""
    return df.cube(rows, columns).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("margin"))


def class_weights(df: DataFrame, label: str, low: float = 0.5, high: float = 2.0, times: str | None = None) -> DataFrame:
    """Balanced weights n / (k n_i), clipped; a row counts once, or as often as `times` says."""
    counts = df.groupBy(label).agg((F.sum(times) if times else F.count(F.lit(1))).alias("count"))
    every = Window.partitionBy()
    weight = F.sum("count").over(every) / (F.count(F.lit(1)).over(every) * F.col("count"))
    return counts.select(label, "count", F.least(F.lit(high), F.greatest(F.lit(low), weight)).alias("weight"))


def length_statistics(df: DataFrame, text: str) -> DataFrame:
    n = F.char_length(text)
    return df.agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"))


def validation_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows and distinct ids of a table before and after, and the reduction in percent (0 for an empty table)."""
    size = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.countDistinct(key).alias(f"{p}_ids"))
    both = size(before, "before").join(size(after, "after"))
    cut = F.coalesce(F.try_divide(F.col("before_rows") - F.col("after_rows"), F.col("before_rows")), F.lit(0.0)) * 100
    return both.withColumn("reduction", cut)


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """(position, name, type, samples): the first values of each column as text, `NaN` for null."""
    rows = df.limit(samples).collect()
    shown = [(i, name, kind, ["NaN" if r[i] is None else str(r[i]) for r in rows]) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(shown, "position int, name string, type string, samples array<string>")


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a value in each column, and how many rows there are."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])


def metric_means(df: DataFrame, group: list[str | Column], metrics: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])
