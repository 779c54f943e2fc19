"""De-duplication and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.blooms import KeySet
from docloom.operators.keys import MISSING, NOT_A_NUMBER


def duplicate_keys(df: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The keys that occur more than once.  Strict: null and the keys that stand for bad ids are none."""
    found = df.where(F.col(key).isNotNull() & ~F.col(key).isin(MISSING, NOT_A_NUMBER)) if strict else df
    return found.groupBy(key).count().where("count > 1").select(key)


def split_by_keys(df: DataFrame, bad: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't in `bad`, the others).  Null keys are in the first."""
    return KeySet(bad, key).split(df)


def purge(tables: dict[str, DataFrame], key: str, texts: str = "case_texts", test: str = "test", strict: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(clean, unused): ids that are duplicated among the texts or in the test table leave every other table whole;
    the texts lose their own duplicated ids only."""
    found = duplicate_keys(tables[texts], key, strict)
    own = everywhere = KeySet(found, key)
    if test in tables:
        everywhere = KeySet(own.keys.union(duplicate_keys(tables[test], key, strict)), key)
    pairs = {name: (own if name == texts else everywhere).split(df) for name, df in tables.items()}
    return {n: p[0] for n, p in pairs.items()}, {n: p[1] for n, p in pairs.items()}


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def first_text(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first row of each text, compared without case and outer blanks."""
    return first_by(df, [F.lower(F.trim(F.col(text)))], order)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both tables."""
    return a.select(key).intersect(b.select(key))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of `a` that `b` lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def without_values(df: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `df` that equal no row of `gone` in `columns`; nulls are equal."""
    g = gone.select([F.col(c).alias(f"_gone_{c}") for c in columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(g, on, "left_anti")


def vocabulary(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, side): the distinct values in `both`, only in `a` or only in `b`."""
    x = a.select(column).distinct().withColumn("_a", F.lit(1))
    y = b.select(column).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return x.join(y, column, "full").select(column, side.alias("side"))
