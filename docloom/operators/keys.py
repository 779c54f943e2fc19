"""Row keys and casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING, NOT_A_NUMBER = -1, -999


def safe_id(c: Column) -> Column:
    """bigint; null becomes MISSING and text that is no number NOT_A_NUMBER; fractions are cut."""
    number = c.try_cast("double")
    return F.when(c.isNull(), F.lit(MISSING)).when(number.isNull() | F.isnan(number), F.lit(NOT_A_NUMBER)).otherwise(F.floor(F.abs(number)) * F.signum(number)).cast("bigint")


def lenient_id(c: Column) -> Column:
    """bigint; whatever isn't a number becomes MISSING."""
    return F.when(safe_id(c) == NOT_A_NUMBER, F.lit(MISSING).cast("bigint")).otherwise(safe_id(c))


def to_number(c: Column) -> Column:
    """double or null."""
    return c.try_cast("double")


def number_rows(df: DataFrame, key: str, order: list[Column], name: str = "sentence_order") -> DataFrame:
    """The place of each row among those of its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has."""
    return df.select([c for c in columns if c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def suffixed(left: DataFrame, right: DataFrame, on: str, suffix: str = "_estimated") -> DataFrame:
    """`right` with those of its columns renamed that `left` has too."""
    return right.select([F.col(c).alias(f"{c}{suffix}" if c in left.columns and c != on else c) for c in right.columns])


def keep_scored(c: Column, least: float) -> Column:
    """The records of a list whose score is at least `least`."""
    return F.filter(c, lambda x: x["score"] >= least)


def hash_text(*columns: str | Column, seed: int = 42) -> Column:
    """32 hexadecimal digits that follow from the seed and the columns' texts; null counts as an empty text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]))


def hash_number(*columns: str | Column, seed: int = 42) -> Column:
    """The same as a bigint from 0 to 2^32 - 1."""
    return F.conv(F.substring(hash_text(*columns, seed=seed), 1, 8), 16, 10).cast("bigint")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones each time: the smallest hashes of the key."""
    return df.orderBy(hash_text(key, seed=seed), key).limit(n)
