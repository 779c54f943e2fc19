"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, \x20 and \x09-\x0D: what separates words everywhere here.
WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]+"

#: Rows up to which a two-column table (some 16 bytes a row) may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where it is unset in a local session (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Paths made inside each open `intermediates`, innermost last.
_MADE: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are made inside at its end: for steps whose result is then written elsewhere."""
    _MADE.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, _MADE.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What `df` makes, written to the shared folder; the tables made on the way are deleted."""
    path = shared_path(spark, name)
    with intermediates(spark):
        made = df()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage with a table in the shared folder; survives the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of plans that have ended: it does so when their objects are collected.

    The end of a plan is told to listeners, which hold it for a moment."""
    gc.collect()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def words_of(column: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(text_or_empty(column), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS))


def let(value: Column, body) -> Column:
    """Binds `value` once for `body`, so that a lambda can index into it without computing it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_checked(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with (or, as left_anti, without) the keys of the one-column table `ids`.

    `ids` is counted first and broadcast up to `rows` rows of a bigint; beyond that both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if ids.count() <= rows else ids, key, how)
