"""Writers."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the one that the cluster's machines share; a local session without one gets a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/docloom/io-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder once for those who read it several times; it stays there."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, path: str | None = None, name: str | None = None) -> DataFrame:
    """The table in files dealt by `key` and sorted by it, so that joins, groupings and windows on the key read it as it lies.

    Tables of one number of buckets (by default that of shuffle partitions) fit each other.  They are known to the session's catalog
    as `name`; their files are at `path`, by default in the shared folder."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"bucketed_{uuid.uuid4().hex}"
    # one file a bucket: dealt as the buckets are
    df.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path or scratch(spark)).saveAsTable(name)
    return spark.table(name)


def flat(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats without them."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)})


def write_csv(df: DataFrame, path: str, quote_all: bool = False, escape: str = "\\") -> str:
    """With a header; read back by files.read_csv with the same escape.  Nested columns become JSON."""
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", escape).csv(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


#: Characters of JSON in one array, unless a single record is longer: an array is read back whole, by one task.
ARRAY_CHARS = 1 << 25


def write_json_array(df: DataFrame, path: str, chars: int = ARRAY_CHARS) -> str:
    """JSON arrays of about `chars` characters, each a line and a file of its own, without moving rows."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def bracketed(batches):
        import pyarrow as pa

        held, size, none = [], 0, True

        def array():
            return pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"], pa.string())], names=["value"])

        for batch in batches:
            for v in batch.column(0).to_pylist():
                if held and size + len(v) > chars:
                    yield array()
                    held, size, none = [], 0, False
                held.append(v)
                size += len(v)
        if held or none:
            yield array()

    lines.mapInArrow(bracketed, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def plain(value):
    """What JSON can hold: numbers, text, lists and maps of such; anything else as text."""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    return value if isinstance(value, str | int | float | bool) or value is None else str(value)


def write_report(spark: SparkSession, report: dict, path: str) -> str:
    """A small report as one JSON text."""
    spark.createDataFrame([(json.dumps(plain(report), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def run_name(name: str, at: datetime | None = None) -> str:
    """A file-safe name with a time stamp."""
    return f"{re.sub(r'[^A-Za-z0-9_-]+', '_', name).strip('_')}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
