"""Readers: delimited text, ragged lines, JSON, archives, table sets, configurations."""

from __future__ import annotations

import ast
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELIMITERS = (",", ";", "\t")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a scan gives fewer than two partitions a core, as a small file of one row group does;
    larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def sniff_delimiter(spark: SparkSession, path: str, candidates: tuple[str, ...] = DELIMITERS) -> str:
    """The first delimiter that cuts the header into more than one column; the first candidate if none does."""
    row = spark.read.text(path).limit(1).collect()
    header = row[0][0] if row else ""
    return next((d for d in candidates if len(header.split(d)) > 1), candidates[0])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, schema: StructType | str | None = None, mode: str = "PERMISSIVE", quote: str = '"', escape: str = "\\", multiline: bool = False, limit: int | None = None) -> DataFrame:
    """Delimited text with a header; the delimiter is found if none is given.  Without a schema all columns are strings.

    A file is read in parts, line by line; texts with line ends in quotes need `multiline`, which reads a file in one task.
    Bad lines: PERMISSIVE keeps them with nulls, DROPMALFORMED leaves them out, FAILFAST stops."""
    reader = spark.read.option("header", True).option("sep", delimiter or sniff_delimiter(spark, path))
    reader = reader.option("mode", mode).option("quote", quote).option("escape", escape).option("multiLine", multiline)
    if mode != "PERMISSIVE":
        reader = reader.option("columnPruning", False)  # else a line is only as bad as the columns that are read
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.limit(limit) if limit is not None else df


def read_ragged(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Lines cut by hand: what is too many goes to the last column with its delimiters, what is too few is null.

    The header is the first line; every file that begins with it loses that line, and only that."""
    import re

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    first = lines.limit(1).collect()
    if not first:
        return lines.limit(0).drop("value", "_file", "_start")
    header = first[0][0].split(delimiter)
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    begins = lines.where("_start = 0").groupBy("_file").agg(F.min(F.struct("_id", "value")).alias("_b"))
    begins = begins.where(F.col("_b.value") == first[0][0]).select("_file", F.col("_b._id").alias("_id"))
    cut = F.split(F.col("value"), re.escape(delimiter), len(header))
    rows = lines.join(begins, ["_file", "_id"], "left_anti").select(cut.alias("_p"))
    return rows.select([F.get("_p", F.lit(i)).alias(h.strip()) for i, h in enumerate(header)])


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_column(spark: SparkSession, path: str, column: str, delimiter: str | None = None, multiline: bool = False) -> DataFrame:
    """One column of a delimited file; the scan reads no other."""
    return read_csv(spark, path, delimiter, multiline=multiline).select(column)


def tar_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(archive, member, content) of the members whose name ends so, of all archives at the path (gz, xz, bz2 or plain).

    An archive is streamed from its place, member by member, so that only a member has to fit a row.  Where the Python workers
    can't open the place (a store that only Spark reads), the archive comes as one row, which holds up to 2 GB."""
    found = spark.read.format("binaryFile").load(path)

    def members(name: str, stream) -> Iterator[pa.RecordBatch]:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(suffix):
                    data = tar.extractfile(m).read()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.name]), pa.array([data], pa.binary())], names=["archive", "member", "content"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, place = fs.FileSystem.from_uri(name)
                with where.open_input_stream(place, compression=None) as stream:
                    yield from members(name, stream)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from members(name, io.BytesIO(content.as_buffer()))

    schema = "archive string, member string, content binary"
    first = found.select("path").limit(1).collect()
    if first and _opens(first[0][0]):
        return found.select("path").mapInArrow(streamed, schema)
    return found.select("path", "content").mapInArrow(whole, schema)


def _opens(uri: str) -> bool:
    """Whether Python can open the file itself."""
    from pyarrow import fs

    try:
        where, place = fs.FileSystem.from_uri(uri)
        return where.get_file_info(place).type == fs.FileType.File
    except (OSError, ValueError, NotImplementedError):
        return False


def read_archived_csv(spark: SparkSession, path: str, delimiter: str, schema: str) -> DataFrame:
    """The first CSV member of each archive."""
    members = tar_members(spark, path, ".csv")
    first = members.groupBy("archive").agg(F.min_by("content", "member").alias("content"))
    lines = first.select(F.explode(F.slice(F.split(F.decode("content", "UTF-8"), r"\r?\n"), 2, 2**31 - 1)).alias("line")).where("line <> ''")
    return lines.select(F.from_csv("line", schema, {"sep": delimiter}).alias("r")).select("r.*")


CASE_NAME = r"^(\d{4})canlii(\d+)\.txt"


def _cases(df: DataFrame, name: Column, text: Column, pattern: str) -> DataFrame:
    file = F.element_at(F.split(name, "/"), -1)
    rows = df.select(F.regexp_extract(file, pattern, 1).alias("year"), F.regexp_extract(file, pattern, 2).alias("decisionID"), text.alias("full_text"))
    return rows.where("year <> ''")


def read_cases(spark: SparkSession, path: str, pattern: str = CASE_NAME) -> DataFrame:
    """(year, decisionID, full_text) of a folder of text files; names that don't fit are left out, bad bytes replaced."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", "_metadata.file_path")
    return _cases(files, F.col("file_path"), F.col("value"), pattern)


def read_case_archive(spark: SparkSession, path: str, pattern: str = CASE_NAME, first: int | None = None) -> DataFrame:
    """The same of archives of text files; optionally of the first members by name only."""
    members = tar_members(spark, path, ".txt")
    text = F.col("content").cast("string")
    rows = _cases(members.orderBy("member").limit(first) if first is not None else members, F.col("member"), text, pattern)
    return rows


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Those of the Parquet tables that are there."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if exists(spark, f"{folder}/{n}")}


def load_split(spark: SparkSession, folder: str, train: str = "train", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """Both tables; an error if either is missing."""
    found = load_tables(spark, folder, [train, test])
    missing = [n for n in (train, test) if n not in found]
    if missing:
        raise FileNotFoundError(f"{folder}: {', '.join(missing)}")
    return found[train], found[test]


def load_folder(spark: SparkSession, folder: str, key: str | None = None, archived: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Every CSV file of a folder by name, and the archives that `archived` gives a delimiter and a schema for, with the
    key made safe where a file has it."""
    from docloom.operators.keys import safe_id

    out = {}
    for name in names_in(spark, folder):
        if name.endswith(".csv"):
            df = read_csv(spark, f"{folder}/{name}")
        elif name in (archived or {}):
            df = read_archived_csv(spark, f"{folder}/{name}", *archived[name])
        else:
            continue
        out[name] = df.withColumn(key, safe_id(F.col(key).cast("string"))) if key and key in df.columns else df
    return out


def labelled(df: DataFrame) -> DataFrame:
    """(text, label) of examples; an error if a column is missing or a label is neither 0 nor 1."""
    from docloom.operators.keys import require

    out = require(df, ["text", "label"]).select("text", F.col("label").cast("int").alias("label"))
    bad = out.where(F.col("label").isNull() | ~F.col("label").isin(0, 1)).limit(1).collect()
    if bad:
        raise ValueError(f"labels must be 0 or 1: {bad[0]}")
    return out


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The last name in the folder, in order, that begins so."""
    found = [n for n in names_in(spark, folder) if n.startswith(prefix)]
    return f"{folder}/{found[-1]}" if found else None


def merged(defaults: dict, given: dict) -> dict:
    """A configuration: the given values over the defaults, nested."""
    out = dict(defaults)
    for k, v in given.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """A JSON (or, if the parser is installed, YAML) configuration over the defaults."""
    if path is None:
        return merged(defaults, {})
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return merged(defaults, yaml.safe_load(text) or {})
    return merged(defaults, json.loads(text))


# -- profiles --


def row_count(spark: SparkSession, path: str) -> int:
    """Lines but the header; line ends inside quotes count."""
    return max(0, spark.read.text(path).count() - 1)


def jsonl_profile(spark: SparkSession, path: str) -> DataFrame:
    """(records, key, type): the keys of the first record and their JSON types."""
    lines = spark.read.text(path).where("value <> ''")
    n = lines.count()
    first = lines.limit(1).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    kinds = F.when(F.col("v").isNull(), "null").when(F.col("v").rlike(r"^\s*\["), "array").when(F.col("v").rlike(r"^\s*\{"), "object").when(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.col("v").isin("true", "false"), "boolean").otherwise("string")
    return first.select(F.lit(n).alias("records"), "key", kinds.alias("type"))


def archive_profile(spark: SparkSession, path: str) -> DataFrame:
    """(archive, extension, members, bytes) of tar archives; nested archives are members like others."""
    members = tar_members(spark, path, "")
    extension = F.lower(F.regexp_extract("member", r"(\.[^./]+)$", 1))
    return members.groupBy("archive", extension.alias("extension")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


# -- lists kept as text by other tools --


def literal_list(c: Column) -> Column:
    """The strings of a Python list literal; anything else gives an empty list."""
    def parse(t: str | None) -> list[str]:
        try:
            v = ast.literal_eval(t) if t else []
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        return [x if isinstance(x, str) else str(x) for x in v] if isinstance(v, list) else []

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(parse)

    return run(c)


def ascii_json(c: Column) -> Column:
    """A map of strings as JSON with blanks after separators and non-ASCII characters escaped."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else json.dumps(dict(m)))

    return run(c)
