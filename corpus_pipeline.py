"""A corpus pipeline of the training-data operators: raw documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from docloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    return line_dedup.clean(docs, "source", "text").withColumn("n_chars", F.char_length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return near_dedup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents repeat where their source is drawn more than once."""
    return mixing.mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("mixing", mixed), ("packing", packed)]

#: Near copies, the hypergeometric draws and the tokenizer have no SQL form; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again in the shared folder; what a stage made on its way is deleted
    when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
