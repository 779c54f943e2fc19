"""Ordered grouping and cardinality-preserving enrichment of a base table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.containment import touched_within
from docloom.operators.dedup import first_by
from docloom.operators.keys import suffixed
from docloom.sources.sinks import stored


def joined_text(df: DataFrame, key: str, text: str, order: str, name: str = "sentence_text", separator: str = " ") -> DataFrame:
    """One row a key: its texts in order, joined; null texts count as empty.

    Ties of the order are put in the order of the texts, so the result doesn't depend on the partitioning."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(name))


def listed(df: DataFrame, key: str, value: str, order: str, name: str, count: str) -> DataFrame:
    """One row a key: its values in order as a list, nulls kept, and their number."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(parts, lambda x: x["v"]).alias(name), F.count(F.lit(1)).alias(count))


def left_unique(base: DataFrame, right: DataFrame, key: str, order: list[Column] | None = None, suffix: str = "_estimated") -> DataFrame:
    """base left join right, of which only the first row of a key counts: the rows of base stay as many.

    Columns of both sides keep the base's under their name and the right's under the suffix."""
    one = first_by(right, [key], order) if order else right.dropDuplicates([key])
    return base.join(suffixed(base, one, key, suffix), key, "left")


def filled(df: DataFrame, counts: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Null counts become 0, null lists empty."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts} | {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in lists})


def enrich(base: DataFrame, texts: DataFrame, labels: DataFrame, entities: DataFrame, sentences: DataFrame, key: str = "decisionID", unique_base: bool = True) -> DataFrame:
    """The enriched table: texts, label lists with counts, entities and joined sentences, one row a base row.

    texts (key, full_text), labels (key, extracted_sentences_determination, ord), entities (key, ...),
    sentences (key, Text, sentence_order)."""
    if unique_base:
        base = first_by(base, [key], [F.col(c).asc_nulls_last() for c in base.columns if c != key] or [F.col(key)])
    grouped = listed(labels, key, "extracted_sentences_determination", "ord", "extracted_sentences_determination", "determination_count")
    out = left_unique(base, texts, key, [F.col("full_text").asc_nulls_last()])
    out = filled(left_unique(out, grouped, key), ("determination_count",), ("extracted_sentences_determination",))
    out = left_unique(out, entities, key, [F.col(c).asc_nulls_last() for c in entities.columns if c != key])
    return left_unique(out, joined_text(sentences, key, "Text", "sentence_order"), key)


def unmatched(expected: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `expected` that no text of the same key in `found` contains or is contained in (lower case, trimmed)."""
    low = F.lower(F.trim(F.col(text)))
    one = stored(expected.select(F.col(key).alias("key"), low.alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()))
    hit = one.join(touched_within(one, found.select(F.col(key).alias("key"), low.alias("t"))), "id").select(F.col("key").alias("_k"), F.col("t").alias("_t"))
    return expected.join(hit, (F.col(key) == F.col("_k")) & (low == F.col("_t")), "left_anti")
