"""Building labelled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.operators.dedup import without_values
from docloom.operators.keys import hash_number, hash_text, present

SEED = 42


def validation_set(train: DataFrame, test: DataFrame, columns: list[str], count: str = "determination_count", least_train: int = 4, least_test: int = 0) -> DataFrame:
    """Train rows of enough labels and test rows, of which the listed columns that are there."""
    both = train.where(F.col(count) >= least_train).unionByName(test.where(F.col(count) >= least_test), allowMissingColumns=True)
    return present(both, columns)


def silver_candidates(docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, column, place, text) of extraction lists, one row a record; absent columns are skipped."""
    have = [c for c in columns if c in docs.columns]

    def records(c: str) -> Column:
        full = F.coalesce(F.col(c), F.array().cast(docs.schema[c].dataType))
        return F.transform(full, lambda r, i: F.struct(F.lit(c).alias("column"), i.alias("place"), r["text"].alias("text")))

    items = F.flatten(F.array(*[records(c) for c in have]))
    return docs.select(key, F.explode(items).alias("_r")).select(key, "_r.*")


def silver_positives(candidates: DataFrame, key: str, high: tuple[str, ...] = R.HIGH_PRECISION, low: tuple[str, ...] = R.LOW_PRECISION, keywords: tuple[str, ...] = R.TRAINING_KEYWORDS, longest: int = 200) -> DataFrame:
    """`candidates` with the cleaned text and its status: accepted, duplicate, empty, too_long or no_keyword.

    High-precision columns are accepted as they are, low-precision ones with a keyword.  Of equal texts (case aside) the first
    stays, by column in the given order, key and place."""
    order = F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for i, c in enumerate((*high, *low))], F.lit(len(high) + len(low)))
    rows = candidates.where(F.col("column").isin(*high, *low)).withColumn("cleaned", T.clean_for_training(F.col("text")))
    sure = F.col("column").isin(*high)
    status = F.when(F.char_length("cleaned") > longest, "too_long").when(~sure & ~T.has_keyword(F.col("cleaned"), keywords), "no_keyword").when(F.col("cleaned") == "", "empty").otherwise("accepted")
    rows = rows.withColumn("status", status)
    rank = F.row_number().over(Window.partitionBy(F.lower(F.trim("cleaned")), F.col("status")).orderBy(order, key, "place"))
    return rows.withColumn("status", F.when((F.col("status") == "accepted") & (rank > 1), "duplicate").otherwise(F.col("status")))


def silver_set(judged: DataFrame) -> DataFrame:
    """(text, label) of the accepted rows."""
    return judged.where("status = 'accepted'").select(F.col("cleaned").alias("text"), F.lit(1).alias("label"))


def silver_statistics(judged: DataFrame) -> DataFrame:
    """For each column how many rows have each status."""
    names = ("accepted", "duplicate", "empty", "too_long", "no_keyword")
    return judged.groupBy("column").agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def split_first(df: DataFrame, n: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(the first n rows in hash order, the others) of a table of simple columns; equal rows are interchangeable.

    Rows go by the first digits of their hash.  Only the rows whose first digits are those of row n are put in order, and of
    those equal ones are a single row with their number, so neither a large table nor a hot row meets in one task."""
    digits = F.substring("_h", 1, 4)
    rows = df.withColumn("_h", hash_text(*df.columns, seed=seed))
    before, edge = 0, None
    for prefix, count in sorted(tuple(r) for r in rows.groupBy(digits.alias("d")).count().collect()):
        if before + count >= n:
            edge = prefix
            break
        before += count
    if n <= 0 or edge is None:
        none = df.limit(0)
        return (none, df) if n <= 0 else (df, none)
    at_edge = rows.where(digits == edge).groupBy("_h", *df.columns).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_h", *df.columns)) - F.col("_n")
    at_edge = at_edge.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_n"), n - before - earlier)))
    times = lambda k: at_edge.select(*df.columns, F.explode(F.array_repeat(F.lit(1), k.cast("int")))).select(*df.columns)
    return rows.where(digits < edge).select(*df.columns).unionByName(times(F.col("_take"))), rows.where(digits > edge).select(*df.columns).unionByName(times(F.col("_n") - F.col("_take")))


def train_test(annotated: DataFrame, silver: DataFrame, share: float = 0.9, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) of (text, label).  Label 1 goes to the test set; label 2 becomes 0 and is split by `share`; as many
    of label 0 go to the test set as it needs to balance; the rest and the silver rows are for training.

    A row that equals a test row is never trained on."""
    of = lambda label: annotated.where(F.col("label") == label).select("text", F.when(F.col("label") == 1, 1).otherwise(0).alias("label"))
    counts = annotated.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 2)).first()
    kept = int(counts[1] * share)
    two_train, two_test = split_first(of(2), kept, seed)
    zero_test, _ = split_first(of(0), counts[0] - (counts[1] - kept), seed)
    train = without_values(of(0), zero_test, ["text", "label"]).unionByName(two_train).unionByName(silver.select("text", "label"))
    return train, of(1).unionByName(zero_test).unionByName(two_test)


def random_split(df: DataFrame, key: str, share: float = 0.85, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """About `share` of the rows and the others, by the hash of the key."""
    first = hash_number(key, seed=seed) < int(share * (1 << 32))
    return df.where(first), df.where(~first)


def by_length(df: DataFrame, text: str) -> DataFrame:
    """Ordered by number of words."""
    return df.withColumn("n_words", F.size(T.words(F.col(text)))).orderBy("n_words", text)


def span_classes(annotations: DataFrame, label: str = "DETERMINATION", word: str = "determination") -> DataFrame:
    """(text, label) of annotated texts: see functions.text.span_class."""
    spans = F.col("spans") if "spans" in annotations.columns else F.lit(None).cast("array<struct<label:string>>")
    return annotations.select("text", T.span_class(F.col("text"), spans, label, word).alias("label"))
