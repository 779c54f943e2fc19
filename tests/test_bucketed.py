import pytest
from pyspark.sql import functions as F

from docloom.operators import enrich
from docloom.plans import preprocess
from docloom.sources import sinks


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def given(spark):
    key = preprocess.KEY
    rows = spark.range(300)
    return {
        "case_texts": rows.select(F.col("id").alias(key), F.concat(F.lit("text "), "id").alias("full_text")),
        "all_sentences": rows.select((F.col("id") % 90).alias(key), F.concat(F.lit("s"), "id").alias("Text"), F.col("id").alias("sentence_order")),
        "determination": rows.select((F.col("id") % 70).alias(key), F.concat(F.lit("d"), "id").alias("extracted_sentences_determination"), F.col("id").alias("ord")),
        "entities": rows.select((F.col("id") % 110).alias(key), F.col("id").cast("string").alias("decision_outcome")),
        "train": rows.select((F.col("id") + 20).alias(key), F.lit("x").alias("decision_outcome")),
    }


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_of_bucketed_tables_moves_nothing(spark, no_broadcast):
    tables = given(spark)
    out = preprocess.enriched(preprocess.bucketed(tables, buckets=3), "train")
    assert "Exchange" not in plan(out)
    plain = preprocess.enriched(tables, "train")
    assert plan(plain).count("Exchange") >= 5
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(out) == rows(plain) and len(rows(out)) == 300


def test_a_bucketed_table_is_plain_files_too(spark, tmp_path, no_broadcast):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    out = sinks.write_bucketed(df, "k", 4, f"file://{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == sorted(map(tuple, df.collect())) == sorted(map(tuple, out.collect()))
    both = out.join(sinks.write_bucketed(df, "k", 4).select("k", F.col("id").alias("other")), "k").groupBy("k").count()
    assert "Exchange" not in plan(both) and {r["count"] for r in both.collect()} == {100}
    assert enrich.left_unique(out, df.limit(0), "k").count() == 100
