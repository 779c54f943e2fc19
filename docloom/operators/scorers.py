"""A sentence scorer that is trained here: hashed word n-grams and a weighted logistic regression.

It stands where a fine-tuned language model would: extract.neural takes any scorer, this one runs on Spark alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.aggregates import class_weights


def train(examples: DataFrame, features: int = 1 << 16, rounds: int = 30, regularisation: float = 1e-3) -> PipelineModel:
    """examples: (text, label).  Classes weigh n / (k n_i), clipped."""
    weights = class_weights(examples, "label").select("label", "weight")
    rows = examples.select("text", F.col("label").cast("double").alias("label")).join(F.broadcast(weights.select(F.col("label").cast("double").alias("label"), "weight")), "label")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(inputCol="_words", outputCol="_w", numFeatures=features, binary=True),
        HashingTF(inputCol="_pairs", outputCol="_p", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["_w", "_p"], outputCol="features"),
        LogisticRegression(weightCol="weight", maxIter=rounds, regParam=regularisation),
    ]
    return Pipeline(stages=stages).fit(rows)


def probabilities(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """`df` with prob, the probability of label 1."""
    rows = df.withColumn("_given", F.col(text)).withColumn("text", F.coalesce(F.col(text), F.lit("")))
    kept = [F.col("_given").alias(c) if c == text else F.col(c) for c in df.columns if c != "prob"]
    return model.transform(rows).select(*kept, vector_to_array("probability")[1].alias("prob"))


def token_ids(text: Column, tokenizer: str, most: int = 512) -> Column:
    """The first `most` ids of each text by a tokenizer file that every executor can read; null text has none."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.enable_truncation(most)
        for s in batches:
            yield pd.Series([e.ids for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], index=s.index)

    return run(text)


def tokenised(tokenizer: str, load: Callable[[], Callable[[list[list[int]]], list[float]]], most: int = 512, batch: int = 32) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A scorer for extract.neural: sentences go through the tokenizer, cut at `most` ids, and to the model `batch` at a time.

    load: makes the model, once a task: lists of ids to the probabilities of class 1."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t, model = Tokenizer.from_file(tokenizer), load()
        t.enable_truncation(most)
        for s in batches:
            ids = [e.ids for e in t.encode_batch(s.tolist(), add_special_tokens=False)]
            # texts of like length share a batch, so that padding is small
            order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
            out = [0.0] * len(ids)
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                for i, p in zip(part, model([ids[i] for i in part]), strict=True):
                    out[i] = float(p)
            yield pd.Series(out)

    return run
