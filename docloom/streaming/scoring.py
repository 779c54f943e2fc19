"""Extension: scoring documents as they arrive.  The batch engine has no streams; this only runs its row-wise part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import extract


def score_stream(docs: DataFrame, key: str, text: str, least: float = 5.0, rules: R.BasicRules = R.LEGAL_BASIC) -> DataFrame:
    """(key, pos, sentence, score) of a stream of documents: no state, so no watermark."""
    rows = extract.explode_sentences(docs, [key], text)
    scored = rows.withColumn("score", extract.basic_score(F.col("sentence"), rules))
    return scored.where(F.col("score") >= least).select(key, "pos", "sentence", "score")
