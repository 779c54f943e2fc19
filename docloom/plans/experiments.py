"""Experiments: extractors evaluated over one validation set, averages over experiments."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docloom.operators import evaluate

#: An extractor: documents to a long table with the key and text.
Extractor = Callable[[DataFrame], DataFrame]


@dataclass
class Experiment:
    name: str
    extractors: dict[str, Extractor]
    parameters: dict = field(default_factory=dict)


def run_evaluation(validation: DataFrame, extractor: Extractor, expected: DataFrame, key: str, text: str = "full_text") -> dict[str, DataFrame]:
    """metrics, summary and both reports of an extractor; expected: (key, text) of what should be found."""
    found = extractor(validation)
    metrics = evaluate.case_metrics(validation, found, key)
    texts = validation.select(key, validation[text].alias("full_text"))
    return {
        "metrics": metrics,
        "summary": evaluate.case_summary(metrics),
        "under": evaluate.under_extracted(metrics, expected, found.select(key, "text"), texts, key),
        "over": evaluate.over_extracted(metrics, expected, found.select(key, "text"), texts, key),
    }


def run_experiment(experiment: Experiment, validation: DataFrame, expected: DataFrame, key: str, text: str = "full_text") -> DataFrame:
    """(extractor, summary columns): a row for each extractor."""
    from pyspark.sql import functions as F

    rows = [run_evaluation(validation, e, expected, key, text)["summary"].select(F.lit(n).alias("extractor"), "*") for n, e in experiment.extractors.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(experiment.name).alias("experiment"), "*")


def evaluate_labels(examples: DataFrame, candidates: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Confusion of "has any candidate" against the label of each example (key, text, label)."""
    return evaluate.rounded(evaluate.confusion(evaluate.predictions_from(examples, candidates(examples), key), []))


def performance(extractor: Extractor, docs: DataFrame, key: str, path: str) -> dict:
    """Writes what an extractor finds and says how many cases there were and the milliseconds they took, in all and on average."""
    cases = docs.select(key).distinct().count()
    began = time.perf_counter()
    extractor(docs).write.mode("overwrite").parquet(path)
    total = 1000 * (time.perf_counter() - began)
    return {"cases": cases, "total_ms": total, "average_ms": total / cases if cases else 0.0}
