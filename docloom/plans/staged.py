"""The staged extraction pipeline: stages by name, each fed by the one before, each written as a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import aggregates, extract, sections
from docloom.sources import files, sinks

DEFAULTS = {
    "name": "extraction",
    "key": "decisionID",
    "text": "full_text",
    "active_stages": ["sparse", "basic"],
    "sections": ["decision_headers_text", "analysis_headers_text", "reasons_headers_text", "conclusion_headers_text"],
    "sparse": {},
    "basic": {"min_score": 5.0},
    "ngram": {"min_score": 15.0, "min_gram": 2, "max_gram": 4, "threshold": 0.65},
    "neural": {"threshold": 0.5},
}


@dataclass
class Context:
    """What stages share: packs, training examples (column text) and scorers by stage name."""

    sparse: R.SparseRules = R.LEGAL_SPARSE
    basic: R.BasicRules = R.LEGAL_BASIC
    ngram: R.NgramRules = R.LEGAL_NGRAM
    headers: R.HeaderRules = R.LEGAL_HEADERS
    outcomes: R.OutcomeRules = R.LEGAL_OUTCOMES
    examples: DataFrame | None = None
    scorers: dict[str, Callable] = field(default_factory=dict)


def _sections(df: DataFrame, config: dict) -> list[str]:
    return [s for s in config["sections"] if s in df.columns]


def text_stage(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    return sections.preprocess(df, config["text"], ctx.headers, ctx.outcomes).drop("headers", "sections")


def _one_section(df: DataFrame, config: dict, ctx: Context) -> tuple[DataFrame, DataFrame]:
    text = extract.scored_text(df, _sections(df, config)) if "cleaned_text" in df.columns else F.col(config["text"])
    return df, df.select(config["key"], F.lit("sparse_explicit").alias("section"), text.alias("text"))


def sparse_stage(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    """sparse_explicit_extraction and its count, from the joined sections or else the cleaned text."""
    key = config["key"]
    df, docs = _one_section(df, config, ctx)
    long = extract.sparse(docs, [key, "section"], "text", ctx.sparse)
    out = extract.pivot_extractions(df, long, key, ["sparse_explicit"], "x")
    return out.withColumnsRenamed({"sparse_explicit_x_extraction": "sparse_explicit_extraction", "sparse_explicit_x_extraction_count": "sparse_explicit_extraction_count"})


def _by_section(df: DataFrame, config: dict, model: str, run: Callable[[DataFrame, list[str]], DataFrame], least: float | None) -> DataFrame:
    """All sections in one pass over a long table."""
    key, names = config["key"], [*(["cleaned_text"] if "cleaned_text" in df.columns else []), *_sections(df, config)]
    long = run(extract.unpivot_sections(df, key, names), [key, "section"])
    return extract.pivot_extractions(df, long, key, names, model, least)


def basic_stage(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    return _by_section(df, config, "basic", lambda d, k: extract.basic(d, k, "text", ctx.basic, ctx.examples), config["basic"]["min_score"])


def ngram_stage(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    from dataclasses import replace

    c = config["ngram"]
    rules = replace(ctx.ngram, min_gram=c["min_gram"], max_gram=c["max_gram"], threshold=c["threshold"])
    examples = ctx.examples if ctx.examples is not None else df.sparkSession.createDataFrame([], "text string")
    bank = extract.gram_bank(examples, rules)
    return _by_section(df, config, "ngram", lambda d, k: extract.ngram(d, k, "text", bank, rules), c["min_score"])


def neural_stage(name: str) -> Callable[[DataFrame, dict, Context], DataFrame]:
    def run(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
        threshold = config.get(name, config["neural"])["threshold"]
        return _by_section(df, config, name, lambda d, k: extract.neural(d, k, "text", ctx.scorers[name], threshold), None)

    return run


STAGES: dict[str, Callable[[DataFrame, dict, Context], DataFrame]] = {"text_processing": text_stage, "sparse": sparse_stage, "basic": basic_stage, "ngram": ngram_stage}


def stage(name: str) -> Callable[[DataFrame, dict, Context], DataFrame]:
    """A stage by name; names that begin with `neural` need a scorer of that name."""
    if name in STAGES:
        return STAGES[name]
    if name.startswith("neural"):
        return neural_stage(name)
    raise ValueError(f"unknown stage: {name}")


def statistics(df: DataFrame) -> dict:
    """For each count column: records and documents that have any."""
    names = [c for c in df.columns if c.endswith("_extraction_count")]
    if not names:
        return {}
    row = df.agg(*[F.sum(c).alias(c) for c in names], *[F.count_if(F.col(c) > 0).alias(f"{c}_docs") for c in names]).first()
    return {c: {"total": row[c] or 0, "documents": row[f"{c}_docs"] or 0} for c in names}


def run(spark: SparkSession, source: DataFrame, target: str, config: dict | None = None, ctx: Context | None = None) -> dict:
    """Runs the active stages and returns a report: for each its path, rows, columns and statistics.

    A stage that fails stops the run."""
    config, ctx = files.merged(DEFAULTS, config or {}), ctx or Context()
    folder = f"{target}/{sinks.run_name(config['name'])}"
    df, done = source, []
    for name in config["active_stages"]:
        path = sinks.write_table(stage(name)(df, config, ctx), f"{folder}/{name}")
        df = spark.read.parquet(path)
        done.append({"stage": name, "path": path, "rows": df.count(), "columns": len(df.columns), "statistics": statistics(df)})
    out = {"config": config, "stages": done, "final": done[-1]["path"] if done else None}
    sinks.write_report(spark, out, f"{folder}/report")
    return out


def section_report(wide: DataFrame, section: str, model: str, key: str, expected: str = "determination_count") -> DataFrame:
    """Mean, median and deviation of a section's counts among documents that have the section."""
    n = f"{section}_{model}_extraction_count"
    has = f"has_{section.removesuffix('_text')}"
    rows = wide.where(F.col(has)) if has in wide.columns else wide
    return aggregates.describe(rows.select(F.lit(section).alias("section"), F.lit(model).alias("model"), n, expected), ["section", "model"], n, expected)
