"""The preprocessing chain as one plan: load, make keys safe, number sentences, purge duplicates, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import aggregates, dedup, enrich, keys
from docloom.sources import files, sinks

KEY = "decisionID"
TABLES = ["case_texts", "all_sentences", "determination", "train", "test", "case_cover", "entities"]


def prepared(tables: dict[str, DataFrame], key: str = KEY) -> dict[str, DataFrame]:
    """Safe keys everywhere; sentences numbered where they come without an order."""
    out = {n: df.withColumn(key, keys.safe_id(F.col(key).cast("string"))) for n, df in tables.items()}
    s = out.get("all_sentences")
    if s is not None and "sentence_order" not in s.columns:
        row = "_metadata.row_index" if "ord" not in s.columns else "ord"
        out["all_sentences"] = keys.number_rows(s, key, [F.col(row)])
    return out


def clean(tables: dict[str, DataFrame], key: str = KEY, strict: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(clean, unused, summary): the tables without duplicated ids, what left them, and the counts of each table."""
    good, unused = dedup.purge(tables, key, strict=strict)
    rows = [aggregates.validation_summary(tables[n], good[n], key).select(F.lit(n).alias("table"), "*") for n in sorted(good)]
    summary = rows[0]
    for r in rows[1:]:
        summary = summary.unionByName(r)
    return good, unused, summary


def bucketed(tables: dict[str, DataFrame], target: str | None = None, key: str = KEY, buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables dealt and sorted by key once, so that no join of the enrichment moves them again; in `target` by name where given."""
    return {n: sinks.write_bucketed(df, key, buckets, target and f"{target}/{n}") for n, df in tables.items()}


def enriched(tables: dict[str, DataFrame], base: str, key: str = KEY) -> DataFrame:
    """The named split with texts, labels, entities and sentences, one row an id."""
    return enrich.enrich(tables[base], tables["case_texts"], tables["determination"], tables["entities"], tables["all_sentences"], key)


def run(spark: SparkSession, source: str, target: str, names: list[str] | None = None) -> dict[str, str]:
    """Reads the Parquet tables of `source` and writes clean, unused, enriched tables and a report to `target`.

    Missing tables stop it before anything is written."""
    names = names or TABLES
    tables = files.load_tables(spark, source, names)
    missing = sorted(set(names) - set(tables))
    if missing:
        raise FileNotFoundError(f"{source}: {', '.join(missing)}")
    good, unused, summary = clean(prepared(tables))
    kept = bucketed(good, f"{target}/clean")
    out = {f"clean/{n}": f"{target}/clean/{n}" for n in good}
    out |= {f"unused/{n}": sinks.write_table(df, f"{target}/unused/{n}") for n, df in unused.items()}
    out |= {f"enriched/{s}": sinks.write_table(enriched(kept, s), f"{target}/enriched/{s}") for s in ("train", "test")}
    out["summary"] = sinks.write_table(summary, f"{target}/summary")
    return out


def report(spark: SparkSession, outputs: dict[str, str]) -> dict:
    """For each output whether it is there, its rows and columns."""
    found = {}
    for name, path in outputs.items():
        there = files.exists(spark, path)
        df = spark.read.parquet(path) if there else None
        found[name] = {"exists": there, "rows": df.count() if there else 0, "columns": df.columns if there else []}
    return found
