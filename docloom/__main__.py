"""Command line: whole chains, single extraction stages, training and evaluation.

clean SOURCE TARGET; merge SOURCE TARGET; preprocess SOURCE TARGET (both); extract INPUT TARGET [--config FILE] [--stage NAME ...];
sparse, basic, ngram INPUT TARGET; neural INPUT TARGET --model MODEL; train EXAMPLES MODEL; split ANNOTATED SILVER TARGET;
evaluate INPUT EXPECTED --extractor NAME; headers INPUT KEY TEXT.  Tables are Parquet, EXAMPLES, ANNOTATED and SILVER JSON lines.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="docloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preprocess", help="clean and enrich a folder of Parquet tables")
    p.add_argument("source")
    p.add_argument("target")
    p = commands.add_parser("extract", help="run extraction stages over a Parquet table")
    p.add_argument("input")
    p.add_argument("target")
    p.add_argument("--config")
    p.add_argument("--stage", action="append", help="an active stage, in order; may be given again")
    p.add_argument("--limit", type=int)
    for name in ("clean", "merge"):
        p = commands.add_parser(name, help=f"only {name} a folder of Parquet tables")
        p.add_argument("source")
        p.add_argument("target")
    for name in ("sparse", "basic", "ngram", "neural"):
        p = commands.add_parser(name, help=f"the {name} stage alone")
        p.add_argument("input")
        p.add_argument("target")
        p.add_argument("--config")
        p.add_argument("--limit", type=int)
        if name == "neural":
            p.add_argument("--model", required=True)
            p.add_argument("--threshold", type=float, default=0.5)
    p = commands.add_parser("train", help="fit the sentence scorer on labelled JSON lines")
    p.add_argument("input")
    p.add_argument("target")
    p = commands.add_parser("split", help="train and test tables of annotated and silver examples")
    p.add_argument("input")
    p.add_argument("silver")
    p.add_argument("target")
    p = commands.add_parser("evaluate", help="an extractor against the number of expected hits")
    p.add_argument("input")
    p.add_argument("expected", help="Parquet of (key, text)")
    p.add_argument("--extractor", choices=["sparse", "basic"], default="basic")
    p.add_argument("--key", default="decisionID")
    p.add_argument("--text", default="full_text")
    p = commands.add_parser("headers", help="frequent header lines of a Parquet table")
    p.add_argument("input")
    p.add_argument("key")
    p.add_argument("text")
    p.add_argument("--least", type=int, default=5)
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    spark = SparkSession.builder.appName(f"docloom {a.command}").getOrCreate()
    from pyspark.ml import PipelineModel
    from pyspark.sql import functions as F

    from docloom.functions import text as T
    from docloom.operators import datasets, enrich, extract, scorers, sections
    from docloom.plans import experiments, preprocess, staged
    from docloom.sources import files, sinks

    if a.command == "preprocess":
        print(json.dumps(preprocess.report(spark, preprocess.run(spark, a.source, a.target)), indent=2))
    elif a.command in ("clean", "merge"):
        tables = preprocess.prepared(files.load_tables(spark, a.source, preprocess.TABLES))
        made = preprocess.clean(tables)[0] if a.command == "clean" else {s: preprocess.enriched(tables, s) for s in ("train", "test") if s in tables}
        print(json.dumps(preprocess.report(spark, {n: sinks.write_table(df, f"{a.target}/{n}") for n, df in made.items()}), indent=2))
    elif a.command == "train":
        scorers.train(files.labelled(files.read_jsonl(spark, a.input))).write().overwrite().save(a.target)
    elif a.command == "split":
        train, test = datasets.train_test(files.read_jsonl(spark, a.input, "text string, label int"), files.read_jsonl(spark, a.silver, "text string, label int"))
        print(json.dumps(preprocess.report(spark, {n: sinks.write_table(df, f"{a.target}/{n}") for n, df in (("train", train), ("test", test))}), indent=2))
    elif a.command == "evaluate":
        docs, expected = spark.read.parquet(a.input), spark.read.parquet(a.expected)
        counted = docs.drop("determination_count").join(expected.groupBy(a.key).agg(F.count(F.lit(1)).alias("determination_count")), a.key, "left")
        chosen = {"sparse": extract.Sparse(), "basic": extract.Basic()}[a.extractor]
        found = experiments.run_evaluation(enrich.filled(counted, ("determination_count",)), lambda d: chosen.extract(d, [a.key], a.text), expected, a.key, a.text)
        print(json.dumps(sinks.plain(found["summary"].first().asDict()), indent=2))
    elif a.command == "neural":
        config = files.load_config(spark, a.config, staged.DEFAULTS)
        df = spark.read.parquet(a.input)
        names = [c for c in ("cleaned_text", *config["sections"]) if c in df.columns] or [config["text"]]
        long = extract.unpivot_sections(df.orderBy(config["key"]).limit(a.limit) if a.limit else df, config["key"], names)
        rows = extract.explode_sentences(long, [config["key"], "section"], "text", T.model_sentences)
        scored = scorers.probabilities(rows.withColumnRenamed("sentence", "text"), PipelineModel.load(a.model)).where(F.col("prob") >= a.threshold)
        print(json.dumps(preprocess.report(spark, {"neural": sinks.write_table(scored.drop("n"), a.target)}), indent=2))
    elif a.command in ("extract", "sparse", "basic", "ngram"):
        stages = [a.command] if a.command != "extract" else a.stage
        config = files.load_config(spark, a.config, staged.DEFAULTS) | ({"active_stages": stages} if stages else {})
        df = spark.read.parquet(a.input)
        out = staged.run(spark, df.orderBy(config["key"]).limit(a.limit) if a.limit else df, a.target, config)
        print(json.dumps(out["stages"], indent=2))
    else:
        lines = sections.header_lines(spark.read.parquet(a.input), a.key, a.text)
        sections.true_headers(sections.header_counts(lines, a.least)).orderBy("count", ascending=False).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
