"""Evaluation of extractors and scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.enrich import unmatched


def case_metrics(cases: DataFrame, found: DataFrame, key: str, expected: str = "determination_count") -> DataFrame:
    """(key, extracted_count, expected_count, count_ratio) of every case; found: a row for each extraction."""
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = cases.select(key, F.coalesce(F.col(expected), F.lit(0)).cast("bigint").alias("expected_count")).join(counts, key, "left")
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return out.select(key, n.alias("extracted_count"), "expected_count", (n / F.greatest(F.lit(1), F.col("expected_count"))).alias("count_ratio"))


def case_summary(metrics: DataFrame) -> DataFrame:
    """The means, and how many cases reach what is expected; of no cases 0 and nulls."""
    met = F.count_if(F.col("count_ratio") >= 1)
    return metrics.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("extracted_count", "expected_count", "count_ratio")],
        met.alias("cases_meeting_expected"),
        F.count(F.lit(1)).alias("total_cases"),
        F.try_divide(met, F.count(F.lit(1))).alias("pct_meeting_expected"),
    )


def clipped(text: Column, n: int = 2000) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(text)


def _report(metrics: DataFrame, left: DataFrame, right: DataFrame, texts: DataFrame, key: str, text: str, gap: Column, name: str, cases: int) -> DataFrame:
    """The `cases` rows of `metrics` of the largest gap with their unmatched rows of `left` and a clipped text."""
    top = metrics.withColumn("gap", gap).orderBy(F.desc("gap"), key).limit(cases)
    lone = unmatched(left.join(top.select(key), key, "left_semi"), right.join(top.select(key), key, "left_semi"), key, text)
    lists = lone.groupBy(key).agg(F.sort_array(F.collect_list(text)).alias(name))
    out = top.join(lists, key, "left").join(texts.select(key, clipped(F.col("full_text")).alias("case_text")), key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).orderBy(F.desc("gap"), key)


def under_extracted(metrics: DataFrame, expected: DataFrame, found: DataFrame, texts: DataFrame, key: str, text: str = "text", ratio: float = 0.5, cases: int = 20) -> DataFrame:
    """The cases that lack most: more than one expected, a ratio below `ratio`; with the expected texts nobody found."""
    low = metrics.where((F.col("expected_count") > 1) & (F.col("count_ratio") < ratio))
    return _report(low, expected, found, texts, key, text, F.col("expected_count") - F.col("extracted_count"), "missing", cases)


def over_extracted(metrics: DataFrame, expected: DataFrame, found: DataFrame, texts: DataFrame, key: str, text: str = "text", extra: int = 2, cases: int = 20) -> DataFrame:
    """The cases with most beyond what is expected (at least one): more than `extra` too many; with the texts nobody expected."""
    high = metrics.where((F.col("expected_count") >= 1) & (F.col("extracted_count") > F.col("expected_count") + extra))
    return _report(high, found, expected, texts, key, text, F.col("extracted_count") - F.col("expected_count"), "extra", cases)


def confusion(df: DataFrame, group: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall, f1 (0 where undefined) of each group."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    out = df.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def rounded(metrics: DataFrame, digits: int = 4) -> DataFrame:
    return metrics.withColumns({c: F.round(c, digits) for c in ("accuracy", "precision", "recall", "f1")})


def sweep(df: DataFrame, thresholds: list[float], label: str = "label", prob: str = "prob") -> DataFrame:
    """The confusion of `prob > t` for every threshold t.

    The number of rows doesn't grow: a row of counts is made for each interval between thresholds, and the thresholds'
    counts are sums over these."""
    ordered = sorted(thresholds)
    place = F.aggregate(F.array(*[F.lit(t) for t in ordered]), F.lit(0), lambda n, t: n + F.when(F.col(prob) > t, 1).otherwise(0))
    bins = df.groupBy(place.alias("_place")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    marks = df.sparkSession.createDataFrame(list(enumerate(ordered)), "_i int, threshold double")
    above = F.col("_place") > F.col("_i")
    pairs = marks.crossJoin(F.broadcast(bins))  # at most thresholds x (thresholds + 1) rows
    s = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    out = pairs.groupBy("threshold").agg(s("pos", above).alias("tp"), s("neg", above).alias("fp"), s("pos", ~above).alias("fn"), s("neg", ~above).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


#: Thresholds of a full sweep, and those of the choice by recall and by F1.
SWEEP = [round(0.20 + 0.01 * i, 2) for i in range(30)]


def best_threshold(swept: DataFrame, metric: str, least_precision: float = 0.0) -> DataFrame:
    """The row of the highest metric, the lowest threshold on ties, among those of enough precision."""
    return swept.where(F.col("precision") >= least_precision).orderBy(F.desc(metric), "threshold").limit(1)


def mispredictions(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The wrong rows with error_type FP or FN."""
    return df.where(F.col(label) != F.col(pred)).withColumn("error_type", F.when(F.col(pred) == 1, "FP").otherwise("FN"))


def error_shares(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """How many rows are FP and FN, and their percent of all."""
    fp, fn, n = F.count_if((F.col(pred) == 1) & (F.col(label) != 1)), F.count_if((F.col(pred) != 1) & (F.col(label) == 1)), F.count(F.lit(1))
    share = lambda c: F.coalesce(F.try_divide(c * 100.0, n), F.lit(0.0))
    return df.agg(fp.alias("fp"), fn.alias("fn"), share(fp).alias("fp_pct"), share(fn).alias("fn_pct"))


def predictions_from(examples: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """`examples` with pred 1 where an extractor has a candidate, else 0."""
    hit = candidates.select(key).distinct().withColumn("_hit", F.lit(1))
    return examples.join(hit, key, "left").withColumn("pred", F.coalesce("_hit", F.lit(0))).drop("_hit")


# -- ensembles; votes: (example, model, pred[, prob], label), a row for each --


def majority(votes: DataFrame, example: str, threshold: float = 0.667) -> DataFrame:
    """The share of votes for 1 and whether it reaches the threshold.  With 0.667 two of three don't."""
    out = votes.groupBy(example).agg(F.avg("pred").alias("share"), F.max("label").alias("label"))
    return out.withColumn("pred", (F.col("share") >= threshold).cast("int"))


def vote_sweep(votes: DataFrame, example: str, thresholds: tuple[float, ...] = (0.5, 0.6, 0.667, 0.75)) -> DataFrame:
    """The confusion of the majority at each threshold; every example is expanded to that many rows."""
    shares = majority(votes, example).select(example, "share", "label", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return confusion(shares.withColumn("pred", (F.col("share") >= F.col("threshold")).cast("int")), ["threshold"])


def error_overlap(votes: DataFrame, example: str) -> DataFrame:
    """(m1, m2, both, only1, only2, total1, total2) for each pair of models, from the examples that any gets wrong.

    The models of an example meet in one row, so the pairs of models are made there and not of all rows."""
    wrong = votes.groupBy(example).agg(F.sort_array(F.collect_set("model")).alias("all"), F.collect_set(F.when(F.col("pred") != F.col("label"), F.col("model"))).alias("bad"))
    bad = lambda m: F.array_contains("bad", m)
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.filter("all", lambda b, j: j > i), lambda b: F.struct(a.alias("m1"), b.alias("m2"), bad(a).alias("e1"), bad(b).alias("e2")))))
    rows = wrong.select(F.explode(pairs).alias("p")).select("p.*")
    return rows.groupBy("m1", "m2").agg(F.count_if(F.col("e1") & F.col("e2")).alias("both"), F.count_if(F.col("e1") & ~F.col("e2")).alias("only1"), F.count_if(~F.col("e1") & F.col("e2")).alias("only2"), F.count_if("e1").alias("total1"), F.count_if("e2").alias("total2"))


def wide_votes(votes: DataFrame, example: str, models: list[str]) -> DataFrame:
    """One row an example: {model}_pred, {model}_prob and {model}_error, the label, and how many models err."""
    pick = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    out = votes.groupBy(example).agg(F.max("label").alias("label"), *[pick(c, m).alias(f"{m}_{c}") for m in models for c in ("pred", "prob")])
    errors = {f"{m}_error": (F.col(f"{m}_pred") != F.col("label")) for m in models}
    out = out.withColumns(errors)
    total = F.lit(0)
    for m in models:
        total = total + F.coalesce(F.col(f"{m}_error").cast("int"), F.lit(0))
    return out.withColumn("errors", total)


def agreement(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """`df` with status: both_correct, only_{a}, only_{b} or both_wrong."""
    x, y = F.col(a) == F.col(label), F.col(b) == F.col(label)
    return df.withColumn("status", F.when(x & y, "both_correct").when(x, f"only_{a}").when(y, f"only_{b}").otherwise("both_wrong"))


