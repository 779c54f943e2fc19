"""Quality rules with risk-controlled cutoffs.  DataFrame functions only on the rows; the driver sees counts.

Four measures of a text are compared with cutoffs: symbols a word, repeated lines a line, mean word length and
the share of words in repeated three-word windows.  For every stratum the cutoffs come from labelled documents
of good quality.  The candidates of a rule are tested from the laxest to the strictest; for each, the exact
binomial tail P(Bin(n, risk) <= k) of its k rejections among n good documents is the p-value of "it rejects more
than `risk` of the good documents".  Testing stops at the first candidate that isn't significant (a fixed
sequence needs no correction along itself) and the level is split over all rules and strata (Bonferroni).  So
with probability 1 - `level`, no rule in any stratum rejects more than `risk` of good documents.

Defined cases: a null or blank text has no words and fails the base rule; a null stratum is a stratum of its own;
names starting with `_qr_` are reserved; a stratum without enough labels gets no cutoffs and only the base rule holds there; several labels of one
document count as good only if all are 1; repeated rows are judged alike; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, WS_CHARS, let, materialize, semi_checked, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
#: Candidate cutoffs of each rule, laxest first; a text is rejected above its cutoff.
CANDIDATES = {
    "symbols": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "word_length": (14.0, 12.0, 10.0, 9.0, 8.0, 7.0, 6.5),
    "repeats": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
}
MIN_WORDS = 50


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window occurring at least twice in the text.

    Windows are named by their XXH64; two different ones of a text share a name with a chance of n^2 / 2^65.  Only texts that repeat a window sort (window, place) pairs; the places of
    repeated windows, in order, then cover min(3, gap to the next) words each.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            near = lambda x, i: (F.get(p, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, i + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.transform(F.filter(p, near), lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(at, i - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))

        return let(let(pairs, places), total)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(counted)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _measured(text: Column, words: Column) -> Column:
    """struct of the STATISTICS of a text that isn't null."""

    def of(words: Column) -> Column:
        return let(
            _lines(text),
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.translate(text, WS_CHARS, "")).cast("long").alias("word_chars"),
                (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
            ),
        )

    return let(words, of)


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    t = text_or_empty(text)
    m = docs.select(*keep, _measured(t, words_of(t)).alias("_qr_m"))
    return m.select(*keep, *[F.col(f"_qr_m.{n}").alias(n) for n in STATISTICS])


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    """of: gives a statistic by name."""
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def measures(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The measured value of each rule, from the statistics."""
    share = lambda a, b: of(a) / F.greatest(of(b), F.lit(1))
    return {
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from logarithms."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(counts: dict, n: int, risk: float, level: float) -> dict[str, float | None]:
    """The strictest certified cutoff of each rule.  counts: rule -> rejections for each candidate, in order."""
    out: dict[str, float | None] = {}
    for rule, candidates in CANDIDATES.items():
        out[rule] = None
        for cutoff, k in zip(candidates, counts[rule], strict=True):
            if n == 0 or k >= risk * n or binomial_tail(k, n, risk) > level:
                break
            out[rule] = cutoff
    return out


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.0125, level: float = 0.05) -> dict:
    """stratum value -> rule -> cutoff or None.  One row for each stratum reaches the driver."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_qr_good")).where("_qr_good = 1")
    held = stats.where(~base_failed()).join(good, "doc_id", "left_semi")
    sums = [F.count_if(m > c).alias(f"{rule}_{i}") for rule, m in measures().items() for i, c in enumerate(CANDIDATES[rule])]
    rows = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("_qr_n"), *sums).collect()
    each = level / max(1, len(rows) * len(CANDIDATES))
    return {r[stratum]: certified({rule: [r[f"{rule}_{i}"] for i in range(len(c))] for rule, c in CANDIDATES.items()}, r["_qr_n"], risk, each) for r in rows}


def _stratum(column: str) -> Column:
    """A stratum as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def with_cutoffs(docs: DataFrame, cutoffs: dict, stratum: str) -> DataFrame:
    """`docs` plus _qr_cutoffs, the certified cutoffs of the row's stratum (null where there is none).

    One row a stratum with any; broadcast up to a tenth of BROADCAST_ROWS."""
    rows = [(f"={k}" if k is not None else "", *rules.values()) for k, rules in cutoffs.items() if any(c is not None for c in rules.values())]
    table = docs.sparkSession.createDataFrame(rows, "_qr_stratum string, " + ", ".join(f"{r} double" for r in CANDIDATES))
    table = table.select("_qr_stratum", F.struct(*CANDIDATES).alias("_qr_cutoffs"))
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS // 10 else table
    return docs.withColumn("_qr_stratum", _stratum(stratum)).join(table, "_qr_stratum", "left").drop("_qr_stratum")


def rejected(of: Callable[[str], Column] = F.col) -> Column:
    """True where a certified cutoff in _qr_cutoffs is exceeded."""
    out = F.lit(False)
    for rule, m in measures(of).items():
        out = out | F.coalesce(m > F.col(f"_qr_cutoffs.{rule}"), F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = 0.0125, level: float = 0.05) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of `docs`."""
    stats = materialize(text_statistics(docs, text, ("doc_id", stratum)), "statistics")
    cutoffs = calibrate(stats, labels, stratum, risk, level)
    judged = with_cutoffs(stats, cutoffs, stratum).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected()).drop(stratum, "_qr_cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = 0.0125, level: float = 0.05) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they were.

    The cutoffs of its stratum come to each row, so the verdict is computed beside it and no text is moved.
    """
    labelled = materialize(labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality"), "labelled")
    held = semi_checked(docs, labelled.select("doc_id").distinct(), "doc_id")
    stats = materialize(text_statistics(held, text, ("doc_id", stratum)), "statistics")
    cutoffs = calibrate(stats, labelled, stratum, risk, level)
    t = text_or_empty(text)
    # one expression, so that the filter measures a text once however often it names a statistic
    good = let(_measured(t, words_of(t)), lambda m: ~base_failed(m.getField) & ~rejected(m.getField))
    return with_cutoffs(docs, cutoffs, stratum).where(good).select(*docs.columns)
