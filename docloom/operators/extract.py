"""Sentence extractors: rule scorers and an n-gram index, over one long table.

Every scorer takes documents (key columns and a text) and gives (keys..., text, matched_text, score, position, length,
match_type, rank), best first.  Sentences are exploded once; a sentence that a document repeats is scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol, runtime_checkable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.operators.containment import containment
from docloom.sources.sinks import stored

FIELDS = ("text", "matched_text", "score", "position", "length", "match_type")
_EXTRACTION = "struct<text:string,matched_text:string,score:double,position:double,length:int,match_type:string>"


def explode_sentences(docs: DataFrame, keys: list[str], text: str, splitter: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """keys, pos (from 0), n, sentence.

    An inner explode would be given a filter on the size of its list, which cuts every text a second time below it."""
    parts = docs.select(*keys, splitter(F.col(text)).alias("_s")).select(*keys, F.size("_s").alias("n"), "_s")
    return parts.select(*keys, "n", F.posexplode_outer("_s").alias("pos", "sentence")).where("pos IS NOT NULL")


def relative(pos: Column, n: Column) -> Column:
    return pos / F.greatest(F.lit(1), n - 1)


# -- whole-sentence rules --


def sparse_hit(sentence: Column, rules: R.SparseRules = R.LEGAL_SPARSE) -> Column:
    """The cleaned sentence is a phrase, begins with a prefix and has the needed word, or matches a pattern."""

    def hit(c: Column) -> Column:
        prefix = F.lit(False)
        for p in rules.prefixes:
            prefix = prefix | F.startswith(c, F.lit(p))
        return c.isin(*rules.phrases) | (prefix & F.contains(c, F.lit(rules.prefix_needs))) | c.rlike(R.one_of(rules.patterns))

    return T.let(T.clean_sentence(sentence, rules.rewrites), hit)


def sparse(docs: DataFrame, keys: list[str], text: str, rules: R.SparseRules = R.LEGAL_SPARSE) -> DataFrame:
    """Explicit clauses in text order, repeats kept.  A text that is a list literal gives its items' clauses."""
    split = lambda c: F.coalesce(T.listed_clauses(c), T.clauses(c))
    rows = explode_sentences(docs, keys, text, split).where(sparse_hit(F.col("sentence"), rules))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.select(*keys, F.col("sentence").alias("text"), F.col("sentence").alias("matched_text"), F.lit(1.0).alias("score"), relative(F.col("pos"), F.col("n")).alias("position"), F.char_length("sentence").alias("length"), F.lit("explicit").alias("match_type"), rank.alias("rank"))


# -- classes of phrases and patterns --


#: Phrases that are looked for one by one; more are one pattern, as generated methods must stay small.
FEW_PHRASES = 16


def _any_phrase(lower: Column, phrases: tuple[str, ...]) -> Column:
    found = tuple(p.lower() for p in phrases)
    return lower.rlike(R.quoted(found)) if len(found) > FEW_PHRASES else reduce(or_, [F.contains(lower, F.lit(p)) for p in found])


def _scored(sentence: Column, lower: Column, padded: Column, n: Column, rules: R.BasicRules) -> Column:
    """The score of a sentence whose lower case, that between blanks and number of words are worked out beside it."""
    learned = sentence.rlike(R.one_of(rules.learned)) if rules.learned else F.lit(False)
    out = F.when(learned, 5.0).otherwise(0.0)
    for k in rules.keywords:
        out = out + F.when(T.between(padded, k), 1.0).otherwise(0.0)
    out = out + F.when(n.between(5, 30), 0.5).when(n > 30, -0.5).otherwise(0.0)
    outcome = F.lit(False)
    for k in rules.outcomes:
        outcome = outcome | T.between(padded, k)
    out = out + F.when(outcome, 1.0).otherwise(0.0)
    for c in reversed(rules.classes):
        hit = _any_phrase(lower, c.phrases) if c.phrases else sentence.rlike(R.one_of(c.patterns))
        out = F.when(hit, c.score).otherwise(out)
    return out


def basic_score(sentence: Column, rules: R.BasicRules = R.LEGAL_BASIC) -> Column:
    """The score of the first class that matches; else the sum of learned patterns, keywords, length and outcome words."""
    lower = F.lower(sentence)
    return _scored(sentence, lower, T.padded(lower), T.word_count(sentence), rules)


def basic_candidates(docs: DataFrame, keys: list[str], text: str, rules: R.BasicRules = R.LEGAL_BASIC, examples: DataFrame | None = None) -> DataFrame:
    """Each distinct sentence of a document that is an exact one (20 points) or scores above 0.

    Of repeats an exact sentence stands at its last place and any other at its first.  examples: one column `text`
    of further exact sentences, of any number.  Texts are dealt by their keys once: the grouping by sentence and the ranking
    within a document both hold on that."""
    rows = explode_sentences(docs.select(*keys, text).repartition(*keys), keys, text)
    distinct = rows.groupBy(*keys, "sentence").agg(F.first("n").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    exact = F.col("sentence").isin(*rules.exact)
    if examples is not None:
        known = examples.select(F.col("text").alias("sentence"), F.lit(True).alias("_known")).distinct()
        distinct = distinct.join(known, "sentence", "left")
        exact = exact | F.coalesce("_known", F.lit(False))
    parts = distinct.withColumns({"_exact": exact, "_lower": F.lower("sentence"), "_words": T.word_count(F.col("sentence"))})
    parts = parts.withColumn("_padded", T.padded(F.col("_lower")))
    scored = parts.withColumn("score", F.when(F.col("_exact"), 20.0).otherwise(_scored(F.col("sentence"), F.col("_lower"), F.col("_padded"), F.col("_words"), rules)))
    place = F.when(F.col("_exact"), F.col("last")).otherwise(F.col("first"))
    # below the window the filter would take a second copy of the score; those without points rank last
    ranked = scored.select(
        *keys,
        F.col("sentence").alias("text"),
        "score",
        relative(place, F.col("n")).alias("position"),
        F.char_length("sentence").alias("length"),
        F.when(F.col("_exact"), "exact").otherwise("pattern").alias("match_type"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("_exact"), "first")).alias("rank"),
    )
    # a second copy of the sentence isn't sorted
    return ranked.where("score > 0").select(*keys, "text", F.col("text").alias("matched_text"), "score", "position", "length", "match_type", "rank")


def select_adaptive(candidates: DataFrame, keys: list[str], strong: float = 10.0, share: float = 0.7, floor: float = 5.0, most: int = 5, weak: int = 3) -> DataFrame:
    """If a document's best reaches `strong`, what reaches max(floor, share * best), `most` at most; else the best `weak`."""
    # the best stands first, so what ranks too low is dropped below the second window, and while the first one runs
    top = candidates.where(F.col("rank") <= max(most, weak))
    best = F.max("score").over(Window.partitionBy(*keys))
    good = (F.col("_best") >= strong) & (F.col("score") >= F.greatest(F.lit(floor), F.col("_best") * share)) & (F.col("rank") <= most)
    return top.withColumn("_best", best).where(good | ((F.col("_best") < strong) & (F.col("rank") <= weak))).drop("_best")


def basic(docs: DataFrame, keys: list[str], text: str, rules: R.BasicRules = R.LEGAL_BASIC, examples: DataFrame | None = None) -> DataFrame:
    return select_adaptive(basic_candidates(docs, keys, text, rules, examples), keys)


def basic_examples(raw: DataFrame, column: str) -> DataFrame:
    """(text): distinct training sentences of a list column kept as text: long enough before and after cleaning."""
    found = raw.select(F.explode(T.parse_example_text(F.col(column))).alias("text")).where(F.char_length(T.strip(F.col("text"))) > 10)
    return found.select(T.clean_example(F.col("text")).alias("text")).where(F.char_length("text") > 5).distinct()


# -- n-gram index --


def gram_bank(examples: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    """(text): the distinct cleaned sentences of two words or more of `examples` (column text) and of the rules' phrases."""
    fixed = examples.sparkSession.createDataFrame([(p,) for p in rules.phrases], "text string")
    every = examples.select("text").unionByName(fixed).where(F.char_length(T.strip(F.col("text"))) > 3)
    return every.select(T.clean_for_grams(F.col("text")).alias("text")).where(F.size(T.words(F.col("text"))) >= 2).distinct()


def gram_index(bank: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    """(gram, text) without grams of more than `stop_gram` sentences."""
    index = bank.select(F.explode(F.array_distinct(T.ngrams(F.col("text"), rules.min_gram, rules.max_gram))).alias("gram"), "text")
    usual = index.groupBy("gram").count().where(F.col("count") <= rules.stop_gram).select("gram")
    return index.join(usual, "gram")


#: Bytes of a bank's texts with their grams up to which they may be broadcast.
SMALL_BANK = 1 << 26


def is_small(bank: DataFrame) -> bool:
    """Whether a bank's grams, by the measured lengths of its texts, are at most SMALL_BANK bytes."""
    n = F.octet_length("text").cast("long")
    return (bank.agg(F.sum(n * 32)).first()[0] or 0) <= SMALL_BANK


def _known_pairs(sent: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many runs of `size` words of each cleaned sentence are known, where any are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts = []
            for c in batch.column(0).to_pylist():
                w = c.split(" ")
                counts.append(sum(" ".join(w[i : i + size]) in known for i in range(len(w) - size + 1)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["cleaned", "_b"])
            yield out.filter(pc.greater(out.column(1), 0))

    return run


def rarest_grams(rows: DataFrame, index: DataFrame, bank: DataFrame, rules: R.NgramRules, small: bool = False) -> DataFrame:
    """(cleaned, grams, probes): the grams of each sentence that may reach the threshold, and the rarest of them that the index has.

    A gram that is shared holds pairs of words that are in the bank, and each pair begins at most one gram of each size: a sentence
    with too few such pairs isn't cut further.  Of n grams t must be shared, so one of any n - t + 1 is: those that fewest sentences
    of the bank have are taken, first of all those that none has.

    small: the bank was measured, and its pairs and grams may be sent to every task."""
    hint = F.broadcast if small else (lambda df: df)
    low, sizes = rules.min_gram, rules.max_gram - rules.min_gram + 1
    pairs = bank.select(F.explode(F.array_distinct(T.ngrams(F.col("text"), low, low))).alias("gram")).distinct()
    if small:
        sent = rows.sparkSession.sparkContext.broadcast({r.gram for r in pairs.collect()})
        some = rows.select("cleaned").mapInArrow(_known_pairs(sent, low), "cleaned string, _b bigint")
    else:
        some = rows.select("cleaned", F.explode(T.ngrams(F.col("cleaned"), low, low)).alias("gram")).join(pairs, "gram").groupBy("cleaned").agg(F.count(F.lit(1)).alias("_b"))
    cut = some.select("cleaned", "_b", T.ngrams(F.col("cleaned"), low, rules.max_gram).alias("_g")).where(F.col("_b") * sizes >= rules.threshold * F.size("_g"))
    spread = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_f"))
    weighed = cut.select("cleaned", F.explode("_g").alias("gram")).join(hint(spread), "gram", "left")
    ordered = weighed.groupBy("cleaned").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "gram"))).alias("_o"))
    n = F.size("_o")
    needed = F.ceil(n * rules.threshold - 1e-6).cast("int")
    first = F.filter(F.slice("_o", F.lit(1), F.least(n, n - needed + 1)), lambda x: x["f"] > 0)
    probes = F.array_distinct(F.transform(first, lambda x: x["gram"]))
    return ordered.select("cleaned", F.transform("_o", lambda x: x["gram"]).alias("grams"), probes.alias("probes")).where(F.size("probes") > 0)


def shared_grams(rows: DataFrame, bank: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    """(cleaned, text, match): the share of a sentence's grams that a sentence of the bank has, where it reaches the threshold.

    Only a sentence's rarest grams are looked up in the index; the share of those it meets is counted on whole lists."""
    small = is_small(bank)
    hint = F.broadcast if small else (lambda df: df)
    index = stored(gram_index(bank, rules))
    lists = stored(rarest_grams(rows, index, bank, rules, small))
    met = lists.select("cleaned", F.explode("probes").alias("gram")).join(hint(index), "gram").select("cleaned", "text").distinct()
    sets = index.groupBy("text").agg(F.collect_set("gram").alias("_set"))
    both = met.join(lists.select("cleaned", "grams"), "cleaned").join(hint(sets), "text")
    share = F.size(F.filter("grams", lambda g: F.array_contains("_set", g))) / F.size("grams")
    return both.select("cleaned", "text", share.alias("match")).where(F.col("match") >= rules.threshold)


def gram_match(cleaned: DataFrame, bank: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    """(cleaned, matched_text, match): the best bank sentence of each distinct cleaned sentence of three words or more.

    An equal one scores 1; else a substring match of at least the threshold; else the share of the sentence's grams
    that the bank sentence has, if it reaches the threshold.  Ties go to the first text in order.

    Each of the three ways reads the sentences, so they are written once."""
    rows = stored(cleaned.select("cleaned").distinct().where(F.size(T.words(F.col("cleaned"))) >= 3))
    bank = stored(bank.select("text").distinct())
    equal = rows.join(bank, rows.cleaned == bank.text).select("cleaned", "text", F.lit(1.0).alias("match"), F.lit(0).alias("way"))
    sub = containment(rows, bank).select("cleaned", "text", F.col("ratio").alias("match"), F.lit(1).alias("way"))
    shared = shared_grams(rows, bank, rules).select("cleaned", "text", "match", F.lit(2).alias("way"))
    every = equal.unionByName(sub).unionByName(shared).where(F.col("match") >= rules.threshold)
    rank = F.row_number().over(Window.partitionBy("cleaned").orderBy("way", F.desc("match"), "text"))
    return every.withColumn("_r", rank).where("_r = 1").select("cleaned", F.col("text").alias("matched_text"), "match")


def ngram_candidates(docs: DataFrame, keys: list[str], text: str, bank: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    """Sentences by the first rule that holds: direct pattern (20), phrase (18), equal to the bank (20), or, if a marker
    stands in them or an opening header shortly before, n-gram match (20 * match)."""
    rows = explode_sentences(docs, keys, text)
    upper = F.upper(F.col("sentence"))
    opens = lambda names: F.when(upper.rlike("^(?:" + R.quoted(names) + ")"), 1).otherwise(0)
    order = Window.partitionBy(*keys).orderBy("pos")
    within = lambda flag, n: F.max(flag).over(order.rowsBetween(-(n - 1), 0)) == 1
    lower = F.lower(F.col("sentence"))
    phrases = sorted(p.lower() for p in rules.phrases)
    phrase = F.coalesce(*[F.when(F.contains(lower, F.lit(p)), F.lit(p)) for p in phrases])
    rows = rows.withColumns({"_long": opens(rules.long_openers), "_short": opens(rules.short_openers)})
    rows = rows.withColumns({
        "_in": within("_long", rules.long_window) | within("_short", rules.short_window),
        "_direct": lower.rlike(R.one_of(rules.direct, ignore_case=False)),
        "_phrase": phrase,
        "_marker": lower.rlike(R.quoted(tuple(m.lower() for m in rules.markers))),
        "cleaned": T.clean_for_grams(F.col("sentence")),
    })
    known = bank.select(F.col("text").alias("cleaned"), F.lit(True).alias("_known"))
    # read for the matches and for their places: written, so that texts are cut and cleaned once
    rows = stored(rows.join(known, "cleaned", "left"))
    open_ = ~F.col("_direct") & F.col("_phrase").isNull() & F.col("_known").isNull() & (F.col("_in") | F.col("_marker"))
    found = gram_match(rows.where(open_).select("cleaned"), bank, rules)
    rows = rows.join(found, "cleaned", "left")
    kind = F.when(F.col("_direct"), "direct_pattern").when(F.col("_phrase").isNotNull(), "phrase_match").when(F.col("_known"), "exact").when(open_ & F.col("match").isNotNull(), "ngram")
    score = F.when(F.col("_direct"), 20.0).when(F.col("_phrase").isNotNull(), 18.0).when(F.col("_known"), 20.0).otherwise(F.col("match") * 20.0)
    matched = F.when(F.col("_direct"), F.col("sentence")).when(F.col("_phrase").isNotNull(), F.col("_phrase")).when(F.col("_known"), F.col("cleaned")).otherwise(F.col("matched_text"))
    out = rows.withColumns({"match_type": kind, "score": score}).where("match_type IS NOT NULL")
    return out.select(*keys, F.col("sentence").alias("text"), matched.alias("matched_text"), "score", relative(F.col("pos"), F.col("n")).alias("position"), F.char_length("sentence").alias("length"), "match_type", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")).alias("rank"))


def select_grams(candidates: DataFrame, keys: list[str], least: float = 15.0, many: int = 3, strict: float = 17.0, most: int = 6) -> DataFrame:
    """Without repeats (case aside): direct kinds, and n-gram matches of at least `least`; with `many` direct ones,
    those first and then n-gram matches of at least `strict`; `most` in all."""
    direct = F.col("match_type") != "ngram"
    once = F.row_number().over(Window.partitionBy(*keys, F.lower("text")).orderBy("rank"))
    kept = candidates.where(direct | (F.col("score") >= least)).withColumn("_once", once).where("_once = 1").drop("_once")
    counted = kept.withColumn("_many", F.count_if(direct).over(Window.partitionBy(*keys)) >= many)
    chosen = counted.where(~F.col("_many") | direct | (F.col("score") >= strict))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("_many") & ~direct, 1).otherwise(0), "rank"))
    return chosen.withColumn("rank", order).where(F.col("rank") <= most).drop("_many")


def ngram(docs: DataFrame, keys: list[str], text: str, bank: DataFrame, rules: R.NgramRules = R.LEGAL_NGRAM) -> DataFrame:
    return select_grams(ngram_candidates(docs, keys, text, bank, rules), keys)


# -- neural scorers --


def hits(out: DataFrame, keys: list[str]) -> DataFrame:
    """Scored sentences in text order as hits."""
    return out.select(*keys, F.col("sentence").alias("text"), F.col("sentence").alias("matched_text"), "score", relative(F.col("pos"), F.col("n")).alias("position"), F.char_length("sentence").alias("length"), F.lit("neural").alias("match_type"), F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).alias("rank"))


def neural(docs: DataFrame, keys: list[str], text: str, scorer: Callable, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Sentences whose probability reaches the threshold (or, strict, is above it).

    scorer: a function from an iterator of pandas string series to series of probabilities, so that a model is loaded once
    a task; each distinct sentence is scored once."""
    rows = stored(explode_sentences(docs, keys, text, T.model_sentences))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scorer(batches)

    scored = rows.select("sentence").distinct().withColumn("score", run("sentence"))
    hit = F.col("score") > threshold if strict else F.col("score") >= threshold
    return hits(rows.join(scored.where(hit), "sentence"), keys)


# -- one form for all extractors --


@runtime_checkable
class Extractor(Protocol):
    """What evaluations and stages run: documents to a long table of hits."""

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame: ...


@dataclass(frozen=True)
class Sparse:
    rules: R.SparseRules = R.LEGAL_SPARSE

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        return sparse(docs, keys, text, self.rules)


@dataclass(frozen=True)
class Basic:
    rules: R.BasicRules = R.LEGAL_BASIC
    examples: DataFrame | None = None

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        return basic(docs, keys, text, self.rules, self.examples)


@dataclass(frozen=True)
class Ngram:
    bank: DataFrame
    rules: R.NgramRules = R.LEGAL_NGRAM

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        return ngram(docs, keys, text, self.bank, self.rules)


@dataclass(frozen=True)
class Neural:
    scorer: Callable
    threshold: float = 0.5
    strict: bool = False

    def extract(self, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        return neural(docs, keys, text, self.scorer, self.threshold, self.strict)


def apply_all(docs: DataFrame, extractors: dict[str, Extractor], keys: list[str], text: str) -> DataFrame:
    """(model, keys..., hit columns): what every extractor finds, one below the other."""
    found = [e.extract(docs, keys, text).select(F.lit(name).alias("model"), *keys, *FIELDS, "rank") for name, e in extractors.items()]
    return reduce(DataFrame.unionByName, found)


# -- sections --


def unpivot_sections(docs: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """(key, section, text): a row for each section column that has text."""
    long = docs.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in sections])).alias("_s"))
    return long.select(key, "_s.section", "_s.text").where(F.col("text").isNotNull() & T.has_text(F.col("text")))


def scored_text(docs: DataFrame, sections: list[str], cleaned: str = "cleaned_text") -> Column:
    """The section texts joined by empty lines, or the cleaned text where there are none."""
    found = F.filter(F.array(*[F.col(s) for s in sections]), lambda s: s.isNotNull() & (T.strip(s) != ""))
    return F.coalesce(F.nullif(F.array_join(found, "\n\n"), F.lit("")), F.col(cleaned))


def pivot_extractions(docs: DataFrame, long: DataFrame, key: str, sections: list[str], model: str, least: float | None = None) -> DataFrame:
    """`docs` plus, for each section, `{section}_{model}_extraction` (records, best first) and its count; empty where none."""
    kept = long if least is None else long.where(F.col("score") >= least)
    record = F.struct("rank", *[F.col(f) for f in FIELDS])
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, record))), lambda r: F.struct(*[r[f].alias(f) for f in FIELDS])).alias(f"{s}_{model}_extraction") for s in sections]
    wide = kept.groupBy(key).agg(*lists)
    out = docs.join(wide, key, "left")
    empty = F.array().cast(f"array<{_EXTRACTION}>")
    names = [f"{s}_{model}_extraction" for s in sections]
    out = out.withColumns({n: F.coalesce(F.col(n), empty) for n in names})
    return out.withColumns({f"{n}_count": F.size(n) for n in names})
