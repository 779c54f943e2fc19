"""Document sectioning: header lines, sections between them, outcomes, marker paragraphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T

HEADERS = "array<struct<line_number:int,text:string,normalized_text:string,category:string,term:string>>"
SECTIONS = "array<struct<category:string,header:string,content:string>>"


# -- header lines --


def _first(hits: list[Column]) -> Column:
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<category:string,term:string>")


def bare_line(line: Column, rules: R.HeaderRules = R.LEGAL_HEADERS) -> Column:
    """A line without quotes and number, or just the term that stands behind its last sentence."""

    def made(x: Column) -> Column:
        numbered = T.strip(F.nullif(F.regexp_extract(x, r"(?U)\A\s*\d+\s+([A-Z][A-Za-z\s]+)\s*\z", 1), F.lit("")))
        upper = F.upper(x)
        ends = [F.when(F.contains(upper, F.lit(t)), F.nullif(F.regexp_extract(x, rf"(?diuU)\A.*?[.!?]\s+({R.quoted((t.upper(),))})(?:\s*\z|\s*\[\d+\])", 1), F.lit(""))) for _, terms in rules.categories for t in terms]
        return F.coalesce(numbered, F.when(upper.rlike(R.quoted(rules.gate)), F.coalesce(*ends)), T.strip(x))

    return T.let(F.regexp_replace(F.translate(line, "\"'", ""), "\n+", " "), made)


def classify(line: Column, rules: R.HeaderRules = R.LEGAL_HEADERS) -> Column:
    """struct(category, term) of a line, the first in the pack's order; null if it is no header.

    A strict pack takes whole-line headers only."""
    terms = [(F.struct(F.lit(c).alias("category"), F.lit(t).alias("term")), t) for c, of in rules.categories for t in of]
    quoted = lambda t: R.quoted((t.upper(),))
    spaced = lambda t: r"\s+".join(r"\s*".join(map(re.escape, w)) for w in t.split())

    def said(upper: Column) -> Column:
        if rules.strict:
            return _first([F.when(upper.rlike(rf"(?U)\A\s*(?:\d+\s+)?(?:THE\s+)?{quoted(t)}\s*[.:]?\s*(?:\[\d+\])?\s*\z"), hit) for hit, t in terms])
        anywhere = [F.when(F.contains(upper, F.lit(t.upper())) & upper.rlike(rf"(?U){quoted(t)}\z|{quoted(t)}\s*\[\d+\]|[.!?]\s+(?:THE\s+)?{quoted(t)}"), hit) for hit, t in terms]
        whole = lambda normal: _first([F.when(upper.rlike(R.quoted(tuple(t.upper().split()))) & normal.rlike(rf"(?diuU)\A\s*{spaced(t)}(?:\s*\z|\s+.*\z|\s*\[\d+\])"), hit) for hit, t in terms])
        return F.coalesce(_first(anywhere), T.let(T.normalize_header(bare_line(line, rules)), whole))

    upper = F.upper(line)
    return F.when(upper.rlike(R.quoted(rules.gate)), T.let(upper, said))


def _reading(lines: Column, x: Column, i: Column, rules: R.HeaderRules) -> Column:
    """struct(line_number, next, text, category, term): the preferred reading of line i as a header; null if there is none.

    A line with a word of `rules.ahead` may go on over one or two lines that are short or begin with `[`, unless the text's last
    two (or three) lines would be taken."""
    one = F.struct(F.lit(1).alias("n"), x.alias("text"))
    if rules.ahead:
        brief = lambda y: F.startswith(y, F.lit("[")) | (F.char_length(y) < 20)
        y, z, last = F.get(lines, i + 1), F.get(lines, i + 2), F.size(lines) - 1
        goes = F.upper(x).rlike(R.quoted(rules.ahead)) & (i + 1 < last) & brief(y)
        joined = lambda *parts: F.array_join(F.array(*parts), "\n")
        two = F.when(goes, F.struct(F.lit(2).alias("n"), joined(x, y).alias("text")))
        three = F.when(goes & (i + 2 < last) & brief(z), F.struct(F.lit(3).alias("n"), joined(x, y, z).alias("text")))
        readings = F.filter(F.array(two, three, one), lambda r: r.isNotNull())
    else:
        readings = F.array(one)
    record = lambda r, c: F.struct(i.alias("line_number"), (i + r["n"]).alias("next"), r["text"].alias("text"), c["category"].alias("category"), c["term"].alias("term"))
    made = F.transform(readings, lambda r: T.let(classify(r["text"], rules), lambda c: F.when(c.isNotNull(), record(r, c))))
    return F.get(F.filter(made, lambda h: h.isNotNull()), F.lit(0))


def _apart(found: Column) -> Column:
    """The readings without those that begin inside one before them: a fold over the readings, whose state is the first line
    that is free and the lines that weren't."""
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, h: F.when(h["line_number"] >= s["free"], F.struct(h["next"].alias("free"), s["taken"].alias("taken"))).otherwise(F.struct(s["free"].alias("free"), F.concat(s["taken"], F.array(h["line_number"])).alias("taken")))
    return T.let(F.aggregate(found, start, step)["taken"], lambda taken: F.filter(found, lambda h: ~F.array_contains(taken, h["line_number"])))


def headers(text: Column, rules: R.HeaderRules = R.LEGAL_HEADERS) -> Column:
    """The header lines of a text: of each line that isn't part of a header before it, the first reading that is a header.  Null text
    has none."""

    def scan(lines: Column) -> Column:
        passes = lambda x: (x != "") & F.upper(x).rlike(R.quoted(rules.gate))
        found = F.filter(F.transform(lines, lambda x, i: F.when(passes(x), _reading(lines, x, i, rules))), lambda h: h.isNotNull())
        kept = T.let(found, _apart) if rules.ahead else found
        return F.transform(kept, lambda h: F.struct(h["line_number"].alias("line_number"), h["text"].alias("text"), T.normalize_header(h["text"]).alias("normalized_text"), h["category"].alias("category"), h["term"].alias("term")))

    return F.coalesce(T.let(F.transform(F.split(text, "\n"), T.strip), scan), F.array().cast(HEADERS))


def sections(text: Column, found: Column) -> Column:
    """What stands between each header and the next, trimmed, in order.  `found`: a column that `headers` has made before.

    Headers with nothing behind them give no section; of equal header texts the first keeps its place with the content
    of the last."""

    def content(lines: Column, h: Column, i: Column) -> Column:
        end = F.coalesce(F.get(found, i + 1)["line_number"], F.size(lines))
        start = h["line_number"] + 1
        body = F.when(start < end, T.strip(F.array_join(F.slice(lines, start + 1, end - start), "\n")))
        return F.struct(h["category"].alias("category"), h["text"].alias("header"), body.alias("content"))

    def once(all_: Column) -> Column:
        same = lambda a, b: (a["category"] == b["category"]) & (a["header"] == b["header"])
        first = F.filter(all_, lambda s, i: (i == 0) | ~F.exists(F.slice(all_, 1, F.greatest(i, F.lit(1))), lambda o: same(o, s)))
        last = lambda s: F.element_at(F.filter(all_, lambda o: same(o, s)), -1)["content"]
        return F.transform(first, lambda s: F.struct(s["category"].alias("category"), s["header"].alias("header"), last(s).alias("content")))

    full = T.let(F.split(text, "\n"), lambda lines: F.filter(F.transform(found, lambda h, i: content(lines, h, i)), lambda s: s["content"].isNotNull()))
    return F.coalesce(T.let(full, once), F.array().cast(SECTIONS))


def of_category(found: Column, category: str) -> Column:
    return F.filter(found, lambda s: s["category"] == category)


# -- outcomes --

OUTCOMES = ("allowed", "dismissed", "set_aside", "granted", "refused")


def outcome(text: Column, rules: R.OutcomeRules = R.LEGAL_OUTCOMES) -> Column:
    """struct(outcome, confidence, outcome_text): the first pattern that is found (0.9), else the first keyword that stands
    as a word (0.6, with its first sentence), else null and 0."""
    none = F.struct(F.lit(None).cast("string").alias("outcome"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("outcome_text"))
    out = none
    made = lambda name, sure, said: F.struct(F.lit(name).alias("outcome"), F.lit(sure).alias("confidence"), said.alias("outcome_text"))
    keywords = [(n, w) for n, ws in rules.keywords for w in ws]
    for name, word in reversed(keywords):
        p = R.one_of((rf"\b{re.escape(word)}\b",))
        said = T.strip(F.get(F.filter(F.split(text, T.U + r"(?<=[.!?])\s+"), lambda s: s.rlike(p)), F.lit(0)))
        out = F.when(text.rlike(p), made(name, 0.6, said)).otherwise(out)
    for name, pattern in reversed([(n, p) for n, ps in rules.patterns for p in ps]):
        p = R.one_of((pattern,))
        out = F.when(text.rlike(p), made(name, 0.9, F.regexp_substr(text, F.lit(p)))).otherwise(out)
    return out


DECIDING = ("decision_headers", "determination_headers", "conclusion_headers")


def document_outcome(found: Column, order: tuple[str, ...] = DECIDING, rules: R.OutcomeRules = R.LEGAL_OUTCOMES) -> Column:
    """The outcome of a document: in each category the first section with confidence above 0.5; the first category's, unless
    it is below 0.7 and a later one's is higher."""
    best = lambda c: F.get(F.filter(F.transform(of_category(found, c), lambda s: outcome(s["content"], rules)), lambda o: o["confidence"] > 0.5), F.lit(0))
    kept = best(order[0])
    for c in order[1:]:
        kept = F.element_at(
            F.transform(
                F.array(F.struct(kept.alias("a"), best(c).alias("b"))),
                lambda p: F.when(p["a"].isNull(), p["b"]).when((p["a"]["confidence"] < 0.7) & (p["b"]["confidence"] > p["a"]["confidence"]), p["b"]).otherwise(p["a"]),
            ),
            1,
        )
    return kept


# -- whole preprocessing --


def cleaned(text: Column) -> Column:
    """struct(text, metadata) after page pointers, foreign lines, redactions and white space are put right."""
    parts = T.extract_metadata(text)
    fixed = T.normalize_whitespace(T.clean_redactions(T.remove_foreign_lines(T.remove_page_pointers(parts["text"]))))
    return F.struct(fixed.alias("text"), parts["metadata"].alias("metadata"))


def preprocess(docs: DataFrame, text: str = "full_text", rules: R.HeaderRules = R.LEGAL_HEADERS, outcomes: R.OutcomeRules = R.LEGAL_OUTCOMES, deciding: tuple[str, ...] = DECIDING) -> DataFrame:
    """`docs` plus cleaned_text, case_metadata, sections, has_{category} (true or null), {category}_text, decision_outcome
    and decision_text.  Rows without text get nulls, and '' as cleaned text."""
    base = docs.withColumn("_c", cleaned(F.when(T.strip(F.col(text)) != "", F.col(text))))
    base = base.withColumns({"cleaned_text": F.coalesce("_c.text", F.lit("")), "case_metadata": F.col("_c.metadata")}).drop("_c")
    base = base.withColumn("headers", headers(F.col("cleaned_text"), rules))
    base = base.withColumn("sections", sections(F.col("cleaned_text"), F.col("headers")))
    base = base.withColumn("_o", document_outcome(F.col("sections"), deciding, outcomes))
    names = [c for c, _ in rules.categories]
    joined = lambda c: F.array_join(F.transform(of_category(F.col("sections"), c), lambda s: s["content"]), "\n\n")
    some = lambda c: F.size(of_category(F.col("sections"), c)) > 0
    columns = {f"has_{c}": F.when(some(c), F.lit(True)) for c in names} | {f"{c}_text": F.when(some(c), joined(c)) for c in names}
    return base.withColumns(columns | {"decision_outcome": F.col("_o.outcome"), "decision_text": F.col("_o.outcome_text")}).drop("_o")


def marker_paragraphs(text: Column, marker: str = R.CASE_MARKER, within: int = 50, after: int = 7, least: int = 250) -> Column:
    """struct(general_metadata, suspected_first_case_paragraph, suspected_last_case_paragraph).

    The metadata is what stands before the first marker (in the first `within` sentences); the first paragraph begins
    at it and goes on for `after` sentences; the last is the text between the last two markers, or from the third last if that
    is shorter than `least`.  Each is null where the markers are missing."""
    s = F.split(text, T.U + r"(?<=[.!?])\s+")

    def made(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda x, i: F.when(F.contains(x, F.lit(marker)), i)), lambda i: i.isNotNull())
        first = F.when(F.get(at, F.lit(0)) < within, F.get(at, F.lit(0)))
        line = F.get(s, first)
        cut = F.instr(line, marker)
        before = T.strip(F.substring(line, F.lit(1), cut - 1))
        lead = F.slice(s, F.lit(1), F.greatest(first, F.lit(0)))
        meta = T.strip(F.array_join(F.concat(lead, F.when(before != "", F.array(before)).otherwise(F.array().cast("array<string>"))), " "))
        start = T.strip(F.concat(T.strip(F.substring(line, cut, F.char_length(line))), F.lit(" "), T.strip(F.array_join(F.slice(s, first + 2, F.lit(after)), " "))))
        last, second, third = (F.get(at, F.size(at) - k) for k in (1, 2, 3))
        between = lambda a: T.strip(F.array_join(F.slice(s, a + 2, last - a), " "))
        long_enough = lambda c: F.when(F.char_length(c) >= least, c)
        end = F.when(F.size(at) >= 2, F.coalesce(long_enough(between(second)), F.when(F.size(at) >= 3, long_enough(between(third)))))
        return F.struct(F.when(first.isNotNull(), meta).alias("general_metadata"), F.when(first.isNotNull(), start).alias("suspected_first_case_paragraph"), end.alias("suspected_last_case_paragraph"))

    return T.let(s, made)


def without_lead(cleaned_text: Column, metadata: Column, marker: str = R.CASE_MARKER) -> Column:
    """A cleaned text from its marker on: without the metadata where that leads to the marker, else cut at the marker."""
    rest = T.strip(F.concat(F.substring(cleaned_text, F.lit(1), F.instr(cleaned_text, metadata) - 1), F.substring(cleaned_text, F.instr(cleaned_text, metadata) + F.char_length(metadata), F.char_length(cleaned_text))))
    at = F.instr(cleaned_text, marker)
    cut = F.when(at > 1, T.strip(F.substring(cleaned_text, at, F.char_length(cleaned_text)))).otherwise(cleaned_text)
    return F.when((metadata != "") & F.contains(cleaned_text, metadata) & F.startswith(rest, F.lit(marker)), rest).otherwise(cut)


# -- header statistics --


def header_lines(docs: DataFrame, key: str, text: str, min_words: int = 1, max_words: int = 6) -> DataFrame:
    """(key, place, header): the lines in capitals that may be headers."""
    return docs.select(key, F.posexplode(T.header_candidates(F.col(text), min_words, max_words)).alias("place", "header"))


def header_counts(lines: DataFrame, least: int = 1) -> DataFrame:
    return lines.groupBy("header").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def true_headers(counts: DataFrame, excluded: tuple[str, ...] = R.HEADER_EXCLUDED_WORDS, longest: int = 30) -> DataFrame:
    """Without excluded words, mostly letters, not long."""
    letters = F.char_length(F.regexp_replace("header", r"\P{L}", ""))
    return counts.where(~F.col("header").rlike(R.quoted(excluded)) & (letters * 2 >= F.char_length("header")) & (F.char_length("header") <= longest))


def compare_headers(a: DataFrame, b: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(header, side): frequent headers of two corpora that are in both or in one of them."""
    from docloom.operators.dedup import vocabulary

    frequent = lambda df: header_counts(header_lines(df, key, text), least)
    return vocabulary(frequent(a), frequent(b), "header")
