"""Templates of training sentences: what may vary in them becomes a slot, and the templates become few alternations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Templates of one alternation, and characters of all of them up to which they may be literals of a plan.
BATCH, MOST_CHARS = 50, 1 << 20


@dataclass(frozen=True)
class Slot:
    """`pattern` has three groups: what stands before, what varies, and what follows; `shape` is what may stand there instead.

    Up to `words` words may vary."""

    pattern: str
    shape: str
    words: int = 3


@dataclass(frozen=True)
class TemplateRules:
    """An example belongs to a group if it matches one of `groups`; each slot that fits it gives a template."""

    groups: tuple[str, ...]
    slots: tuple[Slot, ...]


# ---- fixed values: groups and slots of the legal examples ----
LEGAL_TEMPLATES = TemplateRules(
    groups=(
        r"(?s)^(?=.*appeal).*(?:allowed|dismissed|refused)",
        r"(?s)^(?=.*appellant).*status",
        r"humanitarian|removal order|refugee|protection",
    ),
    slots=(
        Slot(r"(?s)^(.*?appeal of )(.*?)( is .*)$", r"[a-z0-9\s.\-]+"),
        Slot(r"(?s)^(.*?appeal for )(.*?)( is .*)$", r"[a-z0-9\s.\-]+"),
        Slot(r"(?s)^(.*?file )\s*([a-z0-9\-]+)((?:\s.*)?)$", r"[a-z0-9\-]+", 1),
    ),
)


def _mark(k: int) -> str:
    return chr(1 + k)


def generalised(text: Column, rules: TemplateRules = LEGAL_TEMPLATES) -> Column:
    """The distinct templates of a lower-cased example: itself, and one for each slot that fits; slots are control characters."""

    def filled(k: int, slot: Slot) -> Column:
        varies = F.regexp_extract(text, slot.pattern, 2)
        n = F.size(T.words(varies))
        return F.when((n > 0) & (n <= slot.words), F.regexp_replace(text, F.lit(slot.pattern), F.lit(f"$1{_mark(k)}$3")))

    made = F.array(text, *[filled(k, s) for k, s in enumerate(rules.slots)])
    return F.array_distinct(F.filter(made, lambda t: t.isNotNull()))


def mined(examples: DataFrame, text: str = "text", rules: TemplateRules = LEGAL_TEMPLATES) -> DataFrame:
    """(template, n): the templates of all examples of a group, and how many examples have each."""
    c = F.lower(F.col(text))
    grouped = examples.where(c.rlike("|".join(f"(?:{g})" for g in rules.groups))).select(c.alias("text"))
    return grouped.select(F.explode(generalised(F.col("text"), rules)).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


def alternation(templates: list[str], shapes: tuple[str, ...]) -> str:
    """One pattern of sorted distinct texts in the shape of their trie: what they begin with alike stands once."""

    def tree(rows: list[str], at: int) -> str:
        if len(rows) == 1:
            return literal(rows[0][at:])
        same = at
        while all(len(r) > same for r in rows) and rows[0][same] == rows[-1][same]:
            same += 1
        out, rest = [], [r for r in rows if len(r) > same]
        while rest:
            group = [r for r in rest if r[same] == rest[0][same]]
            out.append(tree(group, same))
            rest = rest[len(group) :]
        # a template that ends here is the last choice, as the longer ones begin with it
        ends = [""] if len(rows[0]) == same else []
        return literal(rows[0][at:same]) + "(?:" + "|".join(out + ends) + ")"

    def literal(s: str) -> str:
        return "".join(shapes[ord(ch) - 1] if 0 < ord(ch) <= len(shapes) else re.escape(ch) for ch in s)

    return tree(templates, 0)


def _batched(size: int, shapes: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        row = lambda part: pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([alternation(part, shapes)])], names=["n", "pattern"])
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                yield row(held[:size])
                held = held[size:]
        if held:
            yield row(held)

    return run


def compiled(templates: DataFrame, rules: TemplateRules = LEGAL_TEMPLATES, size: int = BATCH) -> DataFrame:
    """(n, pattern): alternations of `size` templates that are neighbours in order, so that they share their beginnings."""
    rows = templates.select("template").distinct().where("template <> ''").repartitionByRange("template").sortWithinPartitions("template")
    return rows.mapInArrow(_batched(size, tuple(s.shape for s in rules.slots)), "n bigint, pattern string")


def learned_patterns(examples: DataFrame, text: str = "text", rules: TemplateRules = LEGAL_TEMPLATES) -> tuple[str, ...]:
    """The alternations of all examples' templates, for a rule pack.  They become literals of a plan, so that they are measured first."""
    found = compiled(mined(examples, text, rules), rules)
    size = found.agg(F.coalesce(F.sum(F.char_length("pattern")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"patterns of {size} characters; at most {MOST_CHARS} fit a plan: keep the templates of more examples only")
    return tuple(sorted(r.pattern for r in found.collect()))
