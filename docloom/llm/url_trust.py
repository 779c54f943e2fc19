"""URL verdicts: path rules first, link-graph propagation for the rest.  DataFrame functions only.

A rule `host/path` fits a URL of that host or of a subdomain whose path begins with the rule's path; the longest
fitting rule decides.  Other URLs take the verdict of their host.  Host links are read from the pages' HTML.
Personalised PageRank spreads trust from the hosts that rules allow along the links; distrust spreads from the hosts that
rules block along the reversed links (who links to bad hosts is suspect).  Both start from the host's share of
all ruled pages, so their masses compare; a host is blocked when its distrust is above its trust.

Defined cases: a null URL or one without `://` has empty host and path, no rule, and the verdict of the empty host, which
takes no part in links: allow; null HTML has no links; links to the own host don't count; rules of equal length
prefer the longer host, then block; repeated rows are separate pages; an empty table gives an empty table; extra columns
pass through unless named like the results (names starting with `_ut_` are reserved).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

DAMPING = 0.85
#: Rounds after which propagation fails; a change shrinks by the damping a round, so some 130 settle it.
ROUNDS = 1000
#: Change in total mass below which propagation has settled.
SETTLED = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the columns host and path; null if none does."""
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, between different hosts.  `pages` has the column host."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, node, score) of both walks.  seeds: (kind, node, mass); kind 'trust' follows links, 'distrust' reverses
    them.  Mass on nodes without a way on returns to the seeds.  Each round is written to the shared folder.  It ends when the
    scores have settled, and fails if they haven't within `rounds`."""
    steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to"), "weight")
    )
    out = steps.groupBy("kind", "node").agg(F.sum("weight").alias("total"))
    steps = materialize(steps.join(out, ["kind", "node"]).select("kind", "node", "to", (F.col("weight") / F.col("total")).alias("share")), "steps")
    seeds = materialize(seeds.select("kind", "node", F.col("mass").cast("double").alias("mass")), "seeds")
    score = seeds.select("kind", "node", F.col("mass").alias("score"))
    if steps.isEmpty():
        return score
    row = lambda moved=0.0, mass=0.0, old=0.0, on=0: [x if isinstance(x, Column) else F.lit(x).alias(n) for n, x in (("moved", moved), ("mass", mass), ("old", old), ("on", on))]
    ways = steps.select("kind", "node").distinct().select("kind", "node", *row(on=1))
    fixed = materialize(ways.unionByName(seeds.select("kind", "node", *row(mass=F.col("mass")))), "fixed")
    all_mass = dict(seeds.groupBy("kind").agg(F.sum("mass")).collect())
    # what stands on nodes with a way on moves, the rest returns
    kept = dict(score.join(steps.select("kind", "node").distinct(), ["kind", "node"], "left_semi").groupBy("kind").agg(F.sum("score")).collect())
    for _ in range(rounds):
        back = F.lit(0.0)
        for kind, mass in sorted(all_mass.items()):
            rate = (1 - damping) + damping * (1 - kept.get(kind, 0.0) / mass if mass else 0.0)
            back = F.when(F.col("kind") == kind, F.lit(rate)).otherwise(back)
        moved = score.join(steps, ["kind", "node"]).select("kind", F.col("to").alias("node"), *row(moved=(F.col("score") * F.col("share")).alias("moved")))
        every = moved.unionByName(fixed).unionByName(score.select("kind", "node", *row(old=F.col("score").alias("old"))))
        every = every.groupBy("kind", "node").agg(F.sum("moved").alias("moved"), F.sum("mass").alias("mass"), F.sum("old").alias("old"), F.max("on").alias("on"))
        new = materialize(every.select("kind", "node", (damping * F.col("moved") + back * F.col("mass")).alias("score"), "old", "on"), "score")
        found = new.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.sum(F.when(F.col("on") == 1, F.col("score"))).alias("kept")).collect()
        kept = {r.kind: r.kept or 0.0 for r in found}
        score = new.select("kind", "node", "score")
        if sum(r.change for r in found) < SETTLED:
            return score.where("score > 0")
    raise RuntimeError(f"scores did not settle within {rounds} rounds")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """`pages` without `html`, plus host, path, rule and verdict."""
    rest = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict")]
    u = F.col(url).cast("string")
    named = pages.select(*rest, host_of(u).alias("host"), path_of(u).alias("path"), *([html] if html in pages.columns else []))
    ruled = named.withColumn("_ut_rule", best_rule(rules))
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("_ut_rule.verdict") == "allow").alias("allow"), F.count_if(F.col("_ut_rule.verdict") == "block").alias("block"))
    counts = materialize(counts, "ruled-hosts")
    total = counts.agg(F.sum(F.col("allow") + F.col("block"))).first()[0] or 1
    mass = lambda c, kind: counts.where(f"{c} > 0").select(F.lit(kind).alias("kind"), F.col("host").alias("node"), (F.col(c) / F.lit(total)).alias("mass"))
    scores = propagate(host_links(named, html), mass("allow", "trust").unionByName(mass("block", "distrust")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    bad = scores.groupBy(F.col("node").alias("host")).agg(of("trust").alias("trust"), of("distrust").alias("distrust")).where("distrust > trust").select("host", F.lit(True).alias("_ut_bad"))
    judged = ruled.drop(html).join(bad, "host", "left")
    verdict = F.coalesce(F.col("_ut_rule.verdict"), F.when(F.col("_ut_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*rest, "host", "path", F.col("_ut_rule.rule").alias("rule"), verdict.alias("verdict"))
