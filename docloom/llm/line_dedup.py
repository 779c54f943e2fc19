"""Site-relative line frequency: drops lines that too many pages of one site repeat.  DataFrame functions only.

Lines are the `\\n`-separated parts of a text, compared without leading and trailing ASCII blanks.  A line is
boilerplate of its host when it stands on at least `min_pages` pages of the host and on more than `max_ratio` of
all its pages; a page counts once for a line however often it repeats it.

Defined cases: blank lines are always kept; a null text is a page without lines and stays null; a null host is a
host of its own; repeated rows are separate pages; extra columns pass through (names starting with `_dl_` are
reserved); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, let, materialize

BLANKS = " \t\r\x0b\f"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _host(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(_dl_host, _dl_key, pages, total): the boilerplate lines of each host, a line named by its MD5.

    The exploded lines are counted by (host, line), so that a hot host spreads over all tasks and a hot line
    meets in the map-side sums.
    """
    base = pages.select(_host(host).alias("_dl_host"), F.col(text).cast("string").alias("_dl_text"))
    totals = base.groupBy("_dl_host").agg(F.count(F.lit(1)).alias("total"))
    lines = F.array_distinct(F.filter(F.transform(F.split("_dl_text", "\n"), _trim), lambda x: x != ""))
    counts = (
        base.select("_dl_host", F.explode(lines).alias("_dl_line"))
        .groupBy("_dl_host", F.md5("_dl_line").alias("_dl_key"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return counts.join(totals, "_dl_host").where(F.col("pages") > F.lit(max_ratio) * F.col("total"))


def _cleaned(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int, broadcast_rows: int) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, plus _dl_n and _dl_d, the non-blank lines and those dropped.

    A host has at most (lines a page) / max_ratio boilerplate lines, so the set is small; it is written first and
    its rows are counted.  Up to `broadcast_rows` it is broadcast as one array for each host; beyond that the
    lines are matched by a shuffled join.
    """
    found = materialize(boilerplate_lines(pages, host, text, max_ratio, min_pages).select("_dl_host", "_dl_key"), "boilerplate")
    if found.count() <= broadcast_rows:
        keys = found.groupBy("_dl_host").agg(F.collect_set("_dl_key").alias("_dl_keys"))
        marked = pages.withColumn("_dl_host", _host(host)).join(F.broadcast(keys), "_dl_host", "left")
    else:
        rows = pages.withColumn("_dl_host", _host(host)).withColumn("_dl_row", F.monotonically_increasing_id())
        rows = materialize(rows, "rows")
        lines = rows.select("_dl_row", "_dl_host", F.explode(F.split(text, "\n")).alias("_dl_line"))
        hit = lines.select("_dl_row", "_dl_host", F.md5(_trim(F.col("_dl_line"))).alias("_dl_key"))
        hit = hit.join(found, ["_dl_host", "_dl_key"], "left_semi")
        keys = hit.groupBy("_dl_row").agg(F.collect_set("_dl_key").alias("_dl_keys"))
        marked = rows.join(keys, "_dl_row", "left").drop("_dl_row")
    full = lambda x: _trim(x) != ""
    lines = F.split(F.col(text), "\n")

    def split(hashes: Column) -> Column:
        """The text that stays and the lines that go; a page's lines meet its host's set once, by hash."""

        def of(bad: Column) -> Column:
            gone = lambda i: F.array_contains(bad, F.get(hashes, i))
            left = F.when(F.size(bad) == 0, F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~gone(i)), "\n"))
            return F.struct(left.alias("left"), F.size(F.filter(hashes, lambda h: F.array_contains(bad, h))).alias("gone"))

        return let(F.array_intersect(hashes, F.col("_dl_keys")), of)

    clean = F.when(F.col("_dl_keys").isNotNull() & F.col(text).isNotNull(), let(F.transform(lines, lambda x: F.md5(_trim(x))), split))
    count = F.coalesce(F.size(F.filter(lines, full)), F.lit(0)).cast("long")
    out = marked.withColumn("_dl_clean", clean)
    return out.select(
        *[F.coalesce("_dl_clean.left", text).alias(c) if c == text else F.col(c) for c in pages.columns],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(count).cast("long").alias("_dl_n"),
        F.coalesce("_dl_clean.gone", F.lit(0)).cast("long").alias("_dl_d"),
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 5,
    broadcast_rows: int = BROADCAST_ROWS // 10,
) -> DataFrame:
    """`pages` without boilerplate lines, plus n_lines and n_dropped, which replace columns of these names."""
    out = _cleaned(pages, host, text, max_ratio, min_pages, broadcast_rows)
    rest = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*rest, F.col("_dl_n").alias("n_lines"), F.col("_dl_d").alias("n_dropped"))


def clean(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """`pages` without boilerplate lines; columns as they were."""
    return _cleaned(pages, host, text, max_ratio, min_pages, BROADCAST_ROWS // 10).select(*pages.columns)
