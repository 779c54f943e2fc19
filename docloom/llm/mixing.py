"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The size of a document is its number of words.  Sources in code-point order, null last, weigh 5, 2, 1, repeating.
Their targets share 100 % of all sizes by weight; a target stops at 3 times its source's size and the excess is
reshared by weight until none is above.

Every source is cut by a hash of doc_id into a power of two of blocks of about equal words, put in a permuted order.
A source's quota is a number of block draws: whole rounds over its blocks, then the first blocks of one more
round; in the last block the documents are taken in hash order and one is cut, so that the words taken are the
target, rounded.  The quotas of all sources are split exactly among the output shards by a binary tree: each node
gives its left half a multivariate-hypergeometric draw of the blocks left to it.  A leaf of the tree is a shard: it draws
the next blocks of each source, as many as the tree gives it, disjoint from those of all other shards.  A document is
taken for each draw of its block, and a shard orders its documents by a hash.  Everything follows from the seed.

The driver holds one row a source and the top of the tree, down to nodes of NODE_SHARDS shards; the tasks split those to the
leaves.  Cells, blocks, draws and documents stay in Spark.

Defined cases: null text has size 0; a document of size 0 is never taken; a null source is a source; repeated rows
are separate documents; extra columns pass through (names starting with `_mx_` are reserved); an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, materialize

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Places that documents hash to; blocks are made of them, so a source of more than PLACES * BLOCK_WORDS words (some 200 GB
#: of text) has larger blocks, not more.
PLACES = 1 << 20
#: Words a block should hold at least, and blocks a shard holds.
BLOCK_WORDS = 32_768
SHARD_BLOCKS = 64
#: Shards below a node that a task splits on, and output partitions at most; beyond that a partition holds neighbouring shards.
NODE_SHARDS, MAX_PARTITIONS = 256, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> dict[str | None, float]:
    """The words to take from each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, active = float(sum(sizes.values())), order
    while active:
        total = sum(weight[s] for s in active)
        share = {s: left * weight[s] / total for s in active}
        above = [s for s in active if share[s] > most * sizes[s]]
        if not above:
            out |= share
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


def split_quotas(quotas: np.ndarray, low: int, high: int, seed: int, stop: int = 1, start: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first shard, shard after the last, first draws, draws) of the tree's nodes of at most `stop` shards, for the shards low ..
    high - 1 that share `quotas`; one number a source.

    Draws of a source are numbered from `start` on, in the order of the shards.  Siblings' sums differ by their shares, so
    single shards' sums differ by one at most."""
    todo = [(low, high, np.zeros(len(quotas), np.int64) if start is None else start, quotas.astype(np.int64))]
    while todo:
        low, high, start, have = todo.pop()
        if high - low <= stop:
            yield low, high, start, have
            continue
        mid = (low + high) // 2
        n = int(have.sum())
        left = n * (mid - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals") if n else have
        todo += [(mid, high, start + drawn, have - drawn), (low, mid, start, drawn)]


def _leaves(sources: list[str], seed: int):
    """Nodes (low, high, start, have) to the draws of each shard: (source, first, after the last, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node in batch.to_pylist():
                source, first, end, shards = [], [], [], []
                for shard, _, at, drawn in split_quotas(np.array(node["have"], np.int64), node["low"], node["high"], seed, 1, np.array(node["start"], np.int64)):
                    for i in np.flatnonzero(drawn):
                        source.append(sources[i])
                        first.append(int(at[i]))
                        end.append(int(at[i] + drawn[i]))
                        shards.append(shard)
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), *[pa.array(x, pa.int64()) for x in (first, end, shards)]], names=["source", "first", "end", "shard"])

    return run


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _place(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(PLACES)).cast("int")


def block_number() -> Column:
    """The place of a document's block in the permuted order of its source's blocks (a power of two of them)."""
    odd = F.lit(2_654_435_761)
    return F.pmod((F.col("_mx_place") % F.col("_mx_blocks")).cast("long") * odd + F.xxhash64("_mx_source") % 65_536, F.col("_mx_blocks").cast("long")).cast("int")


def plan(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 42) -> tuple[DataFrame, DataFrame, int]:
    """(sources, draws, shards).

    sources: _mx_source, _mx_size, _mx_target, _mx_blocks, and the block _mx_last that is drawn in part, of which _mx_words words;
    marked for broadcast.  draws: _mx_source, _mx_block and _mx_deal, an array of (round, block, shard, whole), for every block
    that is drawn; marked for broadcast up to a tenth of BROADCAST_ROWS rows, of at most four draws each."""
    spark = docs.sparkSession
    cells = docs.select(_key(source).alias("_mx_source"), _place(seed).alias("_mx_place"), size_of(text).alias("words"))
    cells = materialize(cells.groupBy("_mx_source", "_mx_place").agg(F.sum("words").alias("words")), "cells")
    sizes = {r[0]: r[1] for r in cells.groupBy("_mx_source").agg(F.sum("words")).collect()}
    # "=name" sorts as name does; "" stands for null
    named = {k[1:] if k else None: v for k, v in sizes.items()}
    aims = {f"={k}" if k is not None else "": v for k, v in targets(named).items()}
    rows = []
    for k in sorted(sizes):
        n = 1 << min(int(math.log2(PLACES)), max(0, round(math.log2(max(1.0, sizes[k] / BLOCK_WORDS)))))
        rounds = min(MOST_TIMES, int(aims[k] // sizes[k])) if sizes[k] else 0
        rest = round(aims[k] - rounds * sizes[k]) if rounds < MOST_TIMES else 0
        rows.append((k, sizes[k], float(aims[k]), n, rounds, rest))
    wide = len(rows) > BROADCAST_ROWS // 10
    small = lambda df: df if wide else F.broadcast(df)
    first = small(spark.createDataFrame(rows, "_mx_source string, _mx_size long, _mx_target double, _mx_blocks int, _mx_rounds int, _mx_rest long"))
    # the block in which the last round ends: blocks of a source in order, at most PLACES of them
    blocks = cells.join(first, "_mx_source").groupBy("_mx_source", "_mx_rest", block_number().alias("block")).agg(F.sum("words").alias("words"))
    before = F.sum("words").over(Window.partitionBy("_mx_source").orderBy("block")) - F.col("words")
    ends = blocks.withColumn("before", before).where("before < _mx_rest AND before + words >= _mx_rest")
    last = {r[0]: (r[1], r[2]) for r in ends.select("_mx_source", "block", (F.col("_mx_rest") - F.col("before")).alias("words")).collect()}
    quotas = np.array([r[3] * r[4] + (last[r[0]][0] + 1 if r[0] in last else 0) for r in rows], np.int64)
    shards = max(1, round(int(quotas.sum()) / SHARD_BLOCKS))
    full = [(*r[:5], *last.get(r[0], (-1, 0))) for r in rows]
    made = small(spark.createDataFrame(full, "_mx_source string, _mx_size long, _mx_target double, _mx_blocks int, _mx_rounds int, _mx_last int, _mx_words long"))
    nodes = [(low, high, at.tolist(), have.tolist()) for low, high, at, have in split_quotas(quotas, 0, shards, seed, NODE_SHARDS)]
    nodes = spark.createDataFrame(nodes, "low long, high long, start array<long>, have array<long>")
    leaves = nodes.repartition(min(len(rows) and -(-shards // NODE_SHARDS) or 1, 1000)).mapInArrow(_leaves([r[0] for r in rows], seed), "source string, first bigint, end bigint, shard bigint")
    each = leaves.select(F.col("source").alias("_mx_source"), "shard", F.explode(F.sequence("first", F.col("end") - 1)).alias("number"))
    each = each.join(made, "_mx_source").select("_mx_source", "shard", (F.col("number") / F.col("_mx_blocks")).cast("int").alias("round"), (F.col("number") % F.col("_mx_blocks")).cast("int").alias("_mx_block"), "_mx_rounds", "_mx_last")
    whole = (F.col("round") < F.col("_mx_rounds")) | (F.col("_mx_block") != F.col("_mx_last"))
    each = each.select("_mx_source", "_mx_block", F.struct("round", F.col("_mx_block").alias("block"), "shard", whole.alias("whole")).alias("d"))
    deal = materialize(each.groupBy("_mx_source", "_mx_block").agg(F.sort_array(F.collect_list("d")).alias("_mx_deal")), "deal")
    deal = F.broadcast(deal) if int(quotas.sum()) <= BROADCAST_ROWS // 10 else deal
    return made, deal, shards


def _drawn(docs: DataFrame, sources: DataFrame, deal: DataFrame, source: str, text: str, seed: int) -> DataFrame:
    """`docs` plus _mx_n, _mx_size, _mx_target and _mx_draws: an array of (round, block, shard, words), one for each draw of the
    document's block that takes words of the document.

    Only the block of a source that is drawn in part needs its documents in order.
    """
    keyed = docs.withColumns({"_mx_source": _key(source), "_mx_place": _place(seed)}).join(sources, "_mx_source")
    keyed = keyed.withColumn("_mx_block", block_number()).join(deal, ["_mx_source", "_mx_block"], "left")

    def drawn(rows: DataFrame, part: Column) -> DataFrame:
        words = lambda d: F.when(d["whole"], F.col("_mx_n")).otherwise(part).cast("long")
        each = F.transform("_mx_deal", lambda d: F.struct(d["round"].alias("round"), d["block"].alias("block"), d["shard"].alias("shard"), words(d).alias("words")))
        taken = F.coalesce(F.filter(each, lambda d: d["words"] > 0), F.array().cast("array<struct<round:int,block:int,shard:bigint,words:bigint>>"))
        return rows.select(*docs.columns, "_mx_n", "_mx_size", "_mx_target", taken.alias("_mx_draws"))

    sized = keyed.withColumn("_mx_n", size_of(text))
    other = sized.where("_mx_block <> _mx_last")
    ends = sized.where("_mx_block = _mx_last")
    order = Window.partitionBy("_mx_source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "_mx_n").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_mx_before", F.sum("_mx_n").over(order) - F.col("_mx_n"))
    return drawn(other, F.lit(0)).unionByName(drawn(ends, F.least(F.col("_mx_n"), F.greatest(F.lit(0), F.col("_mx_words") - F.col("_mx_before")))))


def draws(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """`docs` plus size, source_size, target and draws (round, block, shard, words); these replace columns of the same name."""
    results = {"size": "_mx_n", "source_size": "_mx_size", "target": "_mx_target", "draws": "_mx_draws"}
    sources, deal, _ = plan(docs, source, text, seed)
    out = _drawn(docs, sources, deal, source, text, seed)
    return out.select(*[c for c in docs.columns if c not in results], *[F.col(v).alias(k) for k, v in results.items()])


def first_words(text: str, words: Column) -> Column:
    """The text up to the end of its word number `words`, white space as it stands."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """The mixed corpus: a row for each draw, with the columns of `docs`, dealt to shards and shuffled inside each.

    The one document of a source that is cut keeps its first words."""
    sources, deal, shards = plan(docs, source, text, seed)
    drawn = _drawn(docs, sources, deal, source, text, seed).select("*", F.explode("_mx_draws").alias("_mx_d"))
    cut = F.when(F.col("_mx_d.words") < F.col("_mx_n"), first_words(text, F.col("_mx_d.words"))).otherwise(F.col(text))
    out = drawn.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns], F.col("_mx_d.shard").alias("_mx_shard"), F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("_mx_d.round")).alias("_mx_order"))
    partitions = min(shards, MAX_PARTITIONS)
    own = F.floor(F.col("_mx_shard") * partitions / shards).cast("int")
    out = out.repartitionById(partitions, own).sortWithinPartitions("_mx_shard", "_mx_order", "doc_id")
    return out.select(*docs.columns)
