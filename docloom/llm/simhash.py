"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link when at most three differ.  Cut it into two halves of 32 bits: then in one
half at most one bit differs.  The anchors of a half are the words of a covering code, the perfect Hamming code
on bits 0 to 30 with bit 31 free: 2^27 anchors, covering radius 1.  So the anchor nearest to one fingerprint is
within 1 + 1 = 2 (covering radius plus threshold) of the other one.  Each fingerprint is listed at its nearest
anchor and replicated to every anchor within that distance (at most 17 a half); the comparison runs per anchor, as
an equality join of the two lists that keeps pairs with at most three differing bits.  Halves that differ in one
bit differ in parity, and equal halves have the same nearest anchor, so only odd halves are replicated beyond
their own.

An anchor that is the nearest of more than HOT different fingerprints is split: what differs in at most three bits of the
other half agrees in one of its quarters but for one bit, so there the lists are joined by the anchor and a quarter, once
as it is and once with each bit flipped.

Equal fingerprints are one row before anything is replicated: copies cost nothing.  Links between different
fingerprints are all found; the documents of one fingerprint share its component.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; rows of one doc_id are one
document; rows without an id always stay and never name a component, whose id is null if it has no other rows;
an empty table gives an empty table; other columns are not read, and pass through where documents are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, materialize, semi_checked, written
from docloom.llm.components import connected_components

SEED = 42
LIMIT = 3
#: Different fingerprints at their nearest anchor beyond which it is split.
HOT = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned fingerprint of one text; shingles of `size` words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = len(words)
    if n < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = n - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for k in range(0, m, BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row."""
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def _anchor_masks() -> np.ndarray:
    """Row s: what to flip in a 32-bit half of syndrome s to reach the anchors within distance 2.

    Column 0 leads to the nearest anchor.  With s = 0 the half is an anchor and no other is within 2 on bits 0-30;
    else flipping bits i and j with (i+1) xor (j+1) = s leads to the others.  The last column flips the free bit.
    Unused places repeat column 0.
    """
    out = np.zeros((32, 17), np.uint32)
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and i != s and i < i ^ s]
        row = [home, *pairs]
        out[s] = row + [home] * (16 - len(row)) + [home ^ (1 << 31)]
    return out


MASKS = _anchor_masks()
#: Bit j of the syndrome is the parity of the places whose number (from 1) has bit j.
CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, nearest): the anchors each uint64 fingerprint goes to; bit 32 of an anchor names the half."""
    rows, keys, home = [], [], []
    for half in (0, 1):
        x = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        syndrome = np.zeros(len(x), np.intp)
        for j, check in enumerate(CHECKS):
            syndrome |= _parity(x & check).astype(np.intp) << j
        near = x ^ MASKS[syndrome, 0]
        at = np.arange(len(x))
        rows.append(at)
        keys.append(near.astype(np.int64) | half << 32)
        home.append(np.ones(len(x), bool))
        odd = at[_parity(x) == 1]
        far = x[odd, None] ^ MASKS[syndrome[odd], 1:]
        use = far != near[odd, None]
        rows.append(np.broadcast_to(odd[:, None], far.shape)[use])
        keys.append(far[use].astype(np.int64) | half << 32)
        home.append(np.zeros(int(use.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys, home = anchors(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), pa.array(home)], names=["anchor", "fp", "home"])


def _quarters(rows: DataFrame, flipped: bool) -> DataFrame:
    """A row for each quarter of the half that the anchor isn't of; `flipped`: and for each bit of it flipped."""
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)]) if flipped else F.array(F.lit(0))
    parts = F.array(other.bitwiseAND(0xFFFF), F.shiftright(other, 16).bitwiseAND(0xFFFF))
    keys = F.flatten(F.transform(parts, lambda q, k: F.transform(flips, lambda f: q.bitwiseXOR(f.cast("long")) + k * 65536)))
    return rows.withColumn("quarter", F.explode(keys))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): the pairs of different fingerprints of the column `fp` within the limit, from the anchor lists."""
    lists = materialize(distinct.select("fp").mapInArrow(_replicated, "anchor bigint, fp bigint, home boolean"), "anchors")
    many = materialize(lists.where("home").groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # two fingerprints that share their nearest anchor would meet twice there
    once = ~F.col("bh") | (F.col("a") < F.col("b"))

    def met(near: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        a, b = near.select(*on, F.col("fp").alias("a")), other.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("fp").alias("b"), F.col("home").alias("bh"))
        same = F.lit(True)
        for c in on:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return a.join(b, same & (differ <= LIMIT) & (differ > 0) & once).select("a", "b")

    if many.isEmpty():
        return met(lists.where("home"), lists, ["anchor"])
    few, rest = semi_checked(lists, many, "anchor", "left_anti"), semi_checked(lists, many, "anchor")
    split = met(_quarters(rest.where("home"), False), _quarters(rest, True), ["anchor", "quarter"])
    return met(few.where("home"), few, ["anchor"]).unionByName(split.distinct())


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    marks = materialize(fingerprints(docs, text), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS, find: Callable[[DataFrame, str], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each component that `find` names stays, the one of the smallest doc_id; columns as they were.

    Rows that repeat a doc_id are one document: of those the first by text (null first) stays.  The tables that `find` makes on
    its way are deleted when the components are written.
    """
    found = written(lambda: find(docs, text).select("doc_id", "component_id"), docs.sparkSession, "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return out
    small = again.count() <= broadcast_rows
    hint = F.broadcast(again) if small else again
    row = F.struct(F.col(text).alias("_sh_t"), *[F.col(c).alias(f"_sh_{i}") for i, c in enumerate(docs.columns)])
    first = out.join(hint, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_sh_row"))
    first = first.select(*[F.col(f"_sh_row._sh_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.join(hint, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
