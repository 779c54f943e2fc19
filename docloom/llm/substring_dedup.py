"""Removal of repeated byte strings by external suffix sorting.

Every byte covered by a `LENGTH`-byte string that also starts in a document with a smaller doc_id goes.  Texts are
their UTF-8 bytes; matches never cross documents; overlaps count; strings are judged on the input.

1. Equal texts: all but those of the smallest doc_id go whole (or stay, below LENGTH bytes).
2. Sharding: each string belongs to its anchor, the place in it whose GRAM-byte hash is least.  Equal strings have
   equal anchors.  The strings of one anchor place form a segment, at most 2 * LENGTH - GRAM bytes long.  Equal segments
   are collapsed to their smallest document, first inside each batch of texts, then by anchor; the others' bytes
   go.  Anchors that a single document holds are dropped.
3. Suffix sorting: the segments left, where different segments share an anchor, are cut from the texts, dealt
   to shards by anchor, and every shard is sorted by external induced sorting (`suffix.py`).  Suffixes whose common
   prefix reaches LENGTH are one string; those of larger documents go.
4. The removed ranges of a document are merged and cut from its text.

Hot anchors: a batch that holds many segments of one anchor sends two of them to the anchor's task, which then
knows that the anchor is shared, and asks for all of them straight away.  Segments of an anchor with many
segments are dealt to shards string by string, each distinct string of a batch once.

Equal texts are known by their SHA-256, and equal segments by two hashes of 64 bits that must agree, of the anchor's
bytes and of all the segment's; so what goes in steps 1 and 2 rests on hashes.  What step 3 decides, it decides on bytes.

Defined cases: null text is empty; texts below LENGTH bytes lose nothing; repeated rows are equals, neither is
smaller; rows of one doc_id are one document, reported row by row; null ids come after all others; extra columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import suffix
from docloom.llm.common import BROADCAST_ROWS, materialize, release, semi_checked, text_or_empty

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text hashed at once; longer texts are cut into overlapping parts.
PART = 1 << 21
#: Bytes of text in which equal segments are collapsed before they are sent, and rows that are cut or ended at once.
COLLAPSED, ROWS = 1 << 23, 500
#: Bytes of segments a shard should hold, and shards at most; beyond that they grow, in files.
SHARD_BYTES, MAX_SHARDS = 1 << 22, 100_000
#: Segments of one anchor in a batch, and in all, beyond which it is hot: the latter are more than a shard holds.
HOT_BATCH, HOT = 32, SHARD_BYTES // (2 * LENGTH - GRAM)
#: Segments whose strings are listed at once.
SEGMENTS_AT_ONCE = 1 << 13
OCCURRENCE, REMOVED, WANTED, SPEAKS = 0, 1, 2, 3
_SPANS = "array<struct<low:bigint,high:bigint>>"
FINISHED = f"key bigint, n_bytes bigint, spans {_SPANS}, kept binary"

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_INDEX = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    x = np.zeros(len(raw) + 7, np.uint64)
    x[: len(raw)] = raw
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    return x


def anchors(eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, low, high, hash) of the anchors of some texts that lie end to end, given as their `_eights`.

    The strings of an anchor begin at low .. high (places in raw); `place` is where its gram begins.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n = len(eights)
    if n < LENGTH:
        return none
    size = n - GRAM + 1
    grams = _mix(eights[:size] * _M3 + _mix(eights[8 : 8 + size]))
    grams = _mix(grams + eights[GRAM - 8 : GRAM - 8 + size] * _M1)
    packed = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    least, width = packed, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    at = (least & _INDEX).astype(np.int64)  # for each string of LENGTH bytes
    inside = np.zeros(len(at) + 1, np.int32)
    fits = ends - starts >= LENGTH
    np.add.at(inside, np.minimum(starts[fits], len(at)), 1)
    np.add.at(inside, np.minimum(ends[fits] - LENGTH + 1, len(at)), -1)
    where = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(where):
        return none
    at = at[where]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return np.searchsorted(ends, place, "right"), place, where[first], where[last], grams[place]


def _segment_hash(eights: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each segment's bytes and of where its gram lies in it.

    Eight bytes at a time; the last ones are the eight before the segment's end, which may overlap those before."""
    size = high - low + LENGTH
    out = _mix((place - low).astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))
    for k in range(0, 2 * LENGTH - GRAM, 8):
        live = np.flatnonzero(size > k) if k + 8 > LENGTH else slice(None)
        at = low[live] + np.minimum(k, size[live] - 8)
        out[live] = (out[live] + _mix(eights[at] + np.uint64((k + 1) * int(_M3) % (1 << 64)))) * _M1
        out[live] ^= out[live] >> np.uint64(31)
    return out


def _parts(texts: list[bytes], part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end up to some `part` bytes: (raw, starts, ends, number of the text, offset in it)."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def flush():
        sizes = np.array([len(x[0]) for x in held])
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join(x[0] for x in held), np.uint8), ends - sizes, ends, np.array([x[1] for x in held]), np.array([x[2] for x in held])

    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - LENGTH + 1), part):
            piece = t[k : k + part + LENGTH - 1]
            held.append((piece, i, k))
            size += len(piece)
            if size >= part:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(keys, texts) of some COLLAPSED bytes each, of one batch."""
    for batch in batches:
        keys, held, size, first = batch.column(0).to_numpy(zero_copy_only=False), [], 0, 0
        for i, text in enumerate(batch.column(1)):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= COLLAPSED:
                yield keys[first : i + 1], held
                held, size, first = [], 0, i + 1
        if held:
            yield keys[first:], held


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _occurrences(shift: int, part: int, hot_batch: int):
    """Rows (a, c, key, at) of a partition's texts; `at` packs a place, a width and the kind (see _at).

    kind OCCURRENCE: a segment to be compared by anchor a and segment hash c; REMOVED: bytes of a text that go, to c;
    WANTED: a segment of the hot anchor c, to be cut whatever the others say; SPEAKS: one that stands for the others of a
    hot anchor.  The first and last kind are dealt by anchor, the others by a hash of their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _by_bytes(batches):
            found: list[tuple[np.ndarray, ...]] = []
            for raw, starts, ends, number, offset in _parts(texts, part):
                eights = _eights(raw)
                text, place, low, high, a = anchors(eights, starts, ends)
                if len(text):
                    c = _segment_hash(eights, place, low, high)
                    move = offset[text] - starts[text]
                    found.append((a, c, keys[number[text]], low + move, high + move))
            if not found:
                continue
            a, c, key, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            order = _grouped(a, c, key, low)
            a, c, key, low, high = (x[order] for x in (a, c, key, low, high))
            new_a = np.append(True, a[1:] != a[:-1])
            new = new_a | np.append(True, c[1:] != c[:-1])
            owner = key >> shift
            first = owner[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
            gone = owner > first
            # an anchor is hot by its different segments, not by how often one document repeats it
            group = np.cumsum(new_a) - 1
            many = np.bincount(group, new)[group] > hot_batch
            kept = np.flatnonzero(~gone & many)
            if len(kept):
                yield _batch(_route(key[kept], low[kept]), a[kept], key[kept], _at(low[kept], high[kept], WANTED))
                # the smallest and the largest document speak for the others
                by = kept[np.lexsort((owner[kept], group[kept]))]
                g = group[by]
                speak = np.zeros(len(a), bool)
                speak[by[np.append(True, g[1:] != g[:-1])]] = True
                speak[by[np.append(g[1:] != g[:-1], True)]] = True
            else:
                speak = np.zeros(len(a), bool)
            send = np.flatnonzero(~gone & (~many | speak))
            yield _batch(a[send], c[send], key[send], _at(low[send], high[send], np.where(speak[send], SPEAKS, OCCURRENCE)))
            # removed segments of a text, merged
            drop = np.flatnonzero(gone)
            if len(drop):
                k, lo, hi = _merge(key[drop], low[drop], high[drop] + LENGTH)
                yield _batch(_route(k, lo), hi, k, _at(lo, lo, REMOVED))

    return run


OCCURRENCES = "a bigint, c bigint, key bigint, at bigint"


def _grouped(a: np.ndarray, c: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by (a, c, key, low).  Most anchors are alone, so only the others are sorted by all four."""
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    same = sorted_a[1:] == sorted_a[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    part = order[tied]
    order[tied] = part[np.lexsort((low[part], key[part], c[part], a[part]))]
    return order


def _at(low: np.ndarray, high: np.ndarray, kind) -> np.ndarray:
    """low, high - low (below 64) and kind in one number."""
    return low.astype(np.int64) << 8 | (high - low) << 2 | kind


def _route(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _mix(key.astype(np.int64).view(np.uint64) + low.astype(np.int64).view(np.uint64))


def _batch(a: np.ndarray, c: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, c, key, at)], names=["a", "c", "key", "at"])


def _merge(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges low .. high (exclusive) of each key, merged."""
    order = np.lexsort((high, low, key))
    key, low, high = key[order], low[order], high[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    # ranges of different keys are moved apart, so one running maximum serves all
    step = int(high.max()) + 1 if len(high) else 1
    base = (np.cumsum(np.append(True, key[1:] != key[:-1])) - 1) * step if len(key) else key
    reach = np.maximum.accumulate(high + base) if len(key) else high
    new = np.append(True, low[1:] + base[1:] > reach[:-1]) if len(key) else np.zeros(0, bool)
    new[starts] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    return key[first], low[first], reach[last] - base[last]


class _Open:
    """An anchor whose rows go on in the next batch, in the order (c, key).

    Bytes of larger documents go at once.  The segments of each c's smallest document are kept only until documents and
    segments are known to differ; until then they are of one document or of one segment."""

    def __init__(self, shift: int) -> None:
        self.shift, self.held, self.c, self.first, self.low, self.high, self.several = shift, [], None, 0, None, None, False

    def add(self, a: np.ndarray, c: np.ndarray, key: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(a):
            return
        owner, low = key >> self.shift, packed >> 8
        new = np.append(self.c is None or c[0] != self.c, c[1:] != c[:-1])
        first = np.where(np.maximum.accumulate(np.where(new, np.arange(len(a)), -1)) < 0, self.first, owner[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))])
        self.several |= bool((packed & 3 == SPEAKS).any()) or self.c is not None and bool(new[0]) or bool(new[1:].any())
        self.c, self.first = c[-1], first[-1]
        self.low = int(owner.min()) if self.low is None else min(self.low, int(owner.min()))
        self.high = int(owner.max()) if self.high is None else max(self.high, int(owner.max()))
        gone = owner > first
        if gone.any():
            yield _marks(key[gone], np.full(int(gone.sum()), REMOVED), a[gone], low[gone], low[gone] + (packed[gone] >> 2 & 63) + LENGTH)
        self.held.append((a[~gone], key[~gone], low[~gone], low[~gone] + (packed[~gone] >> 2 & 63)))
        if self.several and self.high > self.low:
            for a, key, low, high in self.held:
                if len(a):
                    yield _marks(key, np.full(len(a), WANTED), a, low, high)
            self.held = []


def _by_anchor(shift: int):
    """Sorted rows of whole anchors to (key, kind, a, low, high): bytes to remove and segments to cut.

    Rows come sorted by (a, c, key); an anchor that a batch's end cuts is decided row by row as the rest comes (`_Open`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going, state = None, None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for kind in (REMOVED, WANTED):
                passed = (rows[3] & 3) == kind
                if passed.any():
                    _, c, key, at = (x[passed] for x in rows)
                    low = at >> 8
                    yield _marks(key, np.full(len(key), kind), c, low, c if kind == REMOVED else low + (at >> 2 & 63))
                    rows = [x[~passed] for x in rows]
            if not len(rows[0]):
                continue
            begin = int(np.searchsorted(rows[0], rows[0][0], "right")) if rows[0][0] == going else 0
            cut = max(begin, int(np.searchsorted(rows[0], rows[0][-1])))
            if begin:
                yield from state.add(*(x[:begin] for x in rows))
            yield from _decide([x[begin:cut] for x in rows], shift)
            if cut < len(rows[0]):
                going, state = rows[0][-1], _Open(shift)
                yield from state.add(*(x[cut:] for x in rows))

    return run


MARKS = "key bigint, kind byte, a bigint, low int, high int"


def _marks(key, kind, a, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int8)), pa.array(a.astype(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["key", "kind", "a", "low", "high"])


def _decide(rows: list[np.ndarray], shift: int) -> Iterator[pa.RecordBatch]:
    a, c, key, packed = rows
    if not len(a):
        return
    low, spoken = packed >> 8, packed & 3
    high = low + (packed >> 2 & 63)
    owner = key >> shift
    new_a = np.append(True, a[1:] != a[:-1])
    new = new_a | np.append(True, c[1:] != c[:-1])
    group = np.cumsum(new_a) - 1
    first = owner[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    gone = owner > first
    at = np.flatnonzero(new_a)
    shared = np.maximum.reduceat(owner, at) > np.minimum.reduceat(owner, at)
    # a hot anchor has segments that aren't here
    several = (np.add.reduceat(new.astype(np.int64), at) > 1) | (np.maximum.reduceat(spoken, at) == SPEAKS)
    want = ~gone & (shared & several)[group]
    for which, kind, end in ((gone, REMOVED, LENGTH), (want, WANTED, 0)):
        if which.any():
            yield _marks(key[which], np.full(int(which.sum()), kind), a[which], low[which], high[which] + end)


SEGMENTS = "shard bigint, key bigint, low int, segment binary"


def _cut(shift: int):
    """(key, text, wanted: list of (a, low, high, hot)) to segments; strings of hot anchors one by one, each distinct one of a
    batch once; also what a batch settles itself, as rows without a segment: bytes low .. shard of key go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            shard, key, low, segment = [], [], [], []
            hot: dict[bytes, list[tuple[int, int]]] = {}
            for k, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                for w in wanted:
                    if w["hot"]:
                        for s in range(w["low"], w["high"] + 1):
                            hot.setdefault(raw[s : s + LENGTH], []).append((k, s))
                    else:
                        shard.append(w["a"])
                        key.append(k)
                        low.append(w["low"])
                        segment.append(raw[w["low"] : w["high"] + LENGTH])
            for string, places in hot.items():
                least = min(k >> shift for k, _ in places)
                number = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True)
                for k, s in places:
                    mine = k >> shift == least
                    shard.append(number if mine else s + LENGTH)
                    key.append(k)
                    low.append(s)
                    segment.append(string if mine else None)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(key, pa.int64()), pa.array(low, pa.int32()), pa.array(segment, pa.binary())], names=["shard", "key", "low", "segment"])

    return run


def _sorted_shard(shift: int, memory: int):
    """A partition's segments, suffix-sorted together, to the ranges that go.  Arriving segments are streamed to files beyond
    suffix.IN_MEMORY; see there for what the sorter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as here:
            raw, keys, lows, ends = (suffix.Growing(here, n, kind) for n, kind in (("raw", np.uint8), ("keys", np.int64), ("lows", np.int64), ("ends", np.int64)))
            for batch in batches:
                column = batch.column(3)
                if not len(column):
                    continue
                places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                ends.append(raw.size + places[1:] - places[0])
                raw.append(np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]].copy())
                keys.append(batch.column(1).to_numpy(zero_copy_only=False))
                lows.append(batch.column(2).to_numpy(zero_copy_only=False))
            if not keys.size:
                return
            raw, keys, lows, ends = (x.whole() for x in (raw, keys, lows, ends))

            def strings(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """(segment, string in it, place in raw) of the strings of some segments."""
                end = ends[k : k + SEGMENTS_AT_ONCE]
                begin = np.append(ends[k - 1] if k else 0, end[:-1])
                count = end - begin - LENGTH + 1
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                return np.repeat(np.arange(k, k + len(end)), count), inner, np.repeat(begin, count) + inner

            owners = suffix.storage(here, "owners", np.int64, len(raw))
            owners[:] = suffix.NOBODY
            for k in range(0, len(keys), SEGMENTS_AT_ONCE):
                number, _, place = strings(k)
                owners[place] = keys[number] >> shift
            gone = suffix.repeated_places(raw, owners, LENGTH, here, memory)
            for k in range(0, len(keys), SEGMENTS_AT_ONCE):
                number, inner, place = strings(k)
                which = gone[place]
                number, inner = number[which], inner[which]
                if len(number):
                    key, low, high = _merge(keys[number], lows[number] + inner, lows[number] + inner + LENGTH)
                    yield _marks(key, np.full(len(key), REMOVED), np.zeros(len(key), np.int64), low, high)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the ranges of each text and cuts them out."""
    span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
    for batch in _slices(batches):
        sizes, counts, kept, lows, highs = [], [0], [], [], []
        for text, low, high in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = text.as_py()
            low, high = (np.asarray(x.values, np.int64) for x in (low, high))
            _, low, high = _merge(np.zeros(len(low), np.int64), low, high)
            ends = [0, *high.tolist()]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*low.tolist(), len(raw)], strict=True)))
            sizes.append(len(raw))
            counts.append(counts[-1] + len(low))
            lows.append(low)
            highs.append(high)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lows, highs)]
        spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(span)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(key, doc_id, text as bytes) and the shift that turns a row's key into its document's order.

    Where ids are unique and not null the key is the id.  Else ids are ranked in order (nulls last) and a row's
    place among those of its id is put behind the rank.
    """
    base = docs.select("doc_id", text_or_empty(text).alias("text"))
    counts = base.groupBy("doc_id").count()
    odd = counts.agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    if (odd[0] or 0) <= 1 and not odd[1]:
        return base.select(F.col("doc_id").alias("key"), "doc_id", F.col("text").cast("binary").alias("text")), 0
    shift = max(1, int(odd[0] - 1).bit_length())
    ids = base.select("doc_id").distinct().repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"))
    placed = materialize(ids.select("doc_id", F.monotonically_increasing_id().alias("at")), "ids")
    # the number of a range and a place in it become a place in all
    sizes = sorted(tuple(r) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    before = F.lit(0).cast("long")
    for part, start in zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist(), strict=False):
        before = F.when(F.shiftright("at", 33) == part, F.lit(start).cast("long")).otherwise(before)
    ranks = placed.select("doc_id", (before + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    # a list of numbers stands for the rows of an id, so that no window has to hold their texts
    rows = materialize(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    places = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("doc_id", F.posexplode("rows").alias("place", "row"))
    keys = materialize(places.join(ranks, places.doc_id.eqNullSafe(ranks.doc_id)).select("row", (F.shiftleft("rank", shift) + F.col("place")).alias("key")), "keys")
    return rows.join(keys, "row").select("key", "doc_id", F.col("text").cast("binary").alias("text")), shift


def remove_repeats(docs: DataFrame, text: str = "text", memory: int = 4 * suffix.BLOCK, hot: int = HOT, hot_batch: int = HOT_BATCH, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, spans (the byte ranges that go, merged) and kept (the bytes left) of every row of `docs`."""
    base, shift = _keyed(docs, text)
    narrow = materialize(base.select("key", "doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n")), "texts")
    order = F.shiftright("key", shift)
    least = narrow.where(f"n >= {LENGTH}").groupBy("h").agg(F.min(order).alias("least"))
    copies = materialize(narrow.join(least, "h").where(order > F.col("least")).select("key", "doc_id", "n"), "copies")
    rest = semi_checked(base, copies.select("key"), "key", "left_anti")

    found = rest.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInArrow(_occurrences(shift, part, hot_batch), OCCURRENCES)
    marks = found.repartition("a").sortWithinPartitions("a", "c", "key").mapInArrow(_by_anchor(shift), MARKS)
    marks = materialize(marks, "marks")
    release(docs.sparkSession)

    wanted = marks.where(F.col("kind") == WANTED).select("key", "a", "low", "high").distinct()
    many = materialize(wanted.groupBy("a").count().where(F.col("count") > hot).select("a", F.lit(True).alias("many")), "hot")
    release(docs.sparkSession)
    # at most (segments wanted) / hot rows
    n_hot = many.count()
    many = F.broadcast(many) if n_hot <= BROADCAST_ROWS else many
    wanted = wanted.join(many, "a", "left").groupBy("key").agg(F.collect_list(F.struct("a", "low", "high", F.coalesce("many", F.lit(False)).alias("hot"))).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    release(docs.sparkSession)
    texts = semi_checked(rest, wanted.select("key"), "key").select("key", "text").join(wanted, "key")
    cut = texts.mapInArrow(_cut(shift), SEGMENTS)
    # only hot anchors settle ranges while they are cut, and so have a second use for the segments
    cut = materialize(cut, "segments") if n_hot else cut
    total = wanted.agg(F.coalesce(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, w: s + w["high"] - w["low"] + LENGTH)), F.lit(0))).first()[0]
    count = max(1, min(MAX_SHARDS, -(-total // SHARD_BYTES)))
    shards = cut.where("segment IS NOT NULL").repartition(count, "shard").mapInArrow(_sorted_shard(shift, memory), MARKS)

    gone = marks.where(F.col("kind") == REMOVED).select("key", "low", "high")
    gone = gone.unionByName(shards.select("key", "low", "high"))
    if n_hot:
        gone = gone.unionByName(cut.where("segment IS NULL").select("key", "low", F.col("shard").cast("int").alias("high")))
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("r"))
    gone = materialize(gone.select("key", F.col("r.low").alias("lows"), F.col("r.high").alias("highs")), "removed")

    ids = gone.select("key")
    ended = semi_checked(rest, ids, "key").select("key", "text").join(gone, "key").select("key", "text", "lows", "highs").mapInArrow(_finish, FINISHED)
    ended = ended.join(narrow.select("key", "doc_id"), "key") if shift else ended.withColumn("doc_id", F.col("key"))
    columns = ["doc_id", "n_bytes", "spans", "kept"]
    size, none = F.octet_length("text").cast("long"), F.array().cast(_SPANS)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").alias("high")))
    whole = copies.select("doc_id", F.col("n").alias("n_bytes"), all_of.alias("spans"), F.lit(b"").alias("kept"))
    clean = semi_checked(rest, ids, "key", "left_anti").select("doc_id", size.alias("n_bytes"), none.alias("spans"), F.col("text").alias("kept"))
    return ended.select(*columns).unionByName(whole).unionByName(clean)
