"""Near-duplicates by the Jaccard similarity of word shingles: SimHash with anchor points finds candidates, the sets decide.

A document is the set of its shingles of `SIZE` words (ASCII lower case; fewer words are one shingle; none an empty set).
Two link when the Jaccard similarity of their sets is `SIMILARITY` or more, computed from the whole sets: no link is
wrong.

Candidates come from operator 9's method at a wider threshold.  At similarity 0.8 two fingerprints differ in up to 15.1 % of
their bits, arccos(8/9)/pi, which 64 bits don't tell from chance and no covering of few bits reaches.  So the fingerprint has
`BITS` bits (the same majority rule, a hash of its own every 64 bits), and `BLOCKS` blocks of it have covering codes of their own:
the anchors of a block are pairs of words of the perfect Golay code (23 bits, covering radius 3, 2^12 anchors), and a
fingerprint is listed at its nearest anchor of every block.  Two lists meet in a block with a chance of 1.5 % at similarity 0.8
and 2.7 % at 0.85; over all blocks a pair of exactly 0.8 is missed with a chance of about 1e-5 (`missed` calculates it), less
above.  More rows at fewer blocks, as operator 9 replicates, cost more here for the same chance.  Sets of at most `FEW` shingles, whose
bits tie more often, have `FEW_BLOCKS`.

Equal sets are one row before anything else.  Lists carry 64 bits of their set; at most anchors no other set is within `NEAR` of them,
and the row ends there.  The comparison runs per anchor: sets that share one and differ in at most `FAR` of 192 bits are of one family, and so is what is reached over such sets.  An anchor gives rows that tie its
families, not pairs; what the first blocks have tied is one family in the later ones, so those only give what ties families.
Chance meetings of unlike sets end there.  In a family each set is first compared with the family's first one, and then all
that are outside the family's largest component with everybody, block by block (`_crossed`), so pairs are never rows.

Defined cases as in simhash: null, empty and blank texts are equal; rows without an id always stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import BROADCAST_ROWS, materialize, release, semi_checked
from docloom.llm.components import connected_components

SIZE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and blocks it is listed in.
BITS, BLOCKS = 2048, 1000
#: Sets of up to FEW shingles are listed in FEW_BLOCKS.
FEW, FEW_BLOCKS = 30, 4000
#: Words of 64 bits of the fingerprint that lists carry, and differing bits of those beyond which a pair is no candidate: 7 standard
#: deviations from similarity 0.8, 5 from the most that sets of FEW shingles differ in.
WORDS, FAR = 3, 64
#: Differing bits of the first word beyond which a pair is no candidate: 6 standard deviations from similarity 0.8, almost 5 from the most
#: that sets of FEW shingles differ in; one chance meeting in eight is within.
NEAR = 27
#: Sets at an anchor up to which all pairs are compared at once, sets that a task holds of an anchor, and sets in a block of those
#: that are compared in full.
PAIRED, HELD, CELL = 32, 1 << 20, 256
#: Bytes of lists that a pass makes for each byte of text, the least blocks of a pass, and the most whose families are tied first.
LISTED, LEAST, EARLY = 1.2, 50, 100
_RNG = np.random.Generator(np.random.PCG64(simhash.SEED))
FACTORS, TERMS = (_RNG.integers(0, 1 << 63, BITS // 64 - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are counted at once (they fit a byte), and rows sent on at once.
BLOCK, SLICE = 255, 64


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and the error that each syndrome stands for."""

    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= 0b101011100011 << (i - 11)
        return v

    parts = np.array([[syndrome((b << 8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    for places in (c for w in range(1, 4) for c in combinations(range(23), w)):
        error = sum(1 << i for i in places)
        errors[syndrome(error)] = error
    return parts, errors


SYNDROMES, ERRORS = _golay()
#: The places of each block, two words of 23 and a zero before each; every cut of the bits uses none twice.
_CUT = BITS // 46
_ORDERS = np.concatenate([_RNG.permutation(BITS)[: _CUT * 46].reshape(_CUT, 2, 23) for _ in range(-(-FEW_BLOCKS // _CUT))])[:FEW_BLOCKS]
PLACES = np.concatenate([np.full((FEW_BLOCKS, 2, 1), BITS), _ORDERS], axis=2)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, joined, digest = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, simhash.SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = n - size + 1
    return np.unique(np.fromiter((digest(joined[a:b], simhash.SEED) for a, b in zip(starts[:m].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, m))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bytes of a set's fingerprint: a bit is 1 if set in over half of its shingles' hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK, None]
        more = part * FACTORS + TERMS
        more = (more ^ (more >> np.uint64(32))) * MIX
        words = np.concatenate([part, more ^ (more >> np.uint64(29))], axis=1)
        counts += np.add.reduce(np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes))


def anchors(prints: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row a fingerprint, a column a block from `first` to before `last`: the block and its nearest anchor."""
    bits = np.concatenate([np.unpackbits(prints, axis=1), np.zeros((len(prints), 1), np.uint8)], axis=1)
    packed = np.packbits(bits[:, PLACES[first:last].reshape(-1)].reshape(-1, 24), axis=1)
    words = packed[:, 0].astype(np.uint32) << 16 | packed[:, 1].astype(np.uint32) << 8 | packed[:, 2]
    syndromes = SYNDROMES[0][packed[:, 2]] ^ SYNDROMES[1][packed[:, 1]] ^ SYNDROMES[2][packed[:, 0]]
    # the high 12 bits of a code word name it
    names = ((words ^ ERRORS[syndromes]) >> 11).astype(np.int64).reshape(len(prints), -1, 2)
    return np.arange(first, last, dtype=np.int64) << 24 | names[:, :, 0] << 12 | names[:, :, 1]


def missed(differ: float, blocks: int = BLOCKS) -> float:
    """The chance that two fingerprints whose bits differ with the chance `differ` share no anchor."""
    words = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 23, 1 << 15, dtype=np.uint32)

    def nearest(v: np.ndarray) -> np.ndarray:
        return v ^ ERRORS[SYNDROMES[0][v & 255] ^ SYNDROMES[1][v >> 8 & 255] ^ SYNDROMES[2][v >> 16]]

    # equal anchors mean that the difference is the sum of a word of the code and two errors, so of at most 6 bits for the zero word
    rng, meet = np.random.Generator(np.random.PCG64(2)), np.zeros(7)
    for w in range(7):
        flips = np.argsort(rng.random((len(words), 23)), axis=1)[:, :w].astype(np.uint32)
        meet[w] = (nearest(words) == nearest(words ^ (np.uint32(1) << flips).sum(axis=1).astype(np.uint32))).mean()
    z = np.linspace(-6, 6, 601)
    share = np.clip(differ + z * (differ * (1 - differ) / BITS) ** 0.5, 1e-9, 1)
    once = sum(comb(23, w) * share**w * (1 - share) ** (23 - w) * meet[w] for w in range(7)) ** 2
    weight = np.exp(-z * z / 2)
    return float((weight * (1 - once) ** blocks).sum() / weight.sum())


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            sets = [shingles(t.as_py()) for t in part.column(1)]
            fps = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            columns = [part.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "fp", "n", "print"])


LISTS, KEPT = "band bigint, fp bigint, own bigint, w0 bigint", ", ".join(["own bigint", *[f"w{i} bigint" for i in range(1, WORDS)]])
MET = "band bigint, first bigint, fp bigint, place bigint"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        words = prints[:, 8 : 8 * WORDS].copy().view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(w) for w in words.T]], names=["own", *[f"w{i}" for i in range(1, WORDS)]])


def _listed(first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                each = [*(part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), prints[:, :8].copy().view(np.int64)[:, 0]]
                columns = [anchors(prints, first, last).reshape(-1), *[np.repeat(c, last - first) for c in each]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "fp", "own", "w0"])

    return lists


def _near(fps: np.ndarray, words: np.ndarray, begins: np.ndarray, near: int) -> np.ndarray:
    """Which rows have a row of another fp at their anchor within `near` bits of the first word; at anchors of more than PAIRED rows, all that
    have another fp there."""
    n = len(fps)
    ends = np.append(begins[1:], n)
    sizes = ends - begins
    keep = np.repeat((fps[ends - 1] != fps[begins]) & (sizes > PAIRED), sizes)
    stop = np.repeat(ends, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= PAIRED), sizes))
    for d in range(1, PAIRED):
        at = at[at + d < stop[at]]
        if not len(at):
            break
        a = at[(fps[at] != fps[at + d]) & (np.bitwise_count(words[at] ^ words[at + d]) <= near)]
        keep[a] = keep[a + d] = True
    return keep


def _shared(near: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of (band, fp) those that may be tied at their anchor, by the first word.  Holds an anchor of up to PAIRED
    rows, or the rows of one fp at one anchor, which go on unseen where they are more than HELD."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, band, mixed = None, None, False

        def kept(columns: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["band", "fp", "own", "w0"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            bands, fps, _, words = columns
            n = len(bands)
            if not n:
                continue
            begins = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))
            keep = _near(fps, words.view(np.uint64), begins, near)
            if mixed and bands[0] == band:
                keep[: begins[1] if len(begins) > 1 else n] = True
            last = begins[-1]
            size, alone = n - last, fps[-1] == fps[last]
            mixed, band = bool(mixed and last == 0 and bands[0] == band) or size > (HELD if alone else PAIRED), bands[-1]
            keep[last:] |= mixed
            cut = n if mixed else last
            held = None if mixed else [c[cut:] for c in columns]
            yield kept([c[:cut] for c in columns], keep[:cut])
        if held:
            yield kept(held, _near(held[1], held[3].view(np.uint64), np.zeros(1, np.intp), near))

    return shared


def _differ(words: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)


def _reached(same: np.ndarray, words: np.ndarray, far: int) -> np.ndarray:
    """The first row reachable from each row of one anchor, over rows within `far` bits or of equal `same`.

    A reached row is only compared with what is not reached yet, so an anchor of much alike sets costs little."""
    out, left = np.empty(len(same), np.int64), np.arange(len(same))
    while len(left):
        start = left[0]
        hit = same[left] == same[start]
        queue: list[int] = []
        while True:
            out[left[hit]] = start
            queue += left[hit].tolist()
            left = left[~hit]
            while queue and len(left):
                close = _differ(words, queue.pop(), left) <= far
                if close.any():
                    hit = np.isin(same[left], same[left[close]])
                    break
            else:
                break
    return out


def _tied(columns: list[np.ndarray], paired: int, far: int, all_one: bool = False) -> pa.RecordBatch:
    """Rows of whole anchors in the order of (band, fp) to (band, first, fp, place): each fp that is reached from a smaller one over rows
    of unlike fp within `far` bits, the smallest so reached, and its place there.  all_one: whole anchors are."""
    bands, fps, words = columns[0], columns[1], np.array(columns[2:]).view(np.uint64)
    n = len(bands)
    begins = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))[: n or 0]
    sizes = np.diff(np.append(begins, n))
    ends = np.repeat(begins + sizes, sizes)
    # the first row of the same fp at the anchor
    new = np.concatenate(([True], (bands[1:] != bands[:-1]) | (fps[1:] != fps[:-1])))[:n]
    same = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.repeat(begins, sizes) if all_one else same.copy()
    if not all_one:
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= paired), sizes))
        found = []
        for d in range(1, paired):
            at = at[at + d < ends[at]]
            if not len(at):
                break
            a = at[same[at] != same[at + d]]
            a = a[_differ(words, a, a + d) <= far]
            found.append((a, a + d))
        a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(2))
        while True:
            low = np.minimum(label[a], label[b])
            less = label.copy()
            np.minimum.at(less, same[a], low)
            np.minimum.at(less, same[b], low)
            less = less[same]
            if (less == label).all():
                break
            label = less
        for k, size in zip(begins[sizes > paired].tolist(), sizes[sizes > paired].tolist(), strict=True):
            if new[k : k + size].sum() > 1:
                label[k : k + size] = k + _reached(same[k : k + size], words[:, k : k + size], far)
    rows = np.flatnonzero(new)
    rows = rows[np.argsort(label[rows], kind="stable")]
    place = np.arange(len(rows)) - np.searchsorted(label[rows], label[rows])
    rows, place = rows[place > 0], place[place > 0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (bands[rows], fps[label[rows]], fps[rows], place)], names=["band", "first", "fp", "place"])


def _met(paired: int, held_rows: int, far: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`_tied` over rows in the order of (band, fp).  Holds one anchor; one of more than `held_rows` rows is taken as reached as a whole,
    and then only its first row is held."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            if not len(columns[0]):
                continue
            if over:
                end = np.searchsorted(columns[0], columns[0][0], "right")
                yield _tied([c[:end] for c in columns], paired, far, all_one=True)
                if end == len(columns[0]):
                    held = [c[:1] for c in columns]
                    continue
                columns, over = [c[end:] for c in columns], False
            cut = np.searchsorted(columns[0], columns[0][-1])
            yield _tied([c[:cut] for c in columns], paired, far)
            held = [c[cut:] for c in columns]
            if len(held[0]) > held_rows:
                yield _tied(held, paired, far, all_one=True)
                held, over = [c[:1] for c in held], True
        if held and not over:
            yield _tied(held, paired, far)

    return met


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            sets = [shingles(t.as_py()) for t in batch.column(0).slice(k, SLICE)]
            fps = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "members"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets (fp, members) are similar enough."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("members").alias(f"m{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = both.select("a", "b", F.size(F.array_intersect("ma", "mb")).alias("c"), (F.size("ma") + F.size("mb")).alias("s"))
    return common.where(F.col("c") / (F.col("s") - F.col("c")) >= SIMILARITY).select("a", "b")


CELLS = "cell bigint, side int, fp bigint, root bigint, members array<bigint>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole cells, residents (side 0) before guests, to (fp, other): guests and residents of other components
    that are similar enough, as many as tie these components.  Holds the residents of one cell."""
    cell, held, index = None, [], None
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    for batch in batches:
        cells, sides, fps, roots = (batch.column(i).to_pylist() for i in range(4))
        found: list[tuple[int, int]] = []
        for k, members in enumerate(batch.column(4)):
            mine = np.asarray(members.values).view(np.uint64)
            if cells[k] != cell:
                cell, held, index = cells[k], [], None
                above.clear()
            if sides[k] == 0:
                held.append((fps[k], roots[k], mine))
                continue
            if not held:
                continue
            if index is None:
                owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
                flat = np.concatenate([x[2] for x in held])
                order = np.argsort(flat, kind="stable")
                index = flat[order], owner[order], np.array([len(x[2]) for x in held])
            flat, owner, sizes = index
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            common = np.bincount(owner[at], minlength=len(held))
            for i in np.flatnonzero(common / (sizes + len(mine) - common) >= SIMILARITY).tolist():
                if (one := top(held[i][1])) != (other := top(roots[k])):
                    above[one] = other
                    found.append((fps[k], held[i][0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["fp", "other"])


def _crossed(families: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, other): links between sets of one family (fp, family) that are in different components so far.

    A family's largest component is its host, the members of other components are guests and are compared with everybody.
    A family is cut into blocks of some CELL sets, and each block of guests meets each block of the family in a cell of
    its own, so no task holds more than a block, and pairs are never rows."""
    state = families.join(roots, "fp", "left").select("family", "fp", F.coalesce("root", "fp").alias("root"))
    sizes = state.groupBy("family", "root").agg(F.count(F.lit(1)).alias("c"))
    hosts = sizes.groupBy("family").agg(F.max(F.struct("c", "root")).alias("host"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    met = materialize(state.join(hosts.select("family", F.col("host.root").alias("host")), "family"), "met")
    guest = F.col("root") != F.col("host")
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    sized = met.groupBy("family").agg(blocks(F.count(F.lit(1))).alias("rows"), blocks(F.count_if(guest)).alias("columns"))
    full = met.join(sized, "family").join(sets, "fp")
    place = F.xxhash64("fp")
    of = lambda side, row, column: F.struct(F.xxhash64("family", row, column).alias("cell"), F.lit(side).alias("side"))
    resident = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: of(0, F.pmod(place, "rows").cast("int"), j))
    visits = F.when(guest, F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: of(1, i, F.pmod(place, "columns").cast("int"))))
    cells = full.select("fp", "root", "members", F.explode(F.concat(resident, F.coalesce(visits, F.array().cast("array<struct<cell:bigint,side:int>>")))).alias("c"))
    cells = cells.select("c.cell", "c.side", "fp", "root", "members").repartition("cell").sortWithinPartitions("cell", "side")
    return cells.mapInArrow(_compared, "fp bigint, other bigint")


def _step(size: float) -> int:
    """Blocks of a pass, for sets of `size` bytes of text each."""
    return min(BLOCKS, max(LEAST, int(LISTED * size / 32)))


def meetings(distinct: DataFrame, size: float, far: int = 64 * WORDS, start: int = 0, stop: int = FEW_BLOCKS) -> DataFrame:
    """(band, first, fp, place): the sets (fp, n, print) that are tied to a smaller fp at an anchor of the blocks from `start` to before
    `stop`, and the smallest of those tied there.  `own` names a set apart from its fp, where that is a family's.

    The lists are made in passes of some LISTED bytes for each byte of text (`size` a set), each sorted and dropped by itself.  They
    carry one word of a set; the others, which decide, are joined to those that it leaves."""
    spark, step = distinct.sparkSession, _step(size)
    given = distinct.where("n > 0")
    given = given if "own" in given.columns else given.withColumn("own", F.col("fp"))
    words = materialize(given.select("own", "print").mapInArrow(_words, KEPT), "set-words")
    few = given.where(F.col("n") <= FEW)
    spans = [(given, k, min(k + step, stop, BLOCKS)) for k in range(start, min(stop, BLOCKS), step)]
    if stop > BLOCKS and not few.isEmpty():
        spans += [(few, k, min(k + BLOCKS, stop)) for k in range(max(start, BLOCKS), stop, BLOCKS)]
    out = []
    for rows, first, last in spans:
        lists = rows.select("fp", "own", "print").mapInArrow(_listed(first, last), LISTS)
        lists = lists.repartition("band").sortWithinPartitions("band", "fp")
        shared = materialize(lists.mapInArrow(_shared(NEAR if far < 64 * WORDS else 64), LISTS), "shared").join(words, "own").select("band", "fp", *[f"w{i}" for i in range(WORDS)])
        shared = shared.repartition("band").sortWithinPartitions("band", "fp")
        out.append(materialize(shared.mapInArrow(_met(PAIRED, HELD, far), MET), "meetings"))
        release(spark)
    return reduce(DataFrame.unionByName, out)


def families(distinct: DataFrame, size: float) -> DataFrame:
    """(fp, family): the families of more than one of the sets (fp, n, print), named by their smallest fp."""
    early = min(_step(size), EARLY)
    edges = meetings(distinct, size, FAR, stop=early).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    tied = materialize(connected_components(edges).select(F.col("node").alias("fp"), "root"), "early-tied")
    named = materialize(distinct.join(tied, "fp", "left").select(F.coalesce("root", "fp").alias("fp"), F.col("fp").alias("own"), "n", "print"), "early-families")
    later = meetings(named, size, FAR, start=early).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    edges = tied.select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(later)
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("root").alias("family"))


def links(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, root): the components of the families (fp, family) by similarity; sets without links have no row."""
    good = materialize(similar(found.where("fp <> family").select(F.col("family").alias("a"), F.col("fp").alias("b")), sets), "similar")
    roots = materialize(connected_components(good).select(F.col("node").alias("fp"), "root"), "set-roots")
    crossed = _crossed(found, roots, sets).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    edges = roots.select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(materialize(crossed.distinct(), "crossed"))
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    texts = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    all_marks = materialize(texts.mapInArrow(_marks, "doc_id bigint, fp bigint, n bigint, print binary"), "shingle-marks")
    marks = all_marks.select("doc_id", "fp")
    each = [F.first(c).alias(c) for c in ("n", "print")]
    distinct = materialize(all_marks.groupBy("fp").agg(F.min("doc_id").alias("first"), *each), "distinct-sets")
    size = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    found = materialize(families(distinct, size), "families")
    wanted = found.select("fp")
    ids = materialize(distinct.join(wanted, "fp").select(F.col("first").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "met-ids")
    given = semi_checked(texts, ids, "doc_id").unionByName(texts.where("doc_id IS NULL"))
    sets = semi_checked(given.select("text").mapInArrow(_sets, "fp bigint, members array<bigint>"), wanted, "fp")
    sets = materialize(sets.groupBy("fp").agg(F.first("members").alias("members")), "sets")
    roots = links(found, sets)
    named = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As simhash.keep_first, over these components."""
    return simhash.keep_first(docs, text, broadcast_rows, near_duplicates)
