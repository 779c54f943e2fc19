"""External induced suffix sorting to a bounded depth, with common-prefix values.

The suffixes of a text are sorted by induction: the leftmost-S suffixes (LMS) are sorted first, by recursive
splitting on their bytes; the L-type suffixes are induced from them in ascending order and the S-type suffixes from
those in descending order.  Both passes are driven by a disk-backed priority queue.  Its tuples are (position,
common prefix with the tuple before); its order is the first symbol, then arrival, which is the order of the suffix
one symbol on.  A tuple's common prefix is one more than the least common prefix between the tuples that induced
it and its neighbour, which range-minimum queries give while the pass runs.

All passes work on blocks of tuples with vector operations.  Beyond IN_MEMORY the text and all that is kept beside each
place are mapped files, beyond `memory` tuples the queues and lists of places are files, and more LMS places than that
are split by sampled words into files until each fits: memory doesn't grow with the text.  Order and common prefixes
are exact up to `depth`; beyond it they don't matter, so the splitting recurses at most depth / PACKED times on equal words.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
#: Texts up to this many symbols are held in memory with what is kept beside each (20 bytes a symbol); longer ones are
#: files that are mapped.
IN_MEMORY = 1 << 23
#: The end of the text, below every byte; bytes are stored one higher.
END = 0
SYMBOLS = 257


def storage(folder: str, name: str, kind: type, n: int) -> np.ndarray:
    """n numbers, in memory or in a mapped file; a plain view, as a map's own indexing costs more."""
    if n <= IN_MEMORY:
        return np.empty(n, kind)
    return np.asarray(np.memmap(os.path.join(folder, name), kind, "w+", shape=(n,)))


class Growing:
    """Numbers appended block by block: in memory up to IN_MEMORY of them, then in a file that is mapped at the end."""

    def __init__(self, folder: str, name: str, kind: type) -> None:
        self.path, self.kind, self.held, self.size, self.out = os.path.join(folder, name), kind, [], 0, None

    def append(self, block: np.ndarray) -> None:
        self.size += len(block)
        self.held.append(np.ascontiguousarray(block, self.kind))
        if self.size > IN_MEMORY:
            self.out = self.out or open(self.path, "wb")  # noqa: SIM115
            for x in self.held:
                x.tofile(self.out)
            self.held = []

    def whole(self) -> np.ndarray:
        if self.out is None:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.out.close()
        return np.asarray(np.memmap(self.path, self.kind, "r"))


class Places:
    """A list of places that is read again in blocks; in a file beyond `memory` of them."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.held, self.size, self.file = folder, memory, [], 0, None

    def append(self, block: np.ndarray) -> None:
        self.size += len(block)
        self.held.append(block)
        if self.file is not None or self.size > self.memory:
            self.file = self.file or tempfile.TemporaryFile(dir=self.folder)  # noqa: SIM115
            self.file.seek(0, os.SEEK_END)
            for x in self.held:
                self.file.write(x.astype(np.int64).tobytes())
            self.held = []

    def blocks(self) -> Iterator[np.ndarray]:
        if self.file is None:
            yield from self.held
            return
        for k in range(0, self.size, BLOCK):
            self.file.seek(8 * k)
            yield np.frombuffer(self.file.read(8 * BLOCK), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.held, self.size, self.file = [], 0, None


class DiskQueue:
    """A priority queue of (position, common prefix) tuples: lowest symbol first, then first in, first out.

    Each symbol's tuples form a list of blocks.  Once more than `memory` tuples are held, the longest list's
    blocks in memory move to its file; reading keeps their order.
    """

    def __init__(self, folder: str, name: str, memory: int = 4 * BLOCK) -> None:
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.lists: list[deque] = [deque() for _ in range(SYMBOLS)]
        self.sizes = [0] * SYMBOLS

    def _path(self, symbol: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{symbol}")

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        self.lists[symbol].append((at, lcp))
        self.sizes[symbol] += len(at)
        self.held += len(at)
        while self.held > self.memory and self._spill():
            pass

    def _spill(self) -> bool:
        symbol = max(range(SYMBOLS), key=self.sizes.__getitem__)
        if not self.sizes[symbol]:
            return False
        with open(self._path(symbol), "ab") as f:
            for i, item in enumerate(self.lists[symbol]):
                if isinstance(item[0], np.ndarray):
                    at, lcp = item
                    self.lists[symbol][i] = (f.tell(), len(at))
                    f.write(at.astype(np.int64).tobytes())
                    f.write(lcp.astype(np.uint8).tobytes())
        self.held -= self.sizes[symbol]
        self.sizes[symbol] = 0
        return True

    def _load(self, symbol: int, item: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(item[0], np.ndarray):
            return item
        place, n = item
        with open(self._path(symbol), "rb") as f:
            f.seek(place)
            return np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(n), np.uint8)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The symbol's next blocks, joined up to BLOCK tuples; what is pushed meanwhile comes later."""
        parts, n = [], 0
        while self.lists[symbol] and n < BLOCK:
            item = self.lists[symbol].popleft()
            if isinstance(item[0], np.ndarray):
                self.sizes[symbol] -= len(item[0])
                self.held -= len(item[0])
            parts.append(self._load(symbol, item))
            n += len(parts[-1][0])
        if not parts:
            return None
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def blocks(self, symbol: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's blocks without removing them."""
        items = self.lists[symbol]
        for item in reversed(items) if backwards else items:
            yield self._load(symbol, item)


class RangeMinimum:
    """Least value between two places of a block, for many pairs at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Inclusive; low <= high."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level):
            use = level == k
            out[use] = np.minimum(self.rows[k][low[use]], self.rows[k][high[use] - (1 << int(k)) + 1])
        return out


#: Symbols a packed word holds, at nine bits each.
PACKED, BITS = 7, 9


def pack(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The PACKED symbols from each place on as one ordered number, zeros past the end, into `out`."""
    n = len(text)
    for low in range(0, n, BLOCK):
        part = np.zeros(min(BLOCK, n - low) + PACKED - 1, np.uint64)
        seen = text[low : low + len(part)]
        part[: len(seen)] = seen
        two = part[:-1] << np.uint64(BITS) | part[1:]
        three = two[:-1] << np.uint64(BITS) | part[2:]
        six = three[:-3] << np.uint64(3 * BITS) | three[3:]
        out[low : low + len(part) - PACKED + 1] = six[:-1] << np.uint64(BITS) | part[PACKED - 1 :]
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most `depth`; no two suffixes are equal, as the end is unlike all."""
    out, live, last = np.full(len(a), depth, np.int64), np.arange(len(a)), len(words) - 1
    for skip in range(0, depth, PACKED):
        differ = words[np.minimum(a[live] + skip, last)] ^ words[np.minimum(b[live] + skip, last)]
        over = differ != 0
        high = np.frexp(differ[over].astype(np.float64))[1]
        # rounding up to the next power of two would name the symbol before
        exact = differ[over] >> np.minimum(high - 1, 63).astype(np.uint64) == 0
        symbol = PACKED - 1 - (high - exact - 1) // BITS
        out[live[over]] = np.minimum(skip + symbol, depth)
        live = live[~over]
        if not len(live):
            break
    return out.astype(np.uint8)


def sort_by_bytes(words: np.ndarray, at: np.ndarray, depth: int, begin: int = 0) -> np.ndarray:
    """The places ordered by the `depth` symbols from `begin` on.  Sorts by one packed word and recurses into the ties only."""
    if len(at) < 2:
        return at
    order, group, last = at, None, len(words) - 1
    live = np.arange(len(at))
    for skip in range(begin, begin + depth, PACKED):
        keys = words[np.minimum(order[live] + skip, last)]
        ranked = np.argsort(keys, kind="stable") if group is None else np.lexsort((keys, group))
        order[live] = order[live][ranked]
        keys = keys[ranked]
        new = np.ones(len(live), bool)
        new[1:] = keys[1:] != keys[:-1]
        if group is not None:
            g = group[ranked]
            new[1:] |= g[1:] != g[:-1]
        ids = np.cumsum(new)
        tied = np.bincount(ids)[ids] > 1
        live, group = live[tied], ids[tied]
        if not len(live):
            break
    return order


def types(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """True where a suffix is below the one after it (S-type), into `out`."""
    n = len(text)
    out[n - 1] = True
    next_type = True
    # blocks from the end, each carrying the type of what follows it
    for low in range((n - 2) // BLOCK * BLOCK, -1, -BLOCK) if n > 1 else ():
        high = min(low + BLOCK, n - 1)
        step = text[low:high].astype(np.int32) - text[low + 1 : high + 1].astype(np.int32)
        decided = np.where(step != 0, np.arange(high - low), -1)
        # the next decided place at or after each one
        ahead = np.minimum.accumulate(np.where(decided >= 0, decided, high - low)[::-1])[::-1]
        known = ahead < high - low
        out[low:high] = np.where(known, step[np.minimum(ahead, high - low - 1)] < 0, next_type)
        next_type = out[low]
    return out


#: Words sampled to split places, and parts they are split into (and one for each splitting word).
SAMPLED, PARTS = 4096, 32


class Induced:
    """Sorts the suffixes of `text` (bytes plus one, closed by END) to `depth`."""

    def __init__(self, text: np.ndarray, depth: int, folder: str, memory: int = 4 * BLOCK) -> None:
        self.text, self.depth, self.folder, self.memory = text, depth, folder, memory
        self.words = pack(text, storage(folder, "words", np.uint64, len(text)))

    def _ordered(self, places: Places, skip: int = 0) -> Iterator[np.ndarray]:
        """Blocks of the places, ordered by the symbols from `skip` to the depth and a word.  Closes `places`."""
        end = self.depth + PACKED - 1
        if places.size <= self.memory or skip >= end:
            found = np.concatenate(list(places.blocks())) if places.size <= self.memory and places.size else None
            if found is not None and skip < end:
                found = sort_by_bytes(self.words, found, end - skip, skip)
            for x in [found[k : k + BLOCK] for k in range(0, len(found), BLOCK)] if found is not None else places.blocks():
                yield x
            places.close()
            return
        last = len(self.words) - 1
        keys = lambda x: self.words[np.minimum(x + skip, last)]
        every = max(1, places.size // SAMPLED)
        sample = np.sort(np.concatenate([keys(x[::every]) for x in places.blocks()]))
        pivots = np.unique(sample[:: max(1, len(sample) // PARTS)])
        parts = [Places(self.folder, self.memory // len(pivots) // 4) for _ in range(2 * len(pivots) + 1)]
        for x in places.blocks():
            k = keys(x)
            low = np.searchsorted(pivots, k, "left")
            part = 2 * low + (pivots[np.minimum(low, len(pivots) - 1)] == k)
            by = np.argsort(part, kind="stable")
            x, part = x[by], part[by]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True):
                parts[part[i]].append(x[i:j])
        places.close()
        for i, part in enumerate(parts):
            if part.size:
                yield from self._ordered(part, skip + PACKED * (i % 2))

    def _lms(self) -> DiskQueue:
        """LMS places by symbol, sorted, with common prefixes."""
        n = len(self.text)
        s = types(self.text, storage(self.folder, "types", bool, n))
        found = [Places(self.folder, self.memory // 64) for _ in range(SYMBOLS)]
        for low in range(1, n, BLOCK):
            high = min(low + BLOCK, n)
            at = np.flatnonzero(s[low:high] & ~s[low - 1 : high - 1]) + low
            symbols = self.text[at]
            by = np.argsort(symbols, kind="stable")
            at, symbols = at[by].astype(np.int64), symbols[by]
            first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(at) else at
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True) if len(at) else ():
                found[symbols[i]].append(at[i:j])
        queue = DiskQueue(self.folder, "lms", self.memory)
        for c in range(SYMBOLS):
            before = None
            for part in self._ordered(found[c]):
                lcp = np.zeros(len(part), np.uint8)
                lcp[1:] = common_prefix(self.words, part[:-1], part[1:], self.depth)
                if before is not None:
                    lcp[0] = self._seam(before, int(part[0]))
                before = int(part[-1])
                queue.push(c, part, lcp)
        return queue

    def _induce(self, queue: DiskQueue, at: np.ndarray, lcp: np.ndarray, least: np.ndarray, low: int, high: int) -> None:
        """Pushes the places before `at` whose symbol is in low .. high.

        least: for each symbol the least common prefix scanned since its last push, kept from block to block."""
        before = at - 1
        inside = at > 0
        symbol = np.where(inside, self.text[np.maximum(before, 0)], SYMBOLS)
        chosen = np.flatnonzero((symbol >= low) & (symbol <= high))
        prefix = np.minimum.accumulate(lcp)
        suffix = np.minimum.accumulate(lcp[::-1])[::-1]
        if not len(chosen):
            np.minimum(least, prefix[-1], out=least)
            return
        order = chosen[np.argsort(symbol[chosen], kind="stable")]
        kinds = symbol[order]
        first = np.ones(len(order), bool)
        first[1:] = kinds[1:] != kinds[:-1]
        between = np.empty(len(order), np.uint8)
        between[first] = np.minimum(prefix[order[first]], least[kinds[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            between[rest] = RangeMinimum(lcp)(order[rest - 1] + 1, order[rest])
        values = np.minimum(between.astype(np.int64) + 1, self.depth).astype(np.uint8)
        starts = np.append(np.flatnonzero(first), len(order))
        np.minimum(least, prefix[-1], out=least)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = int(kinds[a])
            if not self.begun[x]:
                values[a], self.begun[x] = 0, True
            queue.push(x, before[order[a:b]], values[a:b])
            end = order[b - 1]
            least[x] = suffix[end + 1] if end + 1 < len(lcp) else self.depth

    def _seam(self, left: int | None, right: int | None) -> int:
        if left is None or right is None:
            return 0
        return int(common_prefix(self.words, np.array([left]), np.array([right]), self.depth)[0])

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the suffix after it), blocks in DESCENDING order of the suffixes."""
        lms = self._lms()
        # ascending: L-type suffixes from LMS and from each other
        larger = DiskQueue(self.folder, "l", self.memory)
        done = DiskQueue(self.folder, "l-done", self.memory)
        self.begun = [False] * SYMBOLS
        least = np.full(SYMBOLS + 1, self.depth, np.uint8)
        last_l: list[int | None] = [None] * SYMBOLS
        for c in range(SYMBOLS):
            while (block := larger.pop(c)) is not None:
                at, lcp = block
                done.push(c, at, lcp)
                last_l[c] = int(at[-1])
                self._induce(larger, at, lcp, least, max(c, 1), SYMBOLS - 1)
            lead = True
            for at, lcp in lms.blocks(c):
                if lead:
                    lcp = lcp.copy()
                    lcp[0], lead = self._seam(last_l[c], int(at[0])), False
                self._induce(larger, at, lcp, least, c + 1, SYMBOLS - 1)
        # descending: S-type suffixes from all
        smaller = DiskQueue(self.folder, "s", self.memory)
        self.begun = [False] * SYMBOLS
        least = np.full(SYMBOLS + 1, self.depth, np.uint8)
        for c in range(SYMBOLS - 1, -1, -1):
            last = None
            while (block := smaller.pop(c)) is not None:
                at, lcp = block
                last = int(at[-1])
                self._induce(smaller, at, lcp, least, 1, c)
                yield at, lcp
            carry = self._seam(last_l[c], last)
            for at, lcp in done.blocks(c, backwards=True):
                at, shifted = at[::-1], np.empty(len(at), np.uint8)
                # in descending order a tuple's own value belongs to the next one
                shifted[0], shifted[1:] = carry, lcp[:0:-1]
                carry = lcp[0]
                self._induce(smaller, at, shifted, least, 1, c - 1)
                yield at, shifted


#: Of a place where no string begins.
NOBODY = np.iinfo(np.int64).max


def repeated_places(text: np.ndarray, owners: np.ndarray, length: int, folder: str, memory: int = 4 * BLOCK) -> np.ndarray:
    """For each place of `text` (bytes) whether the string of `length` bytes there also begins at a place of a smaller owner.

    owners: for each place, NOBODY where no string may begin.  Strings must not run past what that allows.  Equal strings
    stand together in suffix order, so only the least owner and the places of the open group are kept."""
    n = len(text)
    symbols = storage(folder, "text", np.uint16, n + 1)
    for k in range(0, n, BLOCK):
        symbols[k : min(k + BLOCK, n)] = text[k : k + BLOCK].astype(np.uint16) + 1
    symbols[n] = END
    out = storage(folder, "gone", bool, n)
    out[:] = False
    group, least = Places(folder, memory), NOBODY

    def settle() -> None:
        nonlocal group, least
        for members in group.blocks():
            out[members[owners[members] > least]] = True
        group.close()
        group, least = Places(folder, memory), NOBODY

    def join(members: np.ndarray) -> None:
        nonlocal least
        if len(members):
            group.append(members)
            least = min(least, int(owners[members].min()))

    for at, lcp in Induced(symbols, length, folder, memory).suffixes():
        at = np.minimum(at, n - 1) if n else at
        valid = owners[at] != NOBODY
        number = np.cumsum(lcp < length)
        if number[-1] == 0:
            join(at[valid])
            continue
        join(at[valid & (number == 0)])
        settle()
        middle = valid & (number > 0) & (number < number[-1])
        members, ids = at[middle], number[middle]
        if len(members):
            best = np.full(int(number[-1]) + 1, NOBODY)
            np.minimum.at(best, ids, owners[members])
            out[members[owners[members] > best[ids]]] = True
        join(at[valid & (number == number[-1])])
    settle()
    return out


def repeated(text: np.ndarray, owners: np.ndarray, starts: np.ndarray, length: int, folder: str | None = None, memory: int = 4 * BLOCK) -> np.ndarray:
    """The same for strings that begin at `starts`, with an owner for each."""
    with tempfile.TemporaryDirectory(dir=folder) as here:
        every = np.full(len(text), NOBODY)
        every[starts] = owners
        return repeated_places(text, every, length, here, memory)[starts]
