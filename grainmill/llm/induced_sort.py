"""External suffix sorting by recursive induction, in blocks.

Suffixes that start a rise after a fall (left-most S suffixes) are sorted first:
the substrings between them are ordered by induction and named by their hashes, and
the string of names is sorted by recursion. From their order all L suffixes are
induced in rising and then all S suffixes in falling order. An induction is a
priority queue of suffix tuples: the range of symbols is cut into windows, what
enters a window waits there, in order of entry, and goes to a file when memory is
full. A window of one symbol is taken block by block as it was entered; one of
several rare symbols is put in order at once, with what it induces within itself.
In the last induction tuples carry the common prefix with their neighbour, up to a
cap: a predecessor's is one more than the least among the suffixes processed since
its bucket was last entered. Text, places, names and orders are files that are
mapped, and memory holds blocks only.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np

from .polyhash import mix

#: Tuples of a queue in memory, those of a block, and the symbols' occurrences in a window.
IN_MEMORY, BLOCK, WINDOW = 400_000, 1 << 16, 1 << 12


class Store:
    """Rows of several integers by window, in order of entry; in files beyond a bound."""

    def __init__(self, folder: str, name: str, width: int, in_memory: int):
        self.path, self.width, self.in_memory = os.path.join(folder, f"{name}-{id(self)}"), width, in_memory
        self.held: dict[int, list[tuple]] = {}
        self.files: dict[int, int] = {}  # rows of a window's file
        self.n = 0

    def add(self, window: int, columns: tuple) -> None:
        self.held.setdefault(window, []).append(columns)
        self.n += len(columns[0])
        if self.n > self.in_memory:
            for w, blocks in self.held.items():
                rows = np.stack([np.concatenate(c) for c in zip(*blocks, strict=True)], axis=1).astype(np.int64)
                with open(f"{self.path}-{w}", "ab") as f:
                    f.write(rows.tobytes())
                self.files[w] = self.files.get(w, 0) + len(rows)
            self.held, self.n = {}, 0

    def deal(self, windows: np.ndarray, *columns: np.ndarray) -> None:
        """Add rows, each to its window, in order."""
        order = np.argsort(windows, kind="stable")
        windows, columns = windows[order], [c[order] for c in columns]
        cuts = np.flatnonzero(windows[1:] != windows[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(windows)], strict=True):
            if b > a:
                self.add(int(windows[a]), tuple(c[a:b] for c in columns))

    def __contains__(self, window: int) -> bool:
        return window in self.held or window in self.files

    def take(self, window: int, back: bool = False) -> Iterator[tuple]:
        """The rows of a window, which leave it, in blocks from the first entered or,
        each block too, from the last. What enters meanwhile stays."""
        blocks = self.held.pop(window, [])
        self.n -= sum(len(b[0]) for b in blocks)
        if n := self.files.pop(window, 0):
            os.rename(f"{self.path}-{window}", f"{self.path}-{window}-taken")
        if back:
            for block in blocks[::-1]:
                yield tuple(c[::-1] for c in block)
        if n:
            rows = np.memmap(f"{self.path}-{window}-taken", np.int64, "r", shape=(n, self.width))
            for a in range(0, n, BLOCK):
                part = rows[a : a + BLOCK] if not back else rows[max(0, n - a - BLOCK) : n - a][::-1]
                yield tuple(np.array(part[:, i]) for i in range(self.width))
            del rows
            os.unlink(f"{self.path}-{window}-taken")
        if not back and blocks:
            yield blocks[0] if len(blocks) == 1 else tuple(np.concatenate(c) for c in zip(*blocks, strict=True))

    def whole(self, window: int) -> tuple:
        blocks = list(self.take(window))
        return tuple(np.concatenate(c) for c in zip(*blocks, strict=True)) if blocks else (np.zeros(0, np.int64),) * self.width


def _array(folder: str, name: str, n: int, kind) -> np.memmap:
    """A new array in a file; `_drop` removes it."""
    path = os.path.join(folder, f"{name}-{len(os.listdir(folder))}-{n}")
    return np.memmap(path, kind, "w+", shape=(max(n, 1),))


def _drop(*arrays: np.memmap) -> None:
    for a in arrays:
        os.unlink(a.filename)


def left_most_s(text: np.ndarray, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Positions of the left-most S suffixes in blocks from the right, each rising. The
    last suffix is L."""
    n = len(text)
    rising, first_s = False, False  # the type right of the block, and of its first symbol
    for end in range(n, 0, -block):
        start = max(0, end - block)
        own = np.asarray(text[start:end]).astype(np.int64)
        following = np.append(own[1:], int(text[end]) if end < n else -1)
        step = np.sign(following - own)
        # equal symbols take the type to their right
        last = np.where(step != 0, np.arange(len(step)), len(step))
        last = np.minimum.accumulate(last[::-1])[::-1]
        types = np.append(step, 1 if rising else -1)[last] > 0
        found = np.flatnonzero(types[1:] & ~types[:-1]) + start + 1
        yield np.append(found, end) if end < n and not types[-1] and first_s else found
        rising = first_s = bool(types[0])


def _places(text: np.ndarray, folder: str) -> np.memmap | None:
    """All left-most S suffixes in rising order, as a file."""
    n = sum(len(x) for x in left_most_s(text))
    if not n:
        return None
    out, end = _array(folder, "places", n, np.int64), n
    for found in left_most_s(text):
        out[end - len(found) : end] = found
        end -= len(found)
    return out


class Windows:
    """Ranges of symbols that come up some WINDOW times, or one symbol alone; of bytes
    always one alone."""

    def __init__(self, text: np.ndarray):
        if text.dtype == np.uint8:
            self.bounds, self.numbers = np.arange(257), None
        else:
            counts = np.zeros(int(max(text[a : a + BLOCK].max() for a in range(0, len(text), BLOCK))) + 1, np.int64)
            for a in range(0, len(text), BLOCK):
                part = np.bincount(text[a : a + BLOCK])
                counts[: len(part)] += part
            group = (np.cumsum(counts) - 1) // WINDOW
            large = counts >= WINDOW
            cut = np.ones(len(counts), bool)
            cut[1:] = (group[1:] != group[:-1]) | large[1:] | large[:-1]
            self.bounds = np.append(np.flatnonzero(cut), len(counts))
            self.numbers = (np.cumsum(cut) - 1).astype(np.int32)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, symbols: np.ndarray) -> np.ndarray:
        return symbols.astype(np.int64) if self.numbers is None else self.numbers[symbols]


def _pass(text: np.ndarray, windows: Windows, given, sign: int, folder: str, in_memory: int) -> Iterator[tuple]:
    """An induction from left to right of the symbols (sign 1: the given are left-most S
    suffixes, L suffixes are induced) or from right to left (-1: the given are L). Yields
    (window, suffixes in order, which are given). given(window): blocks in their order."""
    queue = Store(folder, "queue", 1, in_memory)

    def induce(at: np.ndarray, known: np.ndarray, low: int = 0, high: int = 0) -> None:
        """Enter predecessors, but for those in the window itself, into theirs."""
        before = at - 1
        held = before >= 0
        before, known = before[held], known[held]
        symbol = text[before].astype(np.int64)
        step = sign * (symbol - text[before + 1].astype(np.int64))
        good = (step > 0) | (step == 0) & ~known
        good &= (symbol < low) | (symbol >= high)
        queue.deal(windows.of(symbol[good]), before[good])

    if sign > 0:
        queue.deal(windows.of(text[-1:]), np.array([len(text) - 1]))
    for w in range(len(windows))[::sign]:
        low, high = int(windows.bounds[w]), int(windows.bounds[w + 1])
        if high - low == 1:
            while w in queue:
                for (at,) in queue.take(w):
                    known = np.zeros(len(at), bool)
                    yield w, at, known
                    induce(at, known)
            for (at,) in given(w):
                known = np.ones(len(at), bool)
                yield w, at, known
                induce(at, known)
        else:
            seeds = [x for (x,) in given(w)]
            at, known = _ordered(text, queue.whole(w)[0], np.concatenate([np.zeros(0, np.int64), *seeds]), sign, low, high)
            if len(at):
                yield w, at, known
                induce(at, known, low, high)


def _ordered(text, own: np.ndarray, seeds: np.ndarray, sign: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a window in order: of a symbol first those that entered before,
    then those that the window induces, then the given. The few induced are entered one
    by one as their successors' turn comes."""
    at = np.concatenate((own, seeds)).astype(np.int64)
    kind = np.repeat([0, 2], [len(own), len(seeds)])
    number = np.concatenate((np.arange(len(own)), np.arange(len(seeds))))
    symbol = text[at].astype(np.int64)
    before = text[np.maximum(at - 1, 0)].astype(np.int64)
    step = sign * (before - symbol)
    inner = (at > 0) & ((step > 0) | (step == 0) & (kind == 0)) & (before >= low) & (before < high)
    if inner.any():
        heap = list(zip((sign * symbol[inner]).tolist(), kind[inner].tolist(), number[inner].tolist(), at[inner].tolist(), strict=True))
        heapq.heapify(heap)
        new = []
        while heap:
            *_, i = heapq.heappop(heap)
            c = int(text[i - 1])
            new.append((i - 1, c, len(new)))
            if i > 1 and low <= (b := int(text[i - 2])) < high and sign * (b - c) >= 0:
                heapq.heappush(heap, (sign * c, 1, len(new) - 1, i - 1))
        more = np.array(new, np.int64)
        at, symbol, number = (np.concatenate((x, y)) for x, y in ((at, more[:, 0]), (symbol, more[:, 1]), (number, more[:, 2])))
        kind = np.concatenate((kind, np.ones(len(more), np.int64)))
    order = np.lexsort((number, kind, sign * symbol))
    return at[order], kind[order] == 2


def _falling(text: np.ndarray, windows: Windows, seeds: Store, folder: str, in_memory: int) -> Iterator[tuple]:
    """(suffixes, which are L) in falling order, from left-most S suffixes in their order."""
    falls = Store(folder, "l", 1, in_memory)
    for w, at, known in _pass(text, windows, seeds.take, 1, folder, in_memory):
        if not known.all():
            falls.add(w, (at[~known],))
    for _, at, known in _pass(text, windows, lambda w: falls.take(w, back=True), -1, folder, in_memory):
        yield at, known


@cache
def _powers(n: int, seed: int) -> np.ndarray:
    powers = np.full(n, np.random.default_rng(seed).integers(2**40, 2**61, dtype=np.uint64) * np.uint64(8) + np.uint64(5))
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _substring_hashes(text: np.ndarray, places: np.ndarray, folder: str) -> tuple[np.memmap, np.memmap]:
    """Two hashes of the substring from each place through the next one's first symbol;
    the last's are of its place, as no other is equal."""
    out = tuple(_array(folder, f"hashes{lane}", len(places), np.uint64) for lane in (0, 1))
    a = 0
    while a < len(places) - 1:
        b = min(len(places) - 1, a + BLOCK)
        while b > a + 1 and places[b] - places[a] > 16 * BLOCK:
            b = (a + b) // 2
        start, stop = np.asarray(places[a:b]), np.asarray(places[a + 1 : b + 1])
        own = np.asarray(text[start[0] : stop[-1]]).astype(np.uint64)
        into = np.arange(len(own)) - np.repeat(start - start[0], stop - start)
        for lane in (0, 1):
            value = mix(own * np.uint64(2) + np.uint64(lane * 0x51ED27 + 1))
            size = 1 << int(into.max() + 1).bit_length()
            sums = np.add.reduceat(value * _powers(max(size, 1024), 61 + lane)[into], start - start[0])
            out[lane][a:b] = mix(sums + mix(text[stop].astype(np.uint64) * np.uint64(3) + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        a = b
    for lane in (0, 1):
        out[lane][-1] = mix(np.array([len(text), lane], np.uint64))[lane]
    return out


def _sorted_places(text: np.ndarray, windows: Windows, places: np.ndarray, folder: str, in_memory: int) -> Iterator[np.ndarray]:
    """The left-most S suffixes in falling order, as blocks of their numbers."""
    n = len(places)
    rough = Store(folder, "rough", 1, in_memory)
    for a in range(0, n, BLOCK):
        at = np.asarray(places[a : a + BLOCK])
        rough.deal(windows.of(text[at]), at)
    hashes, names = _substring_hashes(text, places, folder), _array(folder, "names", n, np.uint32)
    name, previous = n, None
    for at, is_l in _falling(text, windows, rough, folder, in_memory):
        at = at[~is_l]
        k = np.minimum(np.searchsorted(places, at), n - 1)
        k = k[places[k] == at]
        if len(k):
            own = [h[k] for h in hashes]
            new = np.ones(len(k), bool)
            new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])
            new[0] = previous != (own[0][0], own[1][0])
            falls = np.cumsum(new)
            names[k] = (name - falls).astype(np.uint32)
            name, previous = name - int(falls[-1]), (own[0][-1], own[1][-1])
    _drop(*hashes)
    for a in range(0, n, BLOCK):
        names[a : a + BLOCK] -= np.uint32(name)
    if name:  # some names repeat
        yield from _numbers(np.asarray(names), folder, in_memory)
    else:
        order = _array(folder, "order", n, np.int64)
        for a in range(0, n, BLOCK):
            order[n - 1 - names[a : a + BLOCK].astype(np.int64)] = np.arange(a, min(a + BLOCK, n))
        for a in range(0, n, BLOCK):
            yield np.array(order[a : a + BLOCK])
        _drop(order)
    _drop(names)


def _numbers(text: np.ndarray, folder: str, in_memory: int) -> Iterator[np.ndarray]:
    """All suffixes of a string of names in falling order, in blocks."""
    windows = Windows(text)
    seeds = _seeds(text, windows, folder, in_memory)
    for at, _ in _falling(text, windows, seeds, folder, in_memory):
        yield at


def _seeds(text: np.ndarray, windows: Windows, folder: str, in_memory: int) -> Store:
    """The left-most S suffixes in rising order, by window."""
    seeds = Store(folder, "seeds", 1, in_memory)
    places = _places(text, folder)
    if places is not None:
        falling = Store(folder, "order", 1, in_memory)
        for k in _sorted_places(text, windows, places, folder, in_memory):
            falling.add(0, (np.asarray(places[k]),))
        for (at,) in falling.take(0, back=True):
            seeds.deal(windows.of(text[at]), at)
        _drop(places)
    return seeds


class _Buckets:
    """A priority queue by first symbol of suffixes with their common prefixes: what
    enters a bucket comes out in order of entry, each suffix with its common prefix
    with the one that entered before it."""

    def __init__(self, folder: str, in_memory: int):
        self.queue = Store(folder, "buckets", 2, in_memory)
        self.least = np.zeros(256, np.uint8)  # since a bucket was last entered
        self.entered = np.zeros(256, bool)

    def process(self, shared: np.ndarray, induces: np.ndarray, at: np.ndarray, symbols: np.ndarray, cap: int) -> None:
        """A block of suffixes was processed, with these common prefixes to the one
        before; those at `induces` put suffix `at` in the bucket of its symbol."""
        order = np.argsort(symbols, kind="stable")
        rows, at, symbols = induces[order], at[order], symbols[order]
        low = np.minimum.accumulate(shared)
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1][1:], 255).astype(np.uint8)
        new = np.ones(len(rows), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        starts = np.flatnonzero(new)
        own = symbols[starts]
        between = np.zeros(len(rows), np.uint8)
        if len(rows):
            between[1:] = _range_minima(shared, rows[:-1] + 1, rows[1:] + 1, ~new[1:])
            between[starts] = np.where(self.entered[own], np.minimum(self.least[own], low[rows[starts]]), 255)
        value = np.where(between == 255, 0, np.minimum(between.astype(np.int16) + 1, cap)).astype(np.uint8)
        self.least = np.minimum(self.least, low[-1])
        ends = np.append(starts[1:], len(rows)) - 1 if len(starts) else starts
        self.least[own] = after[rows[ends]]
        self.entered[own] = True
        for c, a, b in zip(own.tolist(), starts.tolist(), (ends + 1).tolist(), strict=True):
            self.queue.add(c, (at[a:b], value[a:b]))


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least of values[start:stop] for each wanted pair, by minima over powers of two."""
    out = np.zeros(len(start), np.uint8)
    which = np.flatnonzero(wanted)
    if not len(which):
        return out
    lo, hi = start[which], stop[which]
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table, k = values, 0
    top = level.max()
    while True:
        of = level == k
        if of.any():
            out[which[of]] = np.minimum(table[lo[of]], table[hi[of] - (1 << k)])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, block: int = 1 << 14) -> np.ndarray:
    """Common prefixes, up to cap, of suffixes a and b."""
    out = np.zeros(len(a), np.uint8)
    n, span = len(text), np.arange(cap)
    for i in range(0, len(a), block):
        x, y = a[i : i + block], b[i : i + block]
        differ = text[np.minimum(x[:, None] + span, n - 1)] != text[np.minimum(y[:, None] + span, n - 1)]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), cap)
        out[i : i + block] = np.minimum(first, n - np.maximum(x, y))
    return out


def suffix_blocks(path: str, folder: str, cap: int, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of the bytes in a file in falling order, in blocks, each with the
    length, up to cap (below 255), of its common prefix with the one before."""
    n = os.path.getsize(path)
    if not n:
        return
    text = np.asarray(np.memmap(path, np.uint8, "r"))  # mapped still, indexed faster
    windows = Windows(text)
    seeds = _seeds(text, windows, folder, in_memory)

    def induce(queue: _Buckets, at: np.ndarray, shared: np.ndarray, sign: int, known: bool) -> None:
        before = at - 1
        symbol = text[np.maximum(before, 0)]
        step = sign * (symbol.astype(np.int16) - text[at])
        go = np.flatnonzero((at > 0) & ((step > 0) | (step == 0) & (not known)))
        queue.process(shared, go, before[go], symbol[go], cap)

    def follow(at: np.ndarray, last: int) -> int:
        return int(_common(text, np.array([last]), at[:1], cap)[0]) if last >= 0 else 0

    buckets, falls = _Buckets(folder, in_memory), Store(folder, "falls", 2, in_memory)
    buckets.queue.add(int(text[-1]), (np.array([n - 1]), np.zeros(1, np.uint8)))
    buckets.entered[text[-1]] = True
    for c in range(256):
        last = -1
        while c in buckets.queue:
            for at, shared in buckets.queue.take(c):
                shared = shared.astype(np.uint8)
                if last < 0:
                    shared[0] = 0
                falls.add(c, (at, shared))
                last = int(at[-1])
                induce(buckets, at, shared, 1, False)
        for (at,) in seeds.take(c):
            shared = np.append(np.uint8(follow(at, last)), _common(text, at[:-1], at[1:], cap))
            last = int(at[-1])
            induce(buckets, at, shared, 1, True)
    buckets = _Buckets(folder, in_memory)
    for c in range(255, -1, -1):
        last = -1
        while c in buckets.queue:
            for at, shared in buckets.queue.take(c):
                shared = shared.astype(np.uint8)
                if last < 0:
                    shared[0] = 0
                yield at, shared
                last = int(at[-1])
                induce(buckets, at, shared, -1, False)
        carried = None
        for at, below in falls.take(c, back=True):
            below = below.astype(np.uint8)
            shared = np.append(np.uint8(follow(at, last) if carried is None else carried), below[:-1])
            carried, last = below[-1], int(at[-1])
            yield at, shared
            induce(buckets, at, shared, -1, True)
