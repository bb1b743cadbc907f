"""External induced sorting of suffixes, with common-prefix values.

Suffixes that are smaller than their successor and follow one that is larger (S* suffixes) are sorted first: their substrings up
to the next S* position get names, and the string of names is sorted by recursion (by doubling once it fits the given
limit, or if it has many different names). S* positions and their names lie in memory: about 20 bytes for each byte of text. From them the larger (L) suffixes are induced by rising and the smaller (S) ones by falling first symbol. The queue
of the induction is a priority queue by symbol, first in first out within a symbol: a symbol's suffixes are taken out,
and each puts the suffix before it back under that suffix's symbol, in batches. Queue and sorted suffixes go to
files when they pass the limit. Each entry carries its common prefix with the one put before it under the same
symbol: one more than the least common prefix among the suffixes taken out in between.

Order and common prefixes are exact up to `cap` symbols; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Suffixes handled at once.
BATCH = 1 << 18
#: Different names up to which their string is sorted by recursion; with more, induction would handle a few suffixes at a time.
SYMBOLS = 1024


class Log:
    """Positions and common prefixes by symbol, in the order in which they came; beyond the limit in files, one for each time that memory was full."""

    def __init__(self, folder: str, name: str, limit: int):
        self.folder, self.name, self.limit, self.held, self.files = folder, name, limit, 0, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        #: By symbol, where its entries lie: file, first byte, entries.
        self.written: dict[int, list[tuple[str, int, int]]] = {}
        #: Symbols that each file still holds.
        self.left: dict[str, int] = {}

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        path = os.path.join(self.folder, f"{self.name}-{self.files}")
        self.files += 1
        self.left[path] = len(self.parts)
        with open(path, "wb") as f:
            for symbol, parts in self.parts.items():
                n = sum(len(p) for p, _ in parts)
                self.written.setdefault(symbol, []).append((path, f.tell(), n))
                for column in zip(*parts):
                    f.write(b"".join(x.tobytes() for x in column))
                self.kind = parts[0][0].dtype
        self.parts, self.held = {}, 0

    def _read(self, path: str, at: int, n: int, remove: bool):
        with open(path, "rb") as f:
            f.seek(at)
            found = np.fromfile(f, self.kind, n), np.fromfile(f, np.uint8, n)
        if remove:
            self.left[path] -= 1
            if not self.left[path]:
                os.unlink(path)
        return found

    def take(self, symbol: int):
        """The entries put under the symbol so far, which leave the log."""
        files, parts = self.written.pop(symbol, []), self.parts.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in parts)
        yield from _joined([*(lambda w=w: self._read(*w, True) for w in files), *parts])

    def backwards(self, symbol: int):
        """The entries of the symbol from the last to the first; each part's order is the caller's to turn."""
        yield from reversed(list(_joined(self.parts.get(symbol, []))))
        files = self.written.get(symbol, [])
        end = len(files)
        while end:
            start, size = end, 0
            while start and (size == 0 or size + files[start - 1][2] <= BATCH):
                start -= 1
                size += files[start][2]
            yield tuple(map(np.concatenate, zip(*(self._read(*w, False) for w in files[start:end]))))
            end = start


def _joined(parts):
    """The parts, or what gives them, small ones put together."""
    held, size = [], 0
    for part in parts:
        part = part() if callable(part) else part
        held.append(part)
        size += len(part[0])
        if size >= BATCH:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _range_minima(values: np.ndarray):
    """low, high (inclusive) -> the least of values between them, by a table of powers of two."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    size = len(values)
    table = np.zeros((len(levels), size), np.uint8)
    for i, level in enumerate(levels):
        table[i, : len(level)] = level

    def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(table[k, low], table[k, high - (1 << k.astype(np.int64)) + 1])

    return least


class Inducer:
    """One direction of the induction: takes batches of sorted suffixes and puts the suffixes before them."""

    def __init__(self, text: np.ndarray, queue: Log, cap: int, rising: bool):
        self.text, self.queue, self.cap, self.rising = text, queue, cap, rising
        #: By symbol, the least common prefix since its last entry.
        self.since: dict[int, int] = {}
        #: By symbol, the batch of that entry; and falling minima of the batches so far, so that a batch needn't touch every symbol.
        self.marks: dict[int, int] = {}
        self.stack: list[tuple[int, int]] = []
        self.clock = 0

    def feed(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray, equal: bool) -> None:
        """equal: suffixes before that start with the same symbol belong to this direction too."""
        for at in range(0, len(positions), BATCH):
            self._feed(symbol, positions[at : at + BATCH], prefixes[at : at + BATCH], equal)

    def _feed(self, symbol, positions, prefixes, equal):
        before = positions - 1
        there = np.asarray(self.text[np.maximum(before, 0)]).astype(np.int64)
        goes = (before >= 0) & ((there > symbol if self.rising else there < symbol) | (equal & (there == symbol)))
        index = np.flatnonzero(goes)
        lowest = int(prefixes.min())
        if not len(index):
            self._pass(lowest)
            return
        to = there[index]
        # Stable sorts of small integers are radix sorts.
        order = np.argsort(to.astype(np.uint8) if self.text.dtype == np.uint8 else to, kind="stable")
        index, to = index[order], to[order]
        least = _range_minima(prefixes)
        first = np.concatenate([[True], to[1:] != to[:-1]])
        starts = np.flatnonzero(first)
        low = np.concatenate([[0], index[:-1] + 1])
        low[starts] = 0
        got = least(low, index).astype(np.int64)
        symbols = to[starts].tolist()
        for s, x in zip(starts.tolist(), symbols):
            got[s] = min(int(got[s]), self._since(x)) if x in self.since else -1
        got = np.minimum(got + 1, self.cap).astype(np.uint8)
        ends = np.concatenate([starts[1:], [len(index)]]).tolist()
        last = index[np.array(ends) - 1]
        after = np.where(last + 1 < len(prefixes), least(np.minimum(last + 1, len(prefixes) - 1), np.full(len(last), len(prefixes) - 1)), self.cap).tolist()
        self._pass(lowest)
        for s, e, x, rest in zip(starts.tolist(), ends, symbols, after):
            self.queue.put(x, before[index[s:e]], got[s:e])
            self.since[x] = int(rest)
            self.marks[x] = self.clock

    def _pass(self, lowest: int) -> None:
        self.clock += 1
        while self.stack and self.stack[-1][1] >= lowest:
            self.stack.pop()
        self.stack.append((self.clock, lowest))

    def _since(self, symbol: int) -> int:
        """Least common prefix from the symbol's last entry up to the end of the last batch."""
        mark, low = self.marks[symbol], self.since[symbol]
        a, b = 0, len(self.stack)
        while a < b:
            mid = (a + b) // 2
            if self.stack[mid][0] > mark:
                b = mid
            else:
                a = mid + 1
        return min(low, self.stack[a][1]) if a < len(self.stack) else low


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Of each position, whether its suffix is smaller than the next one (the last one is not)."""
    n = len(text)
    out = np.zeros(n, bool)
    later = False
    for end in range(n, 0, -BATCH * 8):
        start = max(0, end - BATCH * 8)
        here = np.asarray(text[start : min(end + 1, n)]).astype(np.int64)
        step = np.diff(here)
        if len(here) == end - start:  # the last suffix has no next
            step = np.append(step, -1)
        places = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(places[::-1])[::-1]
        known = nearest < len(step)
        out[start:end] = np.where(known, step[np.minimum(nearest, len(step) - 1)] > 0, later)
        later = bool(out[start])
    return out


def _names(text: np.ndarray, stars: np.ndarray, pad: int) -> tuple[np.ndarray, int]:
    """Names of the S* substrings, equal for equal ones and in their order. A substring that is a prefix of another is the larger of both."""
    n = len(stars)
    lengths = np.append(np.diff(stars) + 1, len(text) - stars[-1])
    small = text.dtype == np.uint8
    width = 8 if small else 1
    group = np.zeros(n, np.int64)
    todo, at = np.arange(n), 0
    while len(todo):
        key = np.zeros(len(todo), np.uint64)
        for k in range(width):
            inside = at + k < lengths[todo]
            symbol = np.where(inside, np.asarray(text[np.minimum(stars[todo] + at + k, len(text) - 1)]).astype(np.uint64), np.uint64(pad))
            key = symbol if width == 1 else (key << np.uint64(8)) | symbol
        order = np.lexsort((key, group[todo])) if at else np.argsort(key)
        g, key = group[todo][order], key[order]
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_group | np.concatenate([[True], key[1:] != key[:-1]])
        # A group keeps room for all its members, so names of other groups stay as they are.
        index = np.arange(len(todo))
        rank = index - np.maximum.accumulate(np.where(new_group, index, 0))
        group[todo[order]] = g + rank[np.maximum.accumulate(np.where(new, index, 0))]
        at += width
        # Those that are still tied and whose end has not been compared.
        _, inverse, count = np.unique(group[todo], return_inverse=True, return_counts=True)
        todo = todo[(count[inverse] > 1) & (lengths[todo] >= at)]
    value, names = np.unique(group, return_inverse=True)
    return names.astype(np.int64), len(value)


def _in_memory(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling, to `depth` names at least."""
    n = len(names)
    rank, step = names.astype(np.int64) + 1, 1
    while True:
        following = np.zeros(n, np.int64)
        if step < n:
            following[:-step] = rank[step:]
        key = rank * (n + 2) + following
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if step >= depth or rank[order[-1]] == n:
            return order


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, copied: bool) -> np.ndarray:
    """Common prefixes, up to cap, of the suffixes at a and b; by words of 8 bytes where the text may be copied to memory."""
    out = np.zeros(len(a), np.int64)
    n = len(text)
    wide = text.dtype == np.uint8
    width = 8 if wide else 1
    if wide:
        data = np.concatenate([np.asarray(text), np.zeros(8, np.uint8)]) if copied else None
    todo = np.arange(len(a))
    at = 0
    while len(todo) and at < cap:
        x, y = a[todo] + at, b[todo] + at
        if wide and data is not None:
            words = np.ndarray(shape=n + 1, dtype="<u8", buffer=data, strides=(1,))
            different = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
            # The lowest byte that differs.
            lowest = different & (~different + np.uint64(1))
            same = np.where(different == 0, 8, (np.log2(np.maximum(lowest, 1).astype(np.float64)) // 8).astype(np.int64))
        else:
            same, going = np.zeros(len(todo), np.int64), np.ones(len(todo), bool)
            for k in range(width):
                going &= (x + k < n) & (y + k < n) & (np.asarray(text[np.minimum(x + k, n - 1)]) == np.asarray(text[np.minimum(y + k, n - 1)]))
                same += going
        same = np.minimum(same, np.minimum(n - np.maximum(x, y), width).clip(0))
        out[todo] += same
        todo = todo[same == width]
        at += width
    return np.minimum(out, cap).astype(np.uint8)


def sort_stars(text: np.ndarray, stars: np.ndarray, cap: int, limit: int, folder: str, pad: int) -> np.ndarray:
    """Order of the S* suffixes: names of their substrings, then the string of names by recursion."""
    if len(stars) < 2:
        return np.arange(len(stars))
    names, kinds = _names(text, stars, pad)
    if kinds == len(stars):
        order = np.empty(len(stars), np.int64)
        order[names] = np.arange(len(stars))
        return order
    depth = cap // 2 + 2  # an S* position is two symbols or more after another
    if len(names) <= limit or kinds > SYMBOLS:
        return _in_memory(names, depth)
    with tempfile.TemporaryDirectory(dir=folder) as inner:
        lower = np.append(names + 1, 0)
        order = np.concatenate([p for p, _ in sorted_suffixes(lower, min(depth, 255), limit, inner)])
        return order[order < len(names)]


def sorted_suffixes(text: np.ndarray, cap: int = 200, limit: int = 1 << 24, folder: str | None = None):
    """Batches (positions, common prefix with the suffix before) of all suffixes in rising order.

    text: unsigned bytes below 255, or integers; the last symbol must be the least one. limit: most entries in memory of each of the queue,
    the log and the string of names.
    """
    n = len(text)
    if not n:
        return
    kind = np.int32 if n < 1 << 31 else np.int64
    with tempfile.TemporaryDirectory(dir=folder) as here:
        smaller = smaller_types(text)
        stars = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(kind)
        del smaller
        order = sort_stars(text, stars, cap, limit, here, 255 if text.dtype == np.uint8 else int(text.max()) + 1)
        stars = stars[order]
        star_prefix = np.zeros(len(stars), np.uint8)
        if len(stars) > 1:
            star_prefix[1:] = _prefixes(text, stars[:-1], stars[1:], cap, n <= limit)
        heads = np.asarray(text[stars]).astype(np.int64)
        symbols = np.unique(text).astype(np.int64)
        bounds = dict(zip(symbols.tolist(), zip(np.searchsorted(heads, symbols).tolist(), np.searchsorted(heads, symbols, "right").tolist())))

        def run(position: int, symbol: int) -> int:
            length = 1
            while length < cap and position + length < n and int(text[position + length]) == symbol:
                length += 1
            return length

        queue, large = Log(here, "l", limit), Log(here, "large", limit)
        rising = Inducer(text, queue, cap, True)
        queue.put(int(text[n - 1]), np.array([n - 1], kind), np.zeros(1, np.uint8))
        rising._pass(cap)
        rising.since[int(text[n - 1])], rising.marks[int(text[n - 1])] = 0, rising.clock
        ends: dict[int, int] = {}  # the last L suffix of each symbol
        for symbol in symbols.tolist():
            started = False
            while True:
                moved = False
                for positions, prefixes in queue.take(symbol):
                    moved = True
                    if not started:
                        prefixes = prefixes.copy()
                        prefixes[0] = 0
                        started = True
                    large.put(symbol, positions, prefixes)
                    ends[symbol] = int(positions[-1])
                    rising.feed(symbol, positions, prefixes, True)
                if not moved:
                    break
            a, b = bounds[symbol]
            if b > a:
                prefixes = star_prefix[a:b].copy()
                prefixes[0] = min(run(ends[symbol], symbol), run(int(stars[a]), symbol)) if symbol in ends else 0
                rising.feed(symbol, stars[a:b], prefixes, False)
        del stars, star_prefix, heads

        queue, small = Log(here, "s", limit), Log(here, "small", limit)
        falling = Inducer(text, queue, cap, False)
        falling._pass(cap)
        last: dict[int, int] = {}
        for symbol in symbols[::-1].tolist():
            started = False
            while True:
                moved = False
                for positions, prefixes in queue.take(symbol):
                    moved = True
                    if not started:
                        prefixes = prefixes.copy()
                        prefixes[0] = 0
                        started = True
                    small.put(symbol, positions, prefixes)
                    last[symbol] = int(positions[-1])
                    falling.feed(symbol, positions, prefixes, True)
                if not moved:
                    break
            # The L suffixes from the largest down; a common prefix now is that with the larger one.
            border = min(run(ends[symbol], symbol), run(last[symbol], symbol)) if symbol in last and symbol in ends else 0
            for positions, prefixes in large.backwards(symbol):
                turned = np.empty_like(prefixes)
                turned[0], turned[1:] = border, prefixes[:0:-1]
                border = int(prefixes[0])
                falling.feed(symbol, positions[::-1], turned, False)

        for symbol in symbols.tolist():
            for positions, prefixes in large.take(symbol):
                yield positions, prefixes
            # Small ones were put from the largest down, each with its common prefix with the larger one.
            border = min(run(ends[symbol], symbol), run(last[symbol], symbol)) if symbol in last and symbol in ends else 0
            for positions, prefixes in small.backwards(symbol):
                turned = np.empty_like(prefixes)
                turned[0], turned[1:] = border, prefixes[:0:-1]
                border = int(prefixes[0])
                yield positions[::-1], turned
