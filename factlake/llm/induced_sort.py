"""External induced sorting of suffixes, with common-prefix values.

Suffixes are sorted by induction: those that begin a rising run after a
falling one (here "minima") are sorted first, by naming the substrings between
them and sorting the string of names recursively; one scan upwards then
induces the order of all suffixes that fall (L), and one scan downwards that of
all that rise (S). A scan takes suffixes in order from a priority queue and
puts each one's predecessor back into it.

The queue is disk-backed: it is keyed by first symbol, in ranges of symbols,
and within a symbol first come, first served, which is the order of the
inducing suffixes. Each range is a tape that is held in memory up to a budget for
all of them and spilled to a file beyond; only the range being scanned is
loaded, in blocks where it is of one symbol. Texts and position lists beyond
the budget are memory-mapped files. All files are unlinked when they are made,
so nothing is left behind even by a worker that is killed.

Over bytes, entries also carry the length of the prefix that a suffix shares
with the one before it in the queue, at most ``cap``: one more than the smallest
value met since that one was induced. The scan downwards thus hands out every
suffix in order with its common-prefix value.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

BLOCK = 1 << 14
#: Ranges of symbols, where symbols are names.
RANGES = 32
BUDGET = 128 << 20


class Disk:
    """Spill space of one sort: a file that has no name, and a memory budget."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.held, self.spilled = budget, 0, 0
        self.tapes: list[Tape] = []
        self.file = None

    def put(self, raw: bytes) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(raw)
        self.spilled += len(raw)
        return at, len(raw)

    def get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def grew(self, n: int) -> None:
        self.held += n
        if self.held > self.budget:
            for t in self.tapes:
                t.spill()
            self.held = 0

    def array(self, n: int, dtype) -> np.ndarray:
        """An array, on disk where it is larger than the budget."""
        if n * np.dtype(dtype).itemsize <= self.budget or n == 0:
            return np.zeros(n, dtype)
        f = tempfile.TemporaryFile()
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Tape:
    """Append-only rows of some columns, read in order once or more."""

    def __init__(self, disk: Disk, dtypes: tuple):
        self.disk, self.dtypes = disk, dtypes
        self.old: list[tuple[int, list[tuple[int, int]]]] = []  # rows, their columns' places on disk
        self.new: list[tuple[np.ndarray, ...]] = []
        disk.tapes.append(self)

    def append(self, *cols: np.ndarray) -> None:
        if len(cols[0]):
            own = tuple(np.array(c, d) for c, d in zip(cols, self.dtypes, strict=True))
            self.new.append(own)
            self.disk.grew(sum(c.nbytes for c in own))

    def spill(self) -> None:
        if self.new:
            cols = [np.concatenate(c) for c in zip(*self.new, strict=True)]
            self.new = []
            self.old.append((len(cols[0]), [self.disk.put(c.tobytes()) for c in cols]))

    def _pieces(self, back: bool):
        k = 0
        if back:
            old, new = list(self.old), list(self.new)  # it may be spilled meanwhile
            yield from reversed(new)
            for _, places in reversed(old):
                yield tuple(np.frombuffer(self.disk.get(*p), d) for p, d in zip(places, self.dtypes, strict=True))
            return
        while True:  # the tape may grow, and be spilled, while it is read
            if k < len(self.old):
                yield tuple(np.frombuffer(self.disk.get(*p), d) for p, d in zip(self.old[k][1], self.dtypes, strict=True))
                k += 1
            elif self.new:
                cols = tuple(np.concatenate(c) for c in zip(*self.new, strict=True))
                self.new = []
                # what has been read is not read again: an empty place marks it
                self.old.append((len(cols[0]), []))
                k += 1
                yield cols
            else:
                return

    def drain(self):
        """Blocks in order, until the tape is empty, also of what is added meanwhile."""
        for cols in self._pieces(False):
            for at in range(0, len(cols[0]), BLOCK):
                yield tuple(c[at: at + BLOCK] for c in cols)

    def backwards(self):
        """Blocks of rows in reverse order."""
        for cols in self._pieces(True):
            for at in range(len(cols[0]), 0, -BLOCK):
                yield tuple(c[max(0, at - BLOCK): at][::-1] for c in cols)

    def all(self) -> tuple[np.ndarray, ...]:
        got = list(self.drain())
        if not got:
            return tuple(np.zeros(0, d) for d in self.dtypes)
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    def close(self) -> None:
        self.disk.tapes.remove(self)


def minima(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Positions of the minima in order: the suffix there is smaller than the
    next one, and follows a larger symbol. The last symbol is the sentinel."""
    rises = True  # of the position right of the block
    n = len(text)
    # filled from the back; of two neighbours one is a minimum at most
    out = disk.array(n // 2 + 1, np.int64)
    filled = len(out)
    for hi in range(n, 0, -BLOCK * 16):
        lo = max(0, hi - BLOCK * 16)
        a = text[lo: min(hi + 1, n)].astype(np.int64)
        d = np.sign(np.diff(a))  # 1: rises to the next
        if hi == n:
            d = np.append(d, 1)
        # an equal symbol takes the direction of the next different one
        at = np.where(d != 0, np.arange(len(d)), len(d))
        at = np.minimum.accumulate(at[::-1])[::-1]
        up = np.where(at < len(d), d[np.minimum(at, len(d) - 1)] > 0, rises)
        before = text[max(lo - 1, 0): hi - 1].astype(np.int64) if lo else np.concatenate(([-1], text[: hi - 1])).astype(np.int64)
        found = np.flatnonzero(up & (before > a[: hi - lo])) + lo
        out[filled - len(found): filled] = found
        filled -= len(found)
        rises = bool(up[0])
    return out[filled:]


class Scan:
    """One scan: upwards over L, or downwards (``down``) over S. Symbols are
    turned round for the latter, so both go through rising keys."""

    def __init__(self, text: np.ndarray, size: int, down: bool, disk: Disk, cap: int = 0):
        self.text, self.down, self.disk, self.cap = text, down, disk, cap
        self.top = size - 1
        self.step = 1 if size <= 256 else max(1, -(-size // RANGES))
        self.n_ranges = -(-size // self.step)
        dtypes = (np.int64, np.int32) if cap else (np.int64,)
        self.queue = [Tape(disk, dtypes) for _ in range(self.n_ranges)]
        self.carry = np.full(self.n_ranges, -1, np.int64)

    def symbols(self, at: np.ndarray) -> np.ndarray:
        s = self.text[at].astype(np.int64)
        return self.top - s if self.down else s

    def induced(self, pos: np.ndarray, own: np.ndarray, seed: bool | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries have a predecessor of the kind that is scanned, and its symbol."""
        before = self.symbols(np.maximum(pos - 1, 0))
        ok = (pos > 0) & np.where(seed, before > own, before >= own)
        return ok, before

    def push(self, pos: np.ndarray, ok: np.ndarray, symbol: np.ndarray, lcp: np.ndarray | None, only: int | None = None) -> None:
        """Put the predecessors of a block into the queue."""
        k = np.flatnonzero(ok)
        where = symbol[k] // self.step
        order = _by_range(where)
        k, where = k[order], where[order]
        if lcp is not None:
            self._push_lcp(pos, k, where, lcp)
            return
        self._deal(where, (pos[k] - 1,))

    def _deal(self, where: np.ndarray, cols: tuple[np.ndarray, ...]) -> None:
        """Append rows that are sorted by range; the tapes share the columns."""
        if not len(where):
            return
        cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
        queue = self.queue
        for a, b, w in zip(cuts, cuts[1:], where[cuts[:-1]].tolist()):  # noqa: B905  one more cut than ranges
            queue[w].new.append(tuple(c[a:b] for c in cols))
        self.disk.grew(sum(c.nbytes for c in cols))

    def _push_lcp(self, pos: np.ndarray, k: np.ndarray, where: np.ndarray, lcp: np.ndarray) -> None:
        if len(k):
            first = np.concatenate(([True], where[1:] != where[:-1]))
            start = np.where(first, 0, np.concatenate(([0], k[:-1] + 1)))
            spans = np.empty(2 * len(k), np.int64)
            spans[::2], spans[1::2] = start, k + 1
            low = np.minimum.reduceat(np.append(lcp, 0), spans)[::2]
            low = np.where(first, np.minimum(low, self.carry[where]), low)
            value = np.minimum(low + 1, self.cap).astype(np.int32)
        least = lcp.min()
        self.carry = np.minimum(self.carry, least)
        if len(k):
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], 1 << 30)
            last = np.append(np.flatnonzero(first)[1:] - 1, len(k) - 1)
            self.carry[where[last]] = rest[k[last] + 1]
            self._deal(where, (pos[k] - 1, value))

    def run(self, seeds: Callable, give: Callable) -> None:
        """``seeds(r)`` yields blocks (positions[, lcp]) of range r in the order of
        the scan; ``give(positions, lcp, seed)`` gets every block scanned."""
        for r in range(self.n_ranges):
            if self.step == 1:
                self._one_symbol(r, seeds, give)
            else:
                self._many_symbols(r, seeds, give)
            self.queue[r].close()

    def _one_symbol(self, r: int, seeds: Callable, give: Callable) -> None:
        last = None
        for cols in self.queue[r].drain():
            pos, lcp = cols[0], cols[1] if self.cap else None
            ok, symbol = self.induced(pos, r, False)
            give(r, pos, lcp, False)
            self.push(pos, ok, symbol, lcp)
            last = pos[-1]
        for k, cols in enumerate(seeds(r)):
            pos, lcp = cols[0], cols[1].copy() if self.cap else None
            if self.cap and k == 0:  # the first seed and the last entry share their run of the symbol
                lcp[0] = 0 if last is None else min(self._run(int(last)), self._run(int(pos[0])), self.cap)
            ok, symbol = self.induced(pos, r, True)
            give(r, pos, lcp, True)
            self.push(pos, ok, symbol, lcp)

    def _run(self, at: int) -> int:
        part = self.text[at: at + self.cap + 1]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _many_symbols(self, r: int, seeds: Callable, give: Callable) -> None:
        pos = self.queue[r].all()[0]
        key = 2 * self.symbols(pos)
        more = [c[0] for c in seeds(r)]
        if more:
            extra = np.concatenate(more)
            pos, key = np.concatenate((pos, extra)), np.concatenate((key, 2 * self.symbols(extra) + 1))
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        done, look = 0, 256
        while done < len(pos):
            p, k = pos[done: done + look], key[done: done + look]
            seed = (k & 1).astype(bool)
            ok, symbol = self.induced(p, k >> 1, seed)
            here = ok & (symbol // self.step == r)
            n = len(p)
            if here.any():  # as many as come before every entry that they induce
                where = np.full(n, len(pos) + 1)
                where[here] = np.searchsorted(key, 2 * symbol[here], "right") - done
                early = np.flatnonzero(np.minimum.accumulate(where) < np.arange(1, n + 1))
                n = int(early[0]) if len(early) else n
            give(r, p[:n], None, seed[:n])
            self.push(p[:n], ok[:n] & ~here[:n], symbol[:n], None)
            done, look = done + n, min(max(64, 2 * n), BLOCK)
            new = here[:n]
            if new.any():
                more_key, more_pos = 2 * symbol[:n][new], p[:n][new] - 1
                order = np.argsort(more_key, kind="stable")
                more_key, more_pos = more_key[order], more_pos[order]
                pos, key = pos[done:], key[done:]
                where = np.searchsorted(key, more_key, "right")
                pos, key, done = np.insert(pos, where, more_pos), np.insert(key, where, more_key), 0


def _by_range(where: np.ndarray) -> np.ndarray:
    """The stable order of numbers of ranges, of which there are 256 at most:
    bytes are sorted by counting."""
    return np.argsort(where.astype(np.uint8), kind="stable")


def _tapes(scan: Scan) -> list[Tape]:
    return [Tape(scan.disk, (np.int64, np.int32) if scan.cap else (np.int64,)) for _ in range(scan.n_ranges)]


def induce(text: np.ndarray, size: int, seeds: np.ndarray, disk: Disk, give: Callable, lcp: np.ndarray | None = None, cap: int = 0) -> None:
    """Both scans from the minima ``seeds`` (sorted, with their common-prefix
    values, or in any order, to sort the substrings between them). ``give``
    gets all suffixes downwards but the sentinel's: (range, positions, lcp with
    the next larger one, seed)."""
    up = Scan(text, size, False, disk, cap)
    first = _tapes(up)
    for at in range(0, len(seeds), BLOCK):  # deal the seeds out by range
        pos = np.asarray(seeds[at: at + BLOCK])
        where = up.symbols(pos) // up.step
        order = _by_range(where)
        cuts = (np.flatnonzero(np.diff(where[order])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            k = order[a:b]
            cols = (pos[k], lcp[at: at + BLOCK][k]) if cap else (pos[k],)
            first[int(where[k[0]])].append(*cols)
    falls = _tapes(up)

    def keep(r, pos, value, seed):
        if seed is False:
            falls[r].append(*((pos, value) if cap else (pos,)))
        elif seed is not True:
            falls[r].append(pos[~seed])

    up.run(lambda r: first[r].drain(), keep)
    for t in first:
        t.close()
    down = Scan(text, size, True, disk, cap)

    def turned(r):
        """L entries downwards; an entry's value belongs to the one after it now."""
        lo, hi = down.top - min((r + 1) * down.step - 1, down.top), down.top - r * down.step
        held = 0
        for q in range(hi // up.step, lo // up.step - 1, -1):
            for cols in falls[q].backwards():
                pos = cols[0]
                if cap:
                    value = np.concatenate(([held], cols[1][:-1])).astype(np.int64)
                    held = int(cols[1][-1])
                    yield pos, value
                else:
                    s = text[pos]
                    pos = pos[(s >= lo) & (s <= hi)]
                    if len(pos):
                        yield (pos,)

    down.run(turned, give)
    for t in falls:
        t.close()


def sorted_minima(text: np.ndarray, size: int, disk: Disk) -> np.ndarray:
    """The minima in the order of their suffixes."""
    low = minima(text, disk)
    m = len(low)
    if m <= 1:
        return low
    n = len(text)
    by_substring = disk.array(m, np.int64)
    by_substring[0] = n - 1
    left = [m]

    def collect(r, pos, value, seed):
        s = pos if seed is False else pos[:0] if seed is True else pos[~seed]
        s = s[s > 0]
        s = s[text[s - 1] > text[s]]
        by_substring[left[0] - len(s): left[0]] = s[::-1]
        left[0] -= len(s)

    induce(text, size, low, disk, collect)
    # name the substrings: one more where neighbours differ
    reduced = disk.array(m, np.int32)
    count, place = 0, np.searchsorted(low, by_substring[:1])
    for at in range(1, m, BLOCK * 16):
        b = np.asarray(by_substring[at: at + BLOCK * 16])
        a = np.asarray(by_substring[at - 1: at - 1 + len(b)])
        place = np.concatenate((place[-1:], np.searchsorted(low, b)))
        names = count + np.cumsum(_differ(text, low, a, b, place))
        reduced[place[1:]] = names
        count = int(names[-1])
    if count == m - 1:
        return by_substring
    del by_substring
    small = 32 * m <= disk.budget  # the recursion's end: the names fit into memory
    order = doubled_order(np.asarray(reduced)) if small else suffix_order(reduced, count + 1, disk)
    for at in range(0, m, BLOCK * 16):
        order[at: at + BLOCK * 16] = low[order[at: at + BLOCK * 16]]
    return order


def doubled_order(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of names in memory, by prefixes of
    twice the length in each round. A suffix ranks as the first of those that
    share its prefix; only these are sorted on."""
    m, width = len(names), 1
    order = np.argsort(names, kind="stable")
    live, key, rank = np.arange(m), names[order], np.empty(m, np.int64)
    at = order
    while True:
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = live[np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
        several = ~(first & np.append(first[1:], True))
        live = live[several]
        if not len(live):
            return order
        at = order[live]
        after = at + width
        key = rank[at] * (m + 1) + np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        new = np.argsort(key, kind="stable")
        at, key = at[new], key[new]
        order[live] = at
        width *= 2


def _differ(text: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the substrings from a and from b to the next minimum differ;
    ``place``: of a's first and of every b among the minima."""
    n = len(text)
    k = place + 1
    size = np.where(k < len(low), low[np.minimum(k, len(low) - 1)], n - 1)
    la, lb = size[:-1] - a, size[1:] - b
    out = la != lb
    live = np.flatnonzero(~out)
    k = 0
    while len(live):
        k_ok = k <= la[live]
        live = live[k_ok]
        bad = text[np.minimum(a[live] + k, n - 1)] != text[np.minimum(b[live] + k, n - 1)]
        out[live[bad]] = True
        live = live[~bad]
        k += 1
    return out


def suffix_order(text: np.ndarray, size: int, disk: Disk) -> np.ndarray:
    """All suffixes of a text that ends in a sentinel 0, in order."""
    n = len(text)
    seeds = sorted_minima(text, size, disk)
    out = disk.array(n, np.int64)
    out[0] = n - 1
    left = [n]

    def collect(r, pos, value, seed):
        out[left[0] - len(pos): left[0]] = pos[::-1]
        left[0] -= len(pos)

    induce(text, size, seeds, disk, collect)
    return out


def shared_prefixes(text: np.ndarray, order: np.ndarray, cap: int, disk: Disk) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before, at most
    ``cap``: the values that the induction starts from. No longer prefix matters,
    so they are compared, eight bytes at a time."""
    out = disk.array(len(order), np.int32)
    padded = np.concatenate((text, np.zeros(8, np.uint8))) if not isinstance(text, np.memmap) else text
    n = len(padded) - 7
    words = np.ndarray((n,), "<u8", padded, 0, (1,))
    for at in range(1, len(order), BLOCK * 4):
        b = np.asarray(order[at: at + BLOCK * 4])
        a = np.asarray(order[at - 1: at - 1 + len(b)])
        got = np.zeros(len(b), np.int32)
        live = np.arange(len(b))
        for k in range(0, cap, 8):
            # past the end nothing is shared: the sentinel is alone of its kind
            x = words[np.minimum(a[live] + k, n - 1)] ^ words[np.minimum(b[live] + k, n - 1)]
            past = np.maximum(a[live], b[live]) + k > n - 1
            x[past] = 1
            same = x == 0
            odd = x[~same]
            low = odd & (~odd + np.uint64(1))
            got[live[~same]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            live = live[same]
            got[live] = k + 8
            if not len(live):
                break
        out[at: at + len(b)] = np.minimum(got, cap)
    return out


def repeats(text: np.ndarray, cap: int, budget: int = BUDGET) -> np.ndarray:
    """For a text of bytes that ends in a sentinel 0, which no other symbol is:
    where suffixes begin that share ``cap`` symbols with another one."""
    disk = Disk(budget)
    out = disk.array(len(text), np.bool_)
    if len(text) < 3:
        return out
    size = int(text.max()) + 1
    seeds = sorted_minima(text, size, disk)
    lcp = shared_prefixes(text, seeds, cap, disk)
    held: list[int] = []  # the suffix scanned last

    def mark(r, pos, value, seed):
        hit = value >= cap
        out[pos[hit]] = True
        out[pos[:-1][hit[1:]]] = True
        if hit[0] and held:
            out[held[0]] = True
        held[:] = [int(pos[-1])]

    induce(text, size, seeds, disk, mark, lcp, cap)
    return out
