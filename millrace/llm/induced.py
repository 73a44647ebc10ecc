"""Suffix array and LCP array by induced sorting with disk-backed queues.

Suffixes that start a rising slope after a falling one (S*) are sorted first: by the
names of the substrings between them, recursively. All others follow by induction: a
scan over the buckets upward puts the predecessors of each suffix into the queue of
their first symbol, a scan downward the rest. A queue holds suffix tuples (position,
common prefix with the tuple before it); they leave a queue in the order they came, so
a priority queue by (symbol, arrival) is a row of queues, one for each symbol. The
common prefix of two neighbours in a queue is one more than the least common prefix
between the suffixes that put them there.

Queues and finished buckets beyond ``memory`` bytes go to a file that vanishes with the
task. Common prefixes, and the depth to which order is guaranteed, are limited by
``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np

Runs = list[tuple[np.ndarray, np.ndarray]]


class Queues:
    """First-in-first-out queues of (position, common prefix), one for each symbol."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held = memory, 0
        self.runs: dict[int, list] = {}
        self.file = None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append((pos, lcp))
        self.held += 10 * len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="induced-")
        for runs in self.runs.values():
            for i, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(run[0].astype("<i8").tobytes() + run[1].astype("<u2").tobytes())
                    runs[i] = (at, len(run[0]))
        self.held = 0

    def filled(self, symbol: int) -> bool:
        return symbol in self.runs

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for run in self.runs.pop(symbol, []):
            if isinstance(run[0], np.ndarray):
                self.held -= 10 * len(run[0])
                out.append(run)
            else:
                at, n = run
                self.file.seek(at)
                data = self.file.read(10 * n)
                out.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u2", n, 8 * n)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def slopes(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S). The end counts as the smallest symbol."""
    n = len(t)
    turn = np.flatnonzero(t[1:] != t[:-1])
    last = np.append(turn, n - 1)  # the last place of each run of one symbol
    rising = np.append(t[turn] < t[turn + 1], False)
    return np.repeat(rising, np.diff(np.concatenate(([-1], last))))


def run_lengths(t: np.ndarray) -> np.ndarray:
    """How often the symbol at each place repeats from there on."""
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    ends = np.repeat(last, np.diff(np.concatenate(([-1], last))))
    return ends - np.arange(len(t)) + 1


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes a and b of a byte text, at most ``cap``."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(16, np.uint8)))
    eight = np.ndarray(n + 8, "<u8", padded.data, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    room = np.minimum(cap, n - np.maximum(a, b))
    for at in range(0, cap, 8):
        x = eight[a[live] + at] ^ eight[b[live] + at]
        differ = x != 0
        if differ.any():
            y = x[differ]
            low = y & (~y + np.uint64(1))
            out[live[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
        out[live] = at + 8
        live = live[out[live] < room[live]]
        if not len(live):
            break
    return np.minimum(out, room)


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order, dense ranks, and how many distinct keys."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return order, rank, int(fresh.sum())


def doubled(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of ``names``, up to ``most`` names deep, by prefix doubling."""
    order, rank, distinct = ranks_of(names)
    k = 1
    while distinct < len(names) and k < most:
        after = np.zeros(len(names), np.int64)
        after[:-k] = rank[k:] + 1
        order, rank, distinct = ranks_of(rank * (len(names) + 1) + after)
        k *= 2
    return order


def slope_names(t: np.ndarray, starts: np.ndarray, rising: np.ndarray, cap: int) -> np.ndarray:
    """Ranks of the substrings from each S* suffix through the next one's first symbol.

    Of equal symbols one that starts a falling suffix counts as smaller.
    """
    n, ends = len(t), np.append(starts[1:] + 1, len(t))
    wide = t.dtype.itemsize > 1
    per, bits = (1, 0) if wide else (6, 10)
    rank = np.zeros(len(starts), np.int64)
    act, at = np.arange(len(starts)), 0
    while len(act) and at < cap:
        key = np.zeros(len(act), np.int64)
        for j in range(per):
            where = starts[act] + at + j
            inside = where < ends[act]
            where = np.minimum(where, n - 1)
            key = key << bits | np.where(inside, t[where].astype(np.int64) * 2 + rising[where] + 1, 0)
        at += per
        order = np.lexsort((key, rank[act]))
        act, key, was = act[order], key[order], rank[act][order]
        group = np.concatenate(([True], was[1:] != was[:-1]))
        fresh = group | np.concatenate(([True], key[1:] != key[:-1]))
        place = np.arange(len(act))
        head = lambda marks: np.maximum.accumulate(np.where(marks, place, 0))  # noqa: B023, E731
        rank[act] = was + head(fresh) - head(group)
        # On with those that share their rank while one of them has more symbols.
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(act)))
        more = np.logical_or.reduceat(starts[act] + at < ends[act], heads) & (sizes > 1)
        act = act[np.repeat(more, sizes)]
    return rank


def least_between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for each pair a < b, over a table of doubling steps."""
    out = np.empty(len(a), lcp.dtype)
    if not len(a):
        return out
    level = np.log2((b - a).astype(np.float64)).astype(np.int64)
    table = lcp
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[a[own] + 1], table[b[own] + 1 - (1 << k)])
    return out


class _Sorter:
    def __init__(self, t: np.ndarray, cap: int, memory: int, base: int) -> None:
        self.t, self.cap, self.memory, self.base = t, cap, memory, base
        self.rising = slopes(t)
        self.runs = run_lengths(t)
        self.symbols = np.unique(t).tolist()

    def capped(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(x.astype(np.int64) + 1, self.cap).astype(np.uint16)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """S* suffixes in order with common prefixes (bytes only; zeros above)."""
        t = self.t
        starts = np.flatnonzero(self.rising[1:] & ~self.rising[:-1]) + 1
        if len(starts) < 2:
            return starts, np.zeros(len(starts), np.uint16)
        names = slope_names(t, starts, self.rising, self.cap)
        most = len(starts) if self.cap >= 60000 else self.cap // 2 + 1
        if len(np.unique(names)) == len(names):
            order = np.argsort(names)
        elif len(names) <= self.base:
            order = doubled(names, most)
        else:
            order, _ = suffix_array(names, self.cap, self.memory, self.base)
        starts = starts[order]
        lcp = np.zeros(len(starts), np.uint16)
        if t.dtype.itemsize == 1:
            lcp[1:] = common_prefixes(t, starts[:-1], starts[1:], self.cap)
        return starts, lcp

    def spread(self, queues: Queues, symbol: int, scan: np.ndarray, lcp: np.ndarray, up: bool) -> None:
        """Puts predecessors of other symbols into their queues."""
        before = scan - 1
        kind = self.t[before]
        ok = np.flatnonzero((scan > 0) & ((kind > symbol) if up else (kind < symbol)))
        if not len(ok):
            return
        kind = kind[ok]
        order = np.argsort(kind, kind="stable")
        ok, kind = ok[order], kind[order]
        heads = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        new = np.zeros(len(ok), np.uint16)
        same = np.flatnonzero(kind[1:] == kind[:-1])
        new[same + 1] = self.capped(least_between(lcp, ok[same], ok[same + 1]))
        for a, b in zip(heads, np.append(heads[1:], len(ok)), strict=True):
            target = int(kind[a])
            new[a] = 1 if queues.filled(target) else 0
            queues.push(target, before[ok[a:b]], new[a:b])

    def chained(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bucket's tuples and, after them, those they put into the same bucket."""
        all_pos, all_lcp, depth = [pos], [lcp], 1
        while len(pos):
            ok = np.flatnonzero((pos > 0) & (self.t[pos - 1] == symbol))
            if not len(ok):
                break
            new = np.full(len(ok), min(depth, self.cap), np.uint16)
            if len(ok) > 1:
                new[1:] = self.capped(np.minimum.reduceat(lcp[: ok[-1] + 1], ok[:-1] + 1))
            pos, lcp, depth = pos[ok] - 1, new, depth + 1
            all_pos.append(pos)
            all_lcp.append(lcp)
        return np.concatenate(all_pos), np.concatenate(all_lcp)

    def border(self, a: int, b: int) -> int:
        """Common prefix of the last falling and the first rising suffix of a bucket."""
        return int(min(self.runs[a], self.runs[b], self.cap))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        t, n = self.t, len(self.t)
        star, star_lcp = self.first()
        cut = np.searchsorted(t[star], np.array([*self.symbols, self.symbols[-1] + 1], np.int64)) if len(star) else np.zeros(len(self.symbols) + 1, np.int64)
        queues, falling = Queues(self.memory), Queues(self.memory)
        queues.push(int(t[n - 1]), np.array([n - 1]), np.zeros(1, np.uint16))
        for i, c in enumerate(self.symbols):
            pos, lcp = self.chained(c, *queues.pop(c))
            falling.push(c, pos, lcp)
            own, own_lcp = star[cut[i] : cut[i + 1]], star_lcp[cut[i] : cut[i + 1]].copy()
            if len(own):
                own_lcp[0] = self.border(pos[-1], own[0]) if len(pos) else 0
            self.spread(queues, c, np.concatenate((pos, own)), np.concatenate((lcp, own_lcp)), True)
        sa, out = np.empty(n, np.int64), np.empty(n, np.uint16)
        end, queues = n, Queues(self.memory)
        for c in reversed(self.symbols):
            pos, lcp = self.chained(c, *queues.pop(c))  # rising, greatest first
            low, low_lcp = falling.pop(c)
            a, b = end - len(pos) - len(low), end - len(pos)
            sa[a:b], out[a:b] = low, low_lcp
            sa[b:end] = pos[::-1]
            meet = self.border(low[-1], pos[-1]) if len(pos) and len(low) else 0
            if len(pos):
                out[b:end] = np.append(lcp[1:], meet)[::-1]
            down = np.append(meet, low_lcp[:0:-1]) if len(low) else low_lcp
            self.spread(queues, c, np.concatenate((pos, low[::-1])), np.concatenate((lcp, down.astype(np.uint16))), False)
            end = a
        return sa, out


def suffix_array(t: np.ndarray, cap: int = 60000, memory: int = 64 << 20, base: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` in order (to ``cap`` symbols) and each one's common prefix with the one before.

    ``t``: bytes, or whole numbers (for these the common prefixes are not kept right).
    Reduced texts of at most ``base`` names are sorted in memory, longer ones recursively.
    """
    if len(t) < 2:
        return np.arange(len(t)), np.zeros(len(t), np.uint16)
    return _Sorter(t, cap, memory, base).run()
