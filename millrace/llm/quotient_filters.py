"""Counting quotient filters: lossless compact counters of packed word-id n-grams.

An n-gram of ids of ``bits`` bits is two lanes, the left n // 2 ids and the right rest (at
most 64 bits each). Feistel rounds permute the pair invertibly, so keys spread evenly and
nothing is lost. The leading bits of the left lane are the quotient, all the others the
remainder. A filter holds the entries in order: a bit for each quotient of its range
(occupied), a bit for each entry (last of its quotient's run), the remainders as byte
planes, and counters of one byte, longer ones aside. Filters are sorted, so those of
many shards merge by one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

from millrace.llm import arrays

U = np.uint64
#: Odd constants of the rounds.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def mask(bits: int) -> U:
    return U((1 << bits) - 1)


def widths(n: int, bits: int) -> tuple[int, int]:
    """Bits of the left and the right lane of an n-gram."""
    return n // 2 * bits, (n - n // 2) * bits


def packed(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of n-grams, a row each."""
    n = ids.shape[1]
    lane = lambda columns: sum((ids[:, c].astype(U) << U(bits * i) for i, c in enumerate(reversed(columns))), np.zeros(len(ids), U))
    return lane(range(n // 2)), lane(range(n // 2, n))


def unpacked(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    cut = lambda lane, k: [(lane >> U(bits * (k - 1 - i))) & mask(bits) for i in range(k)]
    return np.stack(cut(left, n // 2) + cut(right, n - n // 2), axis=1).astype(np.int64)


def permuted(left: np.ndarray, right: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    for i, c in enumerate(ROUNDS):
        if i % 2:
            left = left ^ (arrays.mixed(right + U(c)) & mask(a))
        else:
            right = right ^ (arrays.mixed(left + U(c)) & mask(b))
    return left, right


def restored(left: np.ndarray, right: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    for i, c in reversed(list(enumerate(ROUNDS))):
        if i % 2:
            left = left ^ (arrays.mixed(right + U(c)) & mask(a))
        else:
            right = right ^ (arrays.mixed(left + U(c)) & mask(b))
    return left, right


def ordered(left: np.ndarray, right: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and which of them (in that order) are the first of their kind."""
    if a + b <= 64:
        whole = left << U(b) | right if b < 64 else right
        order = np.argsort(whole, kind="stable")
    else:
        order = np.lexsort((right, left))
    x, y = left[order], right[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, fresh


@dataclass
class Counts:
    """Distinct keys in order with their counts (int64)."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray


def counted(left: np.ndarray, right: np.ndarray, a: int, b: int, count: np.ndarray | None = None) -> tuple[Counts, np.ndarray]:
    """Distinct keys with their (summed) counts, and each key's place among them."""
    order, fresh = ordered(left, right, a, b)
    first = np.flatnonzero(fresh)
    if count is None:
        total = np.diff(np.concatenate((first, [len(order)])))
    else:
        total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    at = order[first]
    return Counts(left[at], right[at], total), place


def parts_of(left: np.ndarray, a: int, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of the left lane, so parts keep the order."""
    top = min(a, 31)
    return ((left >> U(a - top)) * U(parts) >> U(top)).astype(np.int64)


def planes(x: np.ndarray, bits: int) -> bytes:
    return b"".join((x >> U(8 * i)).astype(np.uint8).tobytes() for i in range(-(-bits // 8)))


def from_planes(data: bytes, n: int, bits: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-(-bits // 8), n).astype(U)
    return sum((row << U(8 * i) for i, row in enumerate(rows)), np.zeros(n, U))


def encoded(c: Counts, a: int, b: int, quotient: int) -> bytes:
    """A filter of sorted distinct keys whose quotients are the leading ``quotient`` bits of the left lane."""
    n, low = len(c.count), a - quotient
    if not n:
        return b""
    q = (c.left >> U(low)).astype(np.int64)
    base = int(q[0])
    occupied = np.zeros(int(q[-1]) - base + 1, bool)
    occupied[q - base] = True
    ends = np.ones(n, bool)
    ends[:-1] = q[1:] != q[:-1]
    small = np.minimum(c.count, 255).astype(np.uint8)
    large = c.count[c.count >= 255].astype("<i8")
    fields = [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), planes(c.left & mask(low), low), planes(c.right, b), small.tobytes(), large.tobytes()]
    head = np.array([n, base, len(occupied), *map(len, fields)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(fields))


def decoded(data: bytes, a: int, b: int, quotient: int) -> Counts:
    if not data:
        return Counts(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
    data, low = zstandard.ZstdDecompressor().decompress(data), a - quotient
    n, base, span, *sizes = np.frombuffer(data[:72], "<i8").tolist()
    cut = np.cumsum([72, *sizes])
    occupied, ends, left, right, small, large = (data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True))
    bit = lambda x, k: np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool)
    run = np.concatenate(([0], np.cumsum(bit(ends, n))[:-1]))
    q = (np.flatnonzero(bit(occupied, span)) + base).astype(U)[run]
    count = np.frombuffer(small, np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(large, "<i8")
    return Counts(q << U(low) | from_planes(left, n, low), from_planes(right, n, b), count)


def merged(filters: list[Counts], a: int, b: int) -> tuple[Counts, list[np.ndarray]]:
    """The sum of sorted filters, and each filter's entries' places in it."""
    if not filters:
        return decoded(b"", a, b, 0), []
    join = lambda name: np.concatenate([getattr(f, name) for f in filters])
    total, place = counted(join("left"), join("right"), a, b, join("count"))
    return total, np.split(place, np.cumsum([len(f.count) for f in filters])[:-1])
