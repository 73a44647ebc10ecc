"""Array helpers for tasks: text batches as bytes, words and rolling hashes without a loop per word.

Hashes are polynomials modulo 2**64 over random byte values, finished by a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: ASCII white space as the word pattern [^\x20\x09-\x0D]+ has it.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = U(0x9E3779B97F4A7C15 | 1)
UNBASE = U(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; the longest made so far are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 18)) << 18
        up, down = np.full(size, BASE), np.full(size, UNBASE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] (uint64) for each span."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def windows_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[k:] - total[:n]) * down[:n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: prefix and suffix minima of blocks of w."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % w
    x = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).reshape(-1)
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


#: Bytes of text after which a task releases memory; more often costs time.
RELEASE = 1 << 24


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and malloc keep it otherwise, in each idle worker of an executor too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array one after another, and offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece has about ``most`` bytes of text, or one longer text; memory is released at the end and
    after batches of ``RELEASE`` bytes in all."""
    passed = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        passed += int(offsets[-1])
        if passed >= RELEASE:
            release()
            passed = 0
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of words before it."""
    solid = ~SPACES[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    finishes[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each text the number of words before it."""
    starts, ends, cut = words(data, offsets)
    return spans_hash(BYTE_VALUES[data], starts, ends), cut


def whole_windows(cut: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words (or values) that start anywhere lie in one text."""
    n = int(cut[-1]) - k + 1
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):
        at = cut[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
