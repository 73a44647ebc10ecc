"""Suffix-array dedup over bytes: removes every byte of a string of ``length`` bytes that also starts elsewhere.

1. Pruning. A window of ``length`` bytes holds grams of ``gram`` bytes; equal windows
   have equal least gram hashes. Runs of windows with one least hash are segments. A
   segment whose hash stands nowhere else holds no repeat. Distinct hashes of each
   chunk are shuffled once.
2. Segments left go to shards by their hash; equal segments of a chunk go once, with
   whether there are several. In a shard, equal segments repeat as a whole; segments
   that share their hash with different ones are sorted by external induced sorting
   (``induced``), and a window whose common prefix with a neighbour is ``length`` repeats.
   Segments of a hash that have more than ``heavy`` bytes in all do not go to one shard:
   their windows, distinct in a chunk, are dealt out by 96-bit hashes of all ``length``
   bytes, and those that come from two chunks repeat.
3. Chunks mark the windows, cut the text and give the result.

A shard is about ``1 / (8 * shuffle partitions)`` of the text left, and no hash adds more
than ``heavy`` bytes to one, however many different surroundings a string has. A shard's
texts, suffix array and common prefixes are in memory; only the sorter's queues go to disk.

Defined results: null texts are empty; repeated rows repeat one another; a text shorter
than ``length`` loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.llm.chunks import FACTS, Chunk, chunk_table, chunks_in, dealt, fact_batch, opened, squeezed, with_facts
from millrace.llm.induced import suffix_array
from millrace.session import shuffle_partitions, stored

#: Parts of the shards' answers, to tell them from the parts of known hashes.
ANSWERS = 1 << 24
#: Parts of the windows of heavy hashes; their answers are above them again.
WINDOWS = 1 << 25
SECOND_VALUES = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Segments:
    """Maximal runs of windows of a chunk with one least gram hash, inside one document."""

    def __init__(self, c: Chunk, length: int, gram: int) -> None:
        self.length = length
        n = len(c.data) - length + 1
        if n <= 0:
            self.first = self.last = np.zeros(0, np.int64)
            self.value, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        grams = arrays.windows_hash(arrays.BYTE_VALUES[c.data], gram)
        wide = length - gram + 1
        least = arrays.sliding_min(grams, wide)
        room = np.diff(c.offsets) - length + 1
        docs = np.flatnonzero(room > 0)
        begin = c.offsets[docs]
        fresh = np.zeros(n, bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[begin] = True
        end = begin + room[docs]
        inside = np.zeros(n + 1, np.int32)
        inside[begin] += 1
        inside[end] -= 1
        inside = np.cumsum(inside[:n]) > 0
        self.first = np.flatnonzero(fresh & inside)
        stop = fresh.copy()
        stop[end[end < n]] = True
        stops = np.append(np.flatnonzero(stop), n)
        self.last = stops[np.searchsorted(stops, self.first, "right")]  # after the last window
        value = least[self.first]
        self.twice = np.zeros(len(value), bool)  # its gram stands in it more than once
        span = np.arange(wide)
        for at in range(0, len(value), 2048):
            v = value[at : at + 2048, None]
            a = grams[self.first[at : at + 2048, None] + span] == v
            b = grams[self.last[at : at + 2048, None] - 1 + span] == v
            apart = self.first[at : at + 2048] + a.argmax(axis=1) != self.last[at : at + 2048] - 1 + b.argmax(axis=1)
            self.twice[at : at + 2048] = (a.sum(axis=1) > 1) | (b.sum(axis=1) > 1) | apart
        self.value = arrays.mixed(value)

    def weighed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and how many bytes their segments have."""
        distinct, back = np.unique(self.value, return_inverse=True)
        return distinct, np.bincount(back, self.last - self.first + self.length - 1, len(distinct)).astype(np.uint32)

    def candidates(self, c: Chunk, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the segments whose hash stands in another segment or twice in their own: those to sort,
        and those of heavy hashes."""
        distinct, back, n = np.unique(self.value, return_inverse=True, return_counts=True)
        values, cut = dealt(distinct, parts)
        at = np.searchsorted(distinct, values)
        known, heavy = n > 1, np.zeros(len(distinct), bool)
        for p, bits in c.facts.items():
            if p < ANSWERS:
                own, half = at[cut[p] : cut[p + 1]], len(bits) // 2
                for marks, part in ((known, bits[:half]), (heavy, bits[half:])):
                    marks[own] |= np.unpackbits(np.frombuffer(part, np.uint8), count=len(own)).astype(bool)
        again = known[back] | self.twice
        return np.flatnonzero(again & ~heavy[back]), np.flatnonzero(again & heavy[back])

    def windows(self, c: Chunk, own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows of some segments, for each which distinct one it is, and the distinct ones'
        two hashes, by part, with the borders of the parts."""
        at = arrays.ragged(self.first[own], self.last[own] - self.first[own])
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint32), np.zeros(parts + 1, np.int64)
        one = arrays.windows_hash(arrays.BYTE_VALUES[c.data], self.length)[at]
        two = (arrays.windows_hash(SECOND_VALUES[c.data], self.length)[at] >> np.uint64(32)).astype(np.uint32)
        part = (one % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((two, one, part))
        at, one, two, part = at[order], one[order], two[order], part[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return at, np.cumsum(fresh) - 1, one[fresh], two[fresh], np.searchsorted(part[fresh], np.arange(parts + 1))

    def by_shard(self, c: Chunk, own: np.ndarray, shards: int) -> Iterator[tuple[int, list[bytes], np.ndarray, list[list[int]]]]:
        """For each shard: distinct segment texts, their hashes, and which segments have each."""
        if not len(own):
            return
        shard = (self.value[own] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        own, shard = own[order], shard[order]
        data = c.data.tobytes()
        heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        for a, b in zip(heads, np.append(heads[1:], len(own)), strict=True):
            texts: dict[bytes, list[int]] = {}
            for i in own[a:b].tolist():
                texts.setdefault(data[self.first[i] : self.last[i] + self.length - 1], []).append(i)
            yield int(shard[a]), list(texts), self.value[[i[0] for i in texts.values()]], list(texts.values())


def packed_segments(texts: list[bytes], values: np.ndarray, several: list[bool], twice: list[bool]) -> bytes:
    sizes = np.array([len(t) for t in texts], np.uint32)
    flags = np.array(several, np.uint8) + 2 * np.array(twice, np.uint8)
    return squeezed(np.array([len(texts)], np.int64).tobytes() + sizes.tobytes() + flags.tobytes() + values.tobytes() + b"".join(texts))


def unpacked_segments(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = opened(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.uint32, n, 8).astype(np.int64)
    flags = np.frombuffer(data, np.uint8, n, 8 + 4 * n)
    values = np.frombuffer(data, np.uint64, n, 8 + 5 * n)
    ends = np.cumsum(sizes) + 8 + 13 * n
    return [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], flags, values


def repeated_windows(texts: list[bytes], length: int, memory: int, base: int) -> list[np.ndarray]:
    """For each (distinct) text which of its windows also starts elsewhere in the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = np.frombuffer(b"".join(texts), np.uint8)
    sa, lcp = suffix_array(whole, length, memory, base)
    valid = np.zeros(len(whole) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, np.maximum(ends - length + 1, starts), -1)
    valid = (np.cumsum(valid[:-1]) > 0)[sa]
    rows = np.flatnonzero(valid)
    hit = np.zeros(len(whole), bool)
    if len(rows) > 1:
        # The least common prefix between two windows with suffixes of no window between them.
        low = np.minimum.reduceat(lcp[: rows[-1] + 1], rows[:-1] + 1) >= length
        hit[sa[rows[1:][low]]] = True
        hit[sa[rows[:-1][low]]] = True
    return [hit[s : max(s, e - length + 1)] for s, e in zip(starts, ends, strict=True)]


def shard_answers(rows: list[tuple], length: int, memory: int, base: int) -> list[tuple]:
    """Rows (home, chunk, shard, data) of one shard: packed bits of the repeated windows of each one's segments."""
    number: dict[bytes, int] = {}
    texts, value, several, twice, owner = [], [], [], [], []
    for _, _, _, data in rows:
        own, flags, values = unpacked_segments(data)
        ids = []
        for t, f, v in zip(own, flags.tolist(), values.tolist(), strict=True):
            i = number.get(t)
            if i is None:
                i = number[t] = len(texts)
                texts.append(t)
                value.append(v)
                several.append(bool(f & 1))
                twice.append(bool(f & 2))
            else:
                several[i] = True
            ids.append(i)
        owner.append(ids)
    value, several_, twice_ = np.array(value, np.uint64), np.array(several), np.array(twice)
    _, back, n = np.unique(value, return_inverse=True, return_counts=True)
    # Segments that are all there several times need no order among themselves; their kind does if one is not.
    settled = np.bincount(back, ~several_, len(n)) == 0
    sort = np.flatnonzero(((n[back] > 1) & ~settled[back]) | (twice_ & ~several_))
    hits: dict[int, np.ndarray] = dict(zip(sort.tolist(), repeated_windows([texts[i] for i in sort], length, memory, base), strict=True)) if len(sort) else {}
    out = []
    for (home, chunk, shard, _), ids in zip(rows, owner, strict=True):
        bits = [
            np.ones(len(texts[i]) - length + 1, bool) if several[i] else hits.get(i, np.zeros(len(texts[i]) - length + 1, bool)) for i in ids
        ]
        out.append((home, chunk, shard + ANSWERS, squeezed(np.packbits(np.concatenate(bits)).tobytes())))
    return out


def keyed_facts(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows whose data are n values (uint64) and n numbers (uint32): all values, all numbers, the rows' borders."""
    n = [len(r[3]) // 12 for r in rows]
    values = np.concatenate([np.frombuffer(r[3], np.uint64, k) for r, k in zip(rows, n, strict=True)])
    numbers = np.concatenate([np.frombuffer(r[3], np.uint32, k, 8 * k) for r, k in zip(rows, n, strict=True)])
    return values, numbers, np.cumsum([0, *n])


def known_hashes(rows: list[tuple], heavy: int) -> list[tuple]:
    """Which hashes came from more than one chunk, then which have more than ``heavy`` bytes, as packed bits."""
    values, sizes, cut = keyed_facts(rows)
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    hit, large = (n > 1)[back], (np.bincount(back, sizes) > heavy)[back]
    return [(*r[:3], np.packbits(hit[a:b]).tobytes() + np.packbits(large[a:b]).tobytes()) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]


def window_answers(rows: list[tuple]) -> list[tuple]:
    """Which windows came from more than one chunk, as packed bits."""
    one, two, cut = keyed_facts(rows)
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    hit = np.zeros(len(one), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return [(*r[:2], r[2] + ANSWERS, np.packbits(hit[a:b]).tobytes()) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]


def fact_rows(table: pa.Table) -> list[tuple]:
    return list(zip(*[table.column(i).to_pylist() for i in range(4)], strict=True))


def segments_sent(chunks: DataFrame, length: int, gram: int, tag: str, heavy: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Facts of the chunks' known hashes, what they send to each part, and the numbers of parts and shards."""
    parts = shuffle_partitions(chunks.sparkSession)
    shards = 8 * parts

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            distinct, sizes = Segments(c, length, gram).weighed()
            values, cut = dealt(distinct, parts)
            sizes = sizes[np.searchsorted(distinct, values)]
            yield fact_batch([(c.home, c.number, p, values[a:b].tobytes() + sizes[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    def count(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([fact_batch(known_hashes(fact_rows(table), heavy))])

    known = stored(chunks.mapInArrow(hashes, FACTS).groupBy("part").applyInArrow(count, FACTS), f"{tag}-known")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            s = Segments(c, length, gram)
            light, large = s.candidates(c, parts)
            rows = []
            for shard, texts, values, ids in s.by_shard(c, light, shards):
                rows.append((c.home, c.number, shard, packed_segments(texts, values, [len(i) > 1 for i in ids], [bool(s.twice[i[0]]) for i in ids])))
            _, _, one, two, cut = s.windows(c, large, parts)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                rows.append((c.home, c.number, WINDOWS + p, one[a:b].tobytes() + two[a:b].tobytes()))
            yield fact_batch(rows)

    return known, with_facts(chunks, known).mapInArrow(segments, FACTS), parts, shards


def marked(
    docs: DataFrame, length: int, gram: int, tag: str, memory: int, base: int, keep: tuple[str, ...] = (), chunk_bytes: int = 1 << 20, heavy: int = 4 << 20
) -> tuple[DataFrame, int, int]:
    """Chunks with the facts that ``removed_bytes`` needs, and the numbers of parts and shards."""
    chunks = chunk_table(docs, tag, keep, chunk_bytes)
    known, sent, parts, shards = segments_sent(chunks, length, gram, tag, heavy)

    def answer(table: pa.Table) -> pa.Table:
        rows = fact_rows(table)
        return pa.Table.from_batches([fact_batch(window_answers(rows) if rows[0][2] >= WINDOWS else shard_answers(rows, length, memory, base))])

    answers = stored(sent.groupBy("part").applyInArrow(answer, FACTS), f"{tag}-answers")
    return with_facts(chunks, known.unionByName(answers)), parts, shards


def removed_bytes(c: Chunk, s: Segments, parts: int, shards: int) -> np.ndarray:
    """Which bytes of a chunk lie in a repeated window."""
    gone = np.zeros(len(c.data) + 1, np.int32)
    if len(s.first):
        light, large = s.candidates(c, parts)
        starts, number, _, _, cut = s.windows(c, large, parts)
        if len(starts):
            again = np.bincount(number) > 1
            for p in np.flatnonzero(np.diff(cut)).tolist():
                bits = np.frombuffer(c.facts[WINDOWS + ANSWERS + p], np.uint8)
                again[cut[p] : cut[p + 1]] |= np.unpackbits(bits, count=int(cut[p + 1] - cut[p])).astype(bool)
            hit = starts[again[number]]
            gone[hit] += 1
            gone[hit + s.length] -= 1
        for shard, texts, _, ids in s.by_shard(c, light, shards):
            data = c.facts.get(shard + ANSWERS)
            if data is None:
                continue
            n = np.array([len(t) - s.length + 1 for t in texts], np.int64)
            bits = np.unpackbits(np.frombuffer(opened(data), np.uint8), count=int(n.sum())).astype(bool)
            for end, size, own in zip(np.cumsum(n).tolist(), n.tolist(), ids, strict=True):
                at = np.flatnonzero(bits[end - size : end])
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > 1)
                    lo, hi = at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)]
                    for i in own:
                        np.add.at(gone, s.first[i] + lo, 1)
                        np.add.at(gone, s.first[i] + hi + s.length, -1)
    return np.cumsum(gone[:-1]) > 0


def repeated_byte_digests(
    docs: DataFrame, length: int = 400, gram: int = 48, memory: int = 64 << 20, base: int = 1 << 22, tag: str = "bytes", chunk_bytes: int = 1 << 20, heavy: int = 4 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``memory``: bytes of queues in a task before they go to disk;
    ``heavy``: bytes of one gram hash's segments beyond which its windows are dealt out."""
    chunks, parts, shards = marked(docs, length, gram, tag, memory, base, (), chunk_bytes, heavy)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            gone = removed_bytes(c, Segments(c, length, gram), parts, shards)
            per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[c.offsets])  # noqa: B023, E731
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = c.offsets[:-1][np.diff(c.offsets) > 0]
            begins[inner] = gone[inner]
            kept = c.data[~gone].tobytes()
            cut = np.concatenate(([0], np.cumsum(~gone)))[c.offsets].tolist()
            shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c.ids, pa.array(np.diff(c.offsets)), pa.array(per(gone)), pa.array(per(begins)), pa.array(shas)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return chunks.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
