"""Substring dedup by prefix-partitioned suffix trees over words.

A word removed is one that lies in a window of ``window`` consecutive words whose
sequence also starts in a document with a smaller doc_id.

1. Leaf pruning. Every window holds grams of ``gram`` words; its least gram hash must
   come from another document too, or its suffix is a leaf that hangs above the depth
   asked for. Distinct least hashes of each chunk are shuffled once, the suffixes left
   are a small part of all. Neighbouring suffixes with one least gram travel as one
   stretch of words, equal stretches of a chunk as one with the smallest doc_id.
2. Prefix partitions. The words that begin a least gram, which suffixes with a common
   window share, are counted; prefixes of one to three words, longer where many
   suffixes share them, cut the key space into groups of about equal size.
3. Subtrees. A group's stretches give its suffixes; they are sorted and their common
   prefixes taken: a suffix tree in the form of its leaves in order and their LCP array,
   whose LCP intervals are the internal nodes. Below a node of depth ``window`` or more
   all suffixes repeat; those that are not of its smallest document are reported.
4. Chunks mark what was reported, cut the text and give the result.

Words are compared by 64-bit hashes of which 32 bits each travel; a suffix is 13 of
them, so unequal windows do not meet in practice.

Memory: a chunk is some MB, a group about ``1 / (4 * shuffle partitions)`` of the pruned
suffixes; the same passage repeated in very many documents arrives once a chunk.

Defined results: null texts have no words; a null doc_id counts as larger than all
others; rows with equal doc_ids count as one document and do not remove from one
another; shorter texts lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.llm.chunks import FACTS, Chunk, chunk_table, chunks_in, dealt, fact_batch, opened, repeated_values, squeezed, with_facts
from millrace.session import shuffle_partitions, stored

STEP, LEVELS = 12, 3  # bits of a word's hash that make a letter of a prefix, words at most


class Suffixes:
    """Windows of a chunk: their word hashes, documents and least grams."""

    def __init__(self, c: Chunk, window: int, gram: int) -> None:
        self.starts, self.ends, self.cut = arrays.words(c.data, c.offsets)
        self.hashes = arrays.spans_hash(arrays.BYTE_VALUES[c.data], self.starts, self.ends)
        self.at = np.flatnonzero(arrays.whole_windows(self.cut, window))
        docs = np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut))
        self.doc = docs[self.at]
        self.key = c.order[self.doc] if len(self.at) else np.zeros(0, np.int64)
        self.window = window
        self.gram = gram
        self.grams = arrays.windows_hash(self.hashes, gram)

    def least(self) -> np.ndarray:
        return arrays.sliding_min(self.grams, self.window - self.gram + 1)[self.at]

    def runs(self, least: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of chosen neighbouring windows (row numbers) with one least gram: first rows, numbers of windows, prefixes."""
        at, doc, v = self.at[chosen], self.doc[chosen], least[chosen]
        fresh = np.ones(len(chosen), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])
        heads = np.flatnonzero(fresh)
        span = np.arange(self.window - self.gram + 1)
        where = np.empty(len(heads), np.int64)
        for i in range(0, len(heads), 1 << 14):
            own = at[heads[i : i + (1 << 14)]]
            where[i : i + (1 << 14)] = own + (self.grams[own[:, None] + span] == v[heads[i : i + (1 << 14)], None]).argmax(axis=1)
        return chosen[heads], np.diff(np.append(heads, len(chosen))), self.prefixes(where)

    def names(self) -> np.ndarray:
        return arrays.windows_hash(self.hashes, self.window)[self.at]

    def prefixes(self, where: np.ndarray) -> np.ndarray:
        """Letters of the words from the given places on, as one number."""
        out = np.zeros(len(where), np.int64)
        for j in range(LEVELS):
            out = out << STEP | (self.hashes[where + j] >> np.uint64(64 - STEP)).astype(np.int64)
        return out


def grouped_min(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal values: distinct values, row of the first, number of each row's value, least and greatest key."""
    order = np.lexsort((keys, values))
    v = values[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = v[1:] != v[:-1]
    heads = np.flatnonzero(fresh)
    back = np.empty(len(v), np.int64)
    back[order] = np.cumsum(fresh) - 1
    tails = np.append(heads[1:], len(v)) - 1 if len(v) else heads
    return order[heads], back, keys[order[heads]], keys[order[tails]]


def prefix_counts(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(level, prefix, stretches): all first words, and longer prefixes where many share one."""
    out, rows = [], np.ones(len(key), bool)
    for level in range(1, LEVELS + 1):
        p = key >> STEP * (LEVELS - level)
        u, n = np.unique(p[rows], return_counts=True)
        out += [(level, int(a), int(b)) for a, b in zip(u, n, strict=True)]
        heavy = u[n > max(300, len(key) // 64)]
        rows &= np.isin(p, heavy)
    return out


def prefix_borders(counts: list[tuple[int, int, int]], groups: int) -> np.ndarray:
    """Borders of the groups in the key space; bounded by the number of cells, not by the data."""
    levels: list[dict[int, int]] = [{} for _ in range(LEVELS + 1)]
    for level, p, n in counts:
        levels[level][p] = n
    goal = max(1, sum(levels[1].values()) // groups)
    cells: list[tuple[int, int]] = []

    def put(level: int, p: int, n: int) -> None:
        deeper = [(q, m) for q, m in levels[level + 1].items() if q >> STEP == p] if level < LEVELS and n > goal else []
        if deeper:
            base = p << STEP * (LEVELS - level)
            cells.append((base, max(0, n - sum(m for _, m in deeper))))
            for q, m in sorted(deeper):
                put(level + 1, q, m)
        else:
            cells.append((p << STEP * (LEVELS - level), n))

    for p, n in sorted(levels[1].items()):
        put(1, p, n)
    borders, filled = [0], 0
    for base, n in cells:
        if filled and filled + n > goal:
            borders.append(base)
            filled = 0
        filled += n
    return np.unique(np.array(borders, np.int64))


def ordered(context: np.ndarray) -> np.ndarray:
    """Order of suffixes given by their words (rows of uint32)."""
    n, w = context.shape
    pairs = np.zeros((n, (w + 1) // 2), np.uint64)
    pairs |= context[:, 0::2].astype(np.uint64) << np.uint64(32)
    pairs[:, : w // 2] |= context[:, 1::2]
    return np.lexsort([pairs[:, j] for j in reversed(range(pairs.shape[1]))])


def deep_nodes(context: np.ndarray, depth: int) -> np.ndarray:
    """For sorted suffixes, where the topmost internal nodes of string depth ``depth`` or more begin:
    a suffix starts a new one if its common prefix with the one before is shorter."""
    same = context[1:] == context[:-1]
    lcp = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if len(same) else np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(lcp < depth) + 1))


def repeats(docs: DataFrame, window: int, gram: int, tag: str, keep: tuple[str, ...], chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The chunk table, and facts: for each chunk the places of windows repeated from a smaller document of another chunk."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    chunks = chunk_table(docs, tag, keep, chunk_bytes)

    def least_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            s = Suffixes(c, window, gram)
            least = s.least()
            values, cut = dealt(np.unique(arrays.mixed(least)), parts)
            rows = [(c.home, c.number, p, values[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            counts = np.array(prefix_counts(s.runs(least, np.arange(len(s.at)))[2]), np.int64).reshape(-1, 3)
            yield fact_batch([*rows, (c.home, c.number, -1, counts.tobytes())])

    sent = stored(chunks.mapInArrow(least_grams, FACTS), f"{tag}-grams", "none")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(3)], names=["level", "prefix", "n"])

    counts = sent.filter("part = -1").select("data").mapInArrow(added, "level long, prefix long, n long")
    # At most 4096 first words and 4096 continuations of each of the heavy ones.
    total = counts.groupBy("level", "prefix").agg(F.sum("n").alias("n")).toArrow()
    borders = prefix_borders(list(zip(*[total[c].to_pylist() for c in ("level", "prefix", "n")], strict=True)), 4 * parts)
    known = stored(repeated_values(sent.filter("part >= 0")), f"{tag}-known")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            s = Suffixes(c, window, gram)
            if not len(s.at):
                continue
            least = s.least()
            values, cut = dealt(np.unique(arrays.mixed(least)), parts)
            hit = np.zeros(len(values), bool)
            for p, bits in c.facts.items():
                n = cut[p + 1] - cut[p]
                hit[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            left = np.flatnonzero(np.isin(arrays.mixed(least), values[hit]))
            if not len(left):
                continue
            row, n, key = s.runs(least, left)
            start = s.at[row]
            first, _, low, _ = grouped_min(arrays.spans_hash(s.hashes, start, start + n + window - 1), s.key[row])
            order = np.argsort(key[first], kind="stable")
            first, low = first[order], low[order]
            start, size, key = start[first], n[first] + window - 1, key[first]
            group = np.searchsorted(borders, key, "right") - 1
            words = (s.hashes[arrays.ragged(start, size)] >> np.uint64(16)).astype(np.uint32)
            ends = np.concatenate(([0], np.cumsum(size)))
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            rows = []
            for a, b in zip(heads, np.append(heads[1:], len(group)), strict=True):
                data = np.array([b - a]).tobytes() + low[a:b].tobytes() + row[first[a:b]].astype(np.uint32).tobytes()
                data += size[a:b].astype(np.uint32).tobytes() + words[ends[a] : ends[b]].tobytes()
                rows.append((c.home, c.number, int(group[a]), squeezed(data)))
            yield fact_batch(rows)

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, low, place, size, words = [], [], [], [], []
        for batch in batches:
            for home, number, part, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                data = opened(data)
                n = int(np.frombuffer(data, np.int64, 1)[0])
                low.append(np.frombuffer(data, np.int64, n, 8))
                place.append(np.frombuffer(data, np.uint32, n, 8 + 8 * n))
                size.append(np.frombuffer(data, np.uint32, n, 8 + 12 * n).astype(np.int64))
                words.append(np.frombuffer(data, np.uint32, -1, 8 + 16 * n))
                who.append((home, number, part, int((size[-1] - window + 1).sum())))
        owner = np.repeat(np.arange(len(who)), [w[3] for w in who])
        size, words = np.concatenate(size), np.concatenate(words)
        windows = size - window + 1
        context = np.lib.stride_tricks.sliding_window_view(words, window)[arrays.ragged(np.cumsum(size) - size, windows)]
        low = np.repeat(np.concatenate(low), windows)
        place = arrays.ragged(np.concatenate(place).astype(np.int64), windows).astype(np.uint32)
        order = ordered(context)
        heads = deep_nodes(context[order], window)
        node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        # Of a node's suffixes from one chunk, the smallest document against the smallest of all.
        own = order[np.lexsort((owner[order], node))]
        pair = node * len(who) + owner[own]  # node is as sorted as before
        firsts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        late = np.minimum.reduceat(low[own], firsts) > np.minimum.reduceat(low[order], heads)[node[firsts]]
        hit = np.sort(own[firsts[late]])
        cut = np.searchsorted(owner[hit], np.arange(len(who) + 1))
        yield fact_batch([(*w[:3], place[hit[a:b]].tobytes()) for w, a, b in zip(who, cut[:-1], cut[1:], strict=True) if b > a])

    groups = with_facts(chunks, known).mapInArrow(suffixes, FACTS)
    found = stored(groups.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(subtree(t.to_batches())), FACTS), f"{tag}-found")
    return chunks, found


def removed_words(c: Chunk, s: Suffixes) -> np.ndarray:
    """Which words of a chunk lie in a window that repeats one of a smaller document."""
    gone = np.zeros(len(s.starts) + 1, np.int32)
    if len(s.at):
        _, back, low, _ = grouped_min(s.names(), s.key)
        known = np.zeros(len(low), bool)
        for data in c.facts.values():
            known[back[np.frombuffer(data, np.uint32)]] = True
        hit = s.at[known[back] | (s.key > low[back])]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + s.window, -1)
    return np.cumsum(gone)[:-1] > 0


def kept_texts(c: Chunk, s: Suffixes, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words joined by one space."""
    data = np.append(c.data, np.uint8(32))
    own = np.flatnonzero(keep)
    sizes = s.ends[own] - s.starts[own] + 1
    out = data[arrays.ragged(s.starts[own], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out[ends[1:] - 1] = 32
    text = out.tobytes()
    cut = ends[np.searchsorted(own, s.cut)]
    return [text[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _per_doc(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[cut])


def substring_digests(docs: DataFrame, window: int = 13, gram: int = 5, tag: str = "substrings", chunk_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    chunks, found = repeats(docs, window, gram, tag, (), chunk_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            s = Suffixes(c, window, gram)
            gone = removed_words(c, s)
            shas = [hashlib.sha256(t).hexdigest() for t in kept_texts(c, s, ~gone)]
            yield pa.RecordBatch.from_arrays(
                [c.ids, pa.array(np.diff(s.cut)), pa.array(_per_doc(gone, s.cut)), pa.array(shas)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return with_facts(chunks, found).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, keep: tuple[str, ...] = (), window: int = 13, gram: int = 5, tag: str = "substrings", chunk_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, text (without the removed words and the white space after each), the columns in ``keep``."""
    chunks, found = repeats(docs, window, gram, tag, keep, chunk_bytes)
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*[f"`{k}`" for k in keep]).schema} if keep else {}
    schema = ", ".join(["doc_id long", "text string", *[f"`{n}` {t}" for n, t in fields.items()]])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_in(batches):
            s = Suffixes(c, window, gram)
            gone = removed_words(c, s)
            lost = np.zeros(len(c.data) + 1, np.int32)
            after = np.append(s.starts[1:], len(c.data)) if len(s.starts) else s.starts
            last = s.cut[1:][np.diff(s.cut) > 0] - 1
            after[last] = c.offsets[1:][np.diff(s.cut) > 0]
            np.add.at(lost, s.starts[gone], 1)
            np.add.at(lost, after[gone], -1)
            stays = np.cumsum(lost[:-1]) == 0
            left = c.data[stays].tobytes()
            cut = np.concatenate(([0], np.cumsum(stays)))[c.offsets].tolist()
            texts = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            text = pa.array(texts, pa.binary()).cast(pa.string())
            rest = [c.rest.field(n) for n in fields] if fields else []
            yield pa.RecordBatch.from_arrays([c.ids, text, *rest], names=["doc_id", "text", *fields])

    return with_facts(chunks, found).mapInArrow(cut_out, schema)
