"""Token ids of whole texts, and files of ids as shuffled planes.

``encoded`` gives the ids of every text with the ``tokenizers`` library. A byte-level
BPE splits a text before it merges, and a space between two visible characters always
starts a new piece; so texts are cut there, distinct words are encoded once for each
worker (told apart by 64-bit hashes) and looked up afterwards.

File format (little-endian), one file for a range of doc_id:
``MRTOK1\\0\\0``; for each chunk of ``chunk_ids`` ids its planes, each a zstandard frame;
the index: three numpy arrays (chunks: first id, ids, planes, offset; planes: offset,
length, kind; documents: doc_id, null flag, tokens), each a zstandard frame; a footer of
eight int64: offsets and lengths of the three, number of ids, plane kind (1 or 8).
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.session import arrow_rows, scratch, shuffle_partitions, stored

MAGIC = b"MRTOK1\0\0"
#: Fixed value: how a byte-level tokenizer splits a text before it merges.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: visible Latin-1 characters as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = _byte_letters()
#: Leading bytes of the UTF-8 forms of white space outside ASCII.
WIDE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
NEAR_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


def cut_at_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts: at a text's start, and at a space between two characters that
    are certainly not white space."""
    n = len(data)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    after = data[at + 1]
    fine = ~NEAR_SPACE[data[at - 1]] & ~NEAR_SPACE[after] & ~WIDE_SPACE[after]
    fine &= (data[at - 1] < 0x80) | ~(WIDE_SPACE[data[np.maximum(at - 2, 0)]] | WIDE_SPACE[data[np.maximum(at - 3, 0)]])
    mark = np.zeros(n, bool)
    mark[at[fine]] = True
    first = offsets[:-1][np.diff(offsets) > 0]
    mark[first[first > 0] - 1] = False  # a text's last character has nothing after it
    mark[first] = True
    return np.flatnonzero(mark)


def splits_at_words(made: dict) -> bool:
    """Whether a tokenizer is one that may be given word by word: byte-level BPE with the usual split, without a
    normaliser, and with added tokens that can be told by "<|". All others get whole texts."""
    model, split = made["model"], made.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    told = all("<|" in t["content"] and not t.get("lstrip") and not t.get("rstrip") for t in made.get("added_tokens", []))
    return bool(model["type"] == "BPE" and plain and usual and told and not made.get("normalizer") and not made.get("truncation"))


class Encoder:
    """Encodes batches of texts; remembers ids of up to ``most`` distinct words by 64-bit hash."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = splits_at_words(json.loads(self.tokenizer.to_str()))
        arrays.release()  # what its vocabulary took as text and as Python objects
        self.most = most
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of the words one after another, and how many each has.

        A word is split as the tokenizer splits it, and each piece goes to its BPE model;
        words with letters beyond Latin or with a special token take its whole pipeline.
        """
        flat: list[int] = []
        sizes: list[int] = []
        for w in words:
            before = len(flat)
            if "<|" in w or not (w.isascii() or max(w) < "\u0250"):
                flat += self.tokenizer.encode(w, add_special_tokens=False).ids
            else:
                for p in _PIECES.findall(w):
                    ids = self.pieces.get(p)
                    if ids is None:
                        ids = tuple([t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(LETTERS))])
                        if len(p) < 6 and len(self.pieces) < 50_000:
                            self.pieces[p] = ids
                    flat += ids
            sizes.append(len(flat) - before)
        return flat, sizes

    def _learn(self, fresh: np.ndarray, words: list[str]) -> None:
        flat, sizes = self._ids(words)
        flat, sizes = np.array(flat, np.uint32), np.array(sizes, np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(words) > len(self.first):
            self.first, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        own = slice(self.n, self.n + len(words))
        self.first[own], self.length[own] = self.used + np.cumsum(sizes) - sizes, sizes
        at = np.searchsorted(self.known, fresh)
        self.known = np.insert(self.known, at, fresh)
        self.place = np.insert(self.place, at, np.arange(own.start, own.stop))
        self.used += len(flat)
        self.n += len(words)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        data, offsets = arrays.text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        if self.n > self.most:
            self.forget()
        starts = cut_at_spaces(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, one, back = np.unique(arrays.spans_hash(arrays.BYTE_VALUES[data], starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool) if not self.n else self.known[np.minimum(at, self.n - 1)] != hashes
        if new.any():
            text, own = data.tobytes(), one[new]
            self._learn(hashes[new], [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            at = np.searchsorted(self.known, hashes)
        word = self.place[at][back]
        lengths = self.length[word]
        ids = self.flat[arrays.ragged(self.first[word], lengths)]
        cut = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
        return ids, np.diff(cut)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process; later tasks find its words known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Bytes of text encoded at once. Arrays of 64-bit numbers for each byte stand beside them, several at a time, in every worker of
#: an executor.
PIECE = 1 << 18
#: Rows that Spark hands to a worker at once; a batch stands in memory on both sides, several times.
BATCH_ROWS = 500


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each batch: itself, ids of its texts one after another (each with ``end_id``), offsets."""
    enc = encoder(path)
    for batch in arrays.pieces(batches, most=PIECE):
        ids, sizes = enc.encode(batch.column(batch.schema.get_field_index("text")))
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            sizes = sizes + 1
        yield batch, ids, np.concatenate(([0], np.cumsum(sizes)))


def crc32s(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


# --- planes ---------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Transposes uint32 ids into byte planes (kind 8) or bit planes (kind 1), lowest first; planes of zeros at the top are left out."""
    by = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == 8:
        planes = np.ascontiguousarray(by.T)
    else:
        bits = np.unpackbits(by, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    n = len(planes)
    while n and not planes[n - 1].any():
        n -= 1
    return [planes[i].tobytes() for i in range(n)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == 8:
        by = np.zeros((4, n), np.uint8)
        for i, p in enumerate(planes):
            by[i] = np.frombuffer(p, np.uint8)
        return np.ascontiguousarray(by.T).view("<u4").reshape(-1)
    bits = np.zeros((32, n), np.uint8)
    for i, p in enumerate(planes):
        bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class IdWriter:
    """Writes ids in chunks of ``chunk_ids`` to an open binary file."""

    def __init__(self, out: io.RawIOBase, chunk_ids: int = 1 << 16, kind: int = 8, level: int = 1) -> None:
        self.out, self.chunk_ids, self.kind = out, chunk_ids, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.ids, self.held = 0, 0, np.zeros(0, np.uint32)
        self.chunks: list[tuple] = []
        self.planes: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.kind)
        self.chunks.append((self.ids, len(ids), len(planes), len(self.planes)))
        for p in planes:
            data = self.zstd.compress(p)
            self.planes.append((self.at, len(data)))
            self._put(data)
        self.ids += len(ids)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, nulls.astype(np.int64), sizes]).T)
        ids = np.concatenate((self.held, ids))
        whole = len(ids) // self.chunk_ids * self.chunk_ids
        for i in range(0, whole, self.chunk_ids):
            self._chunk(ids[i : i + self.chunk_ids])
        self.held = ids[whole:].copy()

    def close(self) -> int:
        if len(self.held):
            self._chunk(self.held)
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 3), np.int64)
        footer = []
        for x in (np.array(self.chunks, "<i8"), np.array(self.planes, "<i8"), docs.astype("<i8")):
            data = self.zstd.compress(x.tobytes())
            footer += [self.at, len(data)]
            self._put(data)
        self._put(np.array([*footer, self.ids, self.kind], "<i8").tobytes())
        return self.ids


class IdReader:
    """Reads a file that IdWriter wrote; ``read(a, b)`` touches only the chunks it needs."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        if source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids")
        *at, self.n_ids, self.kind = np.frombuffer(source.read_at(64, size - 64), "<i8")
        part = lambda i, w: np.frombuffer(self.zstd.decompress(source.read_at(int(at[i + 1]), int(at[i]))), "<i8").reshape(-1, w)
        self.chunks, self.planes, self.docs = part(0, 4), part(2, 2), part(4, 3)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def chunk(self, i: int) -> np.ndarray:
        if self.kept[0] != i:
            _, n, planes, first = map(int, self.chunks[i])
            data = [self.zstd.decompress(self.source.read_at(int(le), int(o))) for o, le in self.planes[first : first + planes]]
            self.kept = (i, from_planes(data, n, int(self.kind)))
        return self.kept[1]

    def read(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.chunks[:, 0], a, "right")) - 1
        last = int(np.searchsorted(self.chunks[:, 0], b, "left")) - 1
        ids = np.concatenate([self.chunk(i) for i in range(first, last + 1)])
        at = int(self.chunks[first, 0])
        return ids[a - at : b - at]


def write_id_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, chunk_ids: int = 1 << 16, kind: int = 8, level: int = 1
) -> DataFrame:
    """Files of ids in ascending doc_id order (nulls first) under ``path``; gives the manifest: file
    (part), path, n_docs, n_ids, and ``before``, the ids in all files before it.

    One shuffle by ranges of doc_id. A file's name carries the attempt that wrote it and
    the manifest, a row a file, names the attempts that ended: a repeated task writes
    beside what a lost one left and nothing is renamed. A text longer than a piece (1 MB)
    is encoded by itself; chunks of ids do not follow texts.

    Defined results: a null or empty text has only the end id; equal doc_ids are
    ordered by text; an empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    parts = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, n_docs, writer = f"ids-{part:06d}-{attempt}.ids", 0, None
        for batch, ids, offsets in encoded(batches, tokenizer, end_id):
            if writer is None:
                out = store.open_output_stream(f"{root}/{name}")
                writer = IdWriter(out, chunk_ids, kind, level)
            key = batch.column(0)
            writer.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), ids)
            n_docs += batch.num_rows
        if writer is not None:
            n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    files = stored(
        parts.sortWithinPartitions("doc_id", "text").mapInArrow(write, "part long, name string, n_docs long, n_ids long"), "id-manifest"
    )
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "part",
        F.concat(F.lit(f"{path}/"), "name").alias("path"),
        "n_docs",
        "n_ids",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"),
    )


def read_id_digests(manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 for each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = IdReader(source)
                    offsets = np.concatenate(([0], np.cumsum(reader.docs[:, 2])))
                    step = 2000
                    for i in range(0, len(reader.docs), step):
                        own = reader.docs[i : i + step]
                        cut = offsets[i : i + len(own) + 1]
                        ids = reader.read(int(cut[0]), int(cut[-1]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(own[:, 0], pa.int64(), mask=own[:, 1] == 1),
                                pa.array(cut[:-1] + before),
                                pa.array(own[:, 2]),
                                pa.array(crc32s(ids, cut - cut[0])),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # A file a task: the manifest is a few rows, the files behind them are not.
    spread = manifest.select("path", "before").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


# --- packing --------------------------------------------------------------------------


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, tag: str = "pack") -> DataFrame:
    """Concatenate and cut: all documents' ids end to end, cut every ``window`` ids.

    First pass: ids are encoded once and stored with the partition they came from and
    the ids before them in it; the second adds up partition totals to global offsets
    (a row a partition) and cuts each document at the window borders, one record for
    each piece. No shuffle; the order is that of the stored partitions.

    Only the last sequence is shorter than the window. Defined results: a null or empty
    text is one piece with the end id; repeated rows are packed each; an empty table
    gives no pieces.
    """
    schema = "doc_id long, part long, place long, ids binary, doc_tokens long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch, ids, cut in encoded(batches, tokenizer, end_id):
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, part)),
                    pa.array(cut[:-1] + place),
                    pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array(np.diff(cut)),
                ],
                names=["doc_id", "part", "place", "ids", "doc_tokens"],
            )
            place += int(cut[-1])

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema), f"{tag}-ids")
    totals = first.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), f"{tag}-offsets")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column(1).to_numpy()
            size = batch.column(3).to_numpy()
            n = np.where(size > 0, (start + size - 1) // window - start // window + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            seq = start[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo = np.maximum(start[row], seq * window)
            hi = np.minimum(start[row] + size[row], (seq + 1) * window)
            ids = batch.column(2)
            data = memoryview(ids.buffers()[2])
            own = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            a, b = own[row] + 4 * (lo - start[row]), own[row] + 4 * (hi - start[row])
            crc = np.array([zlib.crc32(data[x:y]) for x, y in zip(a, b, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(lo - start[row]),
                    pa.array(hi - lo),
                    pa.array(crc),
                    pa.array(size[row]),
                    pa.array(seq),
                    pa.array(lo - seq * window),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    # A row a partition of the first pass: as many as tasks, whatever the data's size.
    placed = first.join(F.broadcast(offsets), first["part"] == offsets["_part"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("at"), "ids", "doc_tokens"
    )
    return placed.mapInArrow(
        cut_up,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def id_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0, kind: int = 8) -> DataFrame:
    """Writes the id files to the shared folder and gives the digests read back from them."""
    path = scratch(docs.sparkSession, "id-files")
    return read_id_digests(write_id_files(docs, path, tokenizer, end_id, kind=kind))
