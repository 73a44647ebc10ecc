"""Documents packed into chunks of text that several passes read again by one key.

A chunk is a row: the documents' ids, byte borders, other columns, and their texts as
one compressed body. The table is bucketed by ``home`` (a few homes for each task that
wrote it), so that a pass which joins small facts to the chunks moves the facts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.session import scratch, shuffle_partitions

HOMES = 4
COLUMNS = "home long, chunk long, ids array<long>, cuts array<int>, body binary"


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunk_table(docs: DataFrame, tag: str, keep: tuple[str, ...] = (), most: int = 1 << 20) -> DataFrame:
    """Packs doc_id, text and the columns in ``keep`` (as ``rest``) into chunks of about ``most`` bytes."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), "text", *[f"`{k}`" for k in keep])
    rest = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in plain.schema[2:])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal seq
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = arrays.text_bytes(t.column(1))
            one = pa.array([0, t.num_rows], pa.int32())
            cols = [
                pa.array([part * HOMES + seq % HOMES]),
                pa.array([(part << 32) + seq]),
                pa.ListArray.from_arrays(one, t.column(0)),
                pa.array([offsets.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([squeezed(data.tobytes())], pa.binary()),
            ]
            if keep:
                cols.append(pa.ListArray.from_arrays(one, pa.StructArray.from_arrays(t.columns[2:], names=list(keep))))
            seq += 1
            return pa.RecordBatch.from_arrays(cols, names=["home", "chunk", "ids", "cuts", "body", "rest"][: len(cols)])

        for batch in arrays.pieces(batches, most=most):
            held.append(batch)
            size += len(arrays.text_bytes(batch.column(1))[0])
            if size >= most // 2:
                yield row()
                held, size = [], 0
        if held:
            yield row()

    schema = COLUMNS + (f", rest array<struct<{rest}>>" if keep else "")
    return bucketed(plain.mapInArrow(pack, schema), tag)


def bucketed(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` as a stored table bucketed by ``home``."""
    spark = rows.sparkSession
    name = f"millrace_{tag}_{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "none").option("path", scratch(spark, tag))
    writer.bucketBy(shuffle_partitions(spark), "home").saveAsTable(name)
    return spark.table(name)


def with_facts(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks with ``facts``: all rows (chunk, part, data) of their home; only the facts are shuffled."""
    by_home = facts.groupBy(F.col("home").alias("_home")).agg(F.collect_list(F.struct("chunk", "part", "data")).alias("facts"))
    joined = chunks.join(by_home.hint("shuffle_hash"), F.col("home") == F.col("_home"), "left")
    return joined.drop("_home")


class Chunk:
    """A chunk row inside a task."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.home, self.number = get("home")[i].as_py(), get("chunk")[i].as_py()
        self.ids = get("ids")[i].values
        self.data = np.frombuffer(opened(get("body")[i].as_py()), np.uint8)
        self.offsets = get("cuts")[i].values.to_numpy().astype(np.int64)
        self.rest = get("rest")[i].values if "rest" in batch.schema.names else None
        self.facts = facts_of(batch, i, self.number)

    @property
    def order(self) -> np.ndarray:
        """doc_id of each document as a number to compare by; null is above all."""
        return self.ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def chunks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch, i)
        arrays.release()


def facts_of(batch: pa.RecordBatch, i: int, number: int) -> dict[int, bytes]:
    """Data by part of the facts of row i that are the chunk's own."""
    at = batch.schema.get_field_index("facts")
    if at < 0 or not batch.column(at)[i].is_valid:
        return {}
    own = batch.column(at)[i].values
    mine = np.flatnonzero(own.field("chunk").to_numpy() == number)
    return {own.field("part")[int(k)].as_py(): own.field("data")[int(k)].as_py() for k in mine}


FACTS = "home long, chunk long, part int, data binary"


def fact_batch(rows: list[tuple]) -> pa.RecordBatch:
    home, chunk, part, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(home, pa.int64()), pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())],
        names=["home", "chunk", "part", "data"],
    )


def dealt(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts distinct hashes by part and value: the sorted values and the parts' borders."""
    part = (values % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((values, part))
    return values[order], np.searchsorted(part[order], np.arange(parts + 1))


def repeated_values(sent: DataFrame) -> DataFrame:
    """sent: facts whose data are distinct uint64 values, sorted. Gives facts whose data are packed bits:
    which of the values came from more than one chunk.

    A part holds about 1 / parts of all distinct values; hashes deal them evenly,
    and a value comes once from a chunk, however often it stands there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True)]
        values = [np.frombuffer(r[3], np.uint64) for r in rows]
        cut = np.cumsum([0] + [len(v) for v in values])
        _, back, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        hit = (n > 1)[back]
        yield fact_batch([(*r[:3], np.packbits(hit[a:b]).tobytes()) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)])

    return sent.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(count(t.to_batches())), FACTS)
