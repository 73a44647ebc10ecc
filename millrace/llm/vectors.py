"""Near-duplicate embeddings by product quantisation.

1. Equal vectors with one label form a class; classes are compared, never copies.
2. Coarse centroids (their number grows with the square root of the classes) and the
   codebooks of residual subspaces are fitted on a bounded sample (``fit_rows``); every
   class is indexed: its inverted list, its residual's codes, and the length of what the
   codes miss.
3. Two partners lie within ``reach`` (the distance at the cosine threshold) of one
   another. If their cells differ, the border between these lies between them, so one of
   the two is within half of ``reach`` of it. A class is sent as a query to its own list
   and to each list whose border is that near: for each pair one side asks the other, and
   no link is lost.
4. In a list, table look-ups give the distance from the query to each coded item; an
   item stays if that is at most ``reach`` plus the item's coding error, again without
   loss. What stays is checked by cosine in double precision. A link counts for the
   query; it counts for the item too where the item's probes do not hold the query's list.
5. Tasks give link counts and spanning forests; components are found over these.

A long list is cut into blocks of items that are searched apart. Vectors travel in the
type they came in (four bytes a component for floats).

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component, and rows with a null label or vec_id, link with nothing; vectors of
different length never link; repeated rows are copies of one class; columns other than
vec_id, embedding and label are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import link_report
from millrace.session import shuffle_partitions, stored

EPS = 1e-6


@dataclass
class Index:
    """Coarse centroids, the dimensions of each subspace, and a codebook for each."""

    centroids: np.ndarray
    spaces: list[np.ndarray]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, coding error, and the lists to probe: the own one and those whose border is within ``near``."""
        far = distances(x, self.centroids)
        own = far.argmin(axis=1)
        apart = np.sqrt(distances(self.centroids[own], self.centroids))
        border = far - far[np.arange(len(own)), own][:, None] <= 2 * apart * (near + EPS)
        border[np.arange(len(own)), own] = True
        rest = x - self.centroids[own]
        codes, missed = np.zeros((len(x), len(self.spaces)), np.uint8), np.zeros(len(x))
        for j, (dims, book) in enumerate(zip(self.spaces, self.books, strict=True)):
            d = distances(rest[:, dims], book)
            codes[:, j] = d.argmin(axis=1)
            missed += d.min(axis=1)
        return own, codes, np.sqrt(missed), [np.flatnonzero(p) for p in border]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in portions of bounded size."""
    step = portion(len(c))
    return np.concatenate([distances(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)])


def portion(cells: int) -> int:
    """Rows whose distances to all centroids fill some 32 MB."""
    return max(16, (1 << 22) // cells)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c[n > 0] = sums / n[n > 0][:, None]
    return c


def unit_rows(raw: list[bytes], width: int, kind: str) -> np.ndarray:
    """Vectors of type ``kind`` (<f4 or <f8) as double-precision rows of length 1, filled up with zeros."""
    x = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, kind)
        x[i, : len(v)] = v
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_index(classes: DataFrame, n: int, width: int, kind: str, fit_rows: int = 32768, subspaces: int = 8, codes: int = 64) -> Index:
    """Fits on at most ``fit_rows`` of the ``n`` classes, picked by hash: 4 sqrt(n) cells, and no more than a
    quarter of the rows (8,192)."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("raw").toArrow()["raw"].to_pylist()
    if not sample:
        return Index(np.zeros((1, max(width, 1))), [], [])
    x = unit_rows(sample, width, kind)
    centroids = k_means(x, max(1, min(int(4 * np.sqrt(n)), len(x) // 4)))
    rest = x - centroids[nearest(x, centroids)]
    spaces = [s for s in np.array_split(np.arange(width), subspaces) if len(s)]
    return Index(centroids, spaces, [k_means(rest[:, s], min(codes, len(x))) for s in spaces])


def prepared(vectors: DataFrame, kind: str, seed: int) -> DataFrame:
    """vec_id, node (null: links with nothing), label, dim, raw (of type ``kind``)."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, labels = batch.column(0), batch.column(1), batch.column(2)
            node, dim, raw = [], [], []
            flat = lists.values.cast(pa.float64())
            hole = flat.is_null().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
            edges = lists.offsets.to_numpy()
            bad = lists.is_null().to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False) | labels.is_null().to_numpy(zero_copy_only=False)
            for i, label in enumerate(labels.to_pylist()):
                v = flat[edges[i] : edges[i + 1]] + 0.0
                fine = not bad[i] and len(v) and not hole[edges[i] : edges[i + 1]].any() and np.isfinite(v).all() and v.any()
                if fine and kind == "<f8":
                    v = v / np.abs(v).max()  # lengths neither overflow nor vanish
                data = v.astype(kind).tobytes() if fine else None
                raw.append(data)
                dim.append(len(v) if fine else None)
                node.append(xxhash.xxh3_64_intdigest(data + label.to_bytes(8, "little", signed=True), seed=seed) - (1 << 63) if fine else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(node, pa.int64()), labels, pa.array(dim, pa.int32()), pa.array(raw, pa.binary())],
                names=["vec_id", "node", "label", "dim", "raw"],
            )

    width = "float" if kind == "<f4" else "double"
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{width}>"), F.col("label").cast("long"))
    return plain.mapInArrow(clean, "vec_id long, node long, label long, dim int, raw binary")


def vector_classes(vectors: DataFrame, kind: str, tag: str) -> tuple[DataFrame, DataFrame, int, int]:
    """The prepared rows; one row for each different vector of a label; their number and greatest width.

    Vectors are told apart by a 64-bit hash; were two different ones to share it, the rows are hashed anew.
    """
    for seed in range(8):
        rows = stored(prepared(vectors, kind, seed), f"{tag}-rows")
        own = F.struct("label", "raw")
        classes = stored(
            rows.filter("node is not null")
            .groupBy("node")
            .agg(
                F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("dim").alias("dim"),
                F.min(own).alias("own"), (F.min(own) != F.max(own)).alias("clash"),
            )
            .select("node", "first_id", "copies", "dim", "own.label", "own.raw", "clash"),
            f"{tag}-classes",
        )
        n, width, clash = classes.agg(F.count(F.lit(1)), F.max("dim"), F.max("clash")).first()
        if not clash:
            return rows, classes.drop("clash"), n, width or 0
    raise RuntimeError("different vectors shared a hash eight times")


def pair_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the smallest point of its component over pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


class Block:
    """The items of one block of a list, ready to be searched."""

    def __init__(self, index: Index, list_id: int, width: int, kind: str, rows: list[dict]) -> None:
        self.index, self.list_id, self.width, self.kind = index, list_id, width, kind
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.copies = np.array([r["copies"] for r in rows], np.int64)
        self.missed = np.array([r["missed"] for r in rows])
        self.codes = np.frombuffer(b"".join(r["codes"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.x = unit_rows([r["raw"] for r in rows], width, kind)
        sizes = [len(r["probes"]) for r in rows]
        self.asks = np.repeat(np.arange(len(rows)), sizes) * len(index.centroids) + np.concatenate([r["probes"] for r in rows]).astype(np.int64)

    def search(self, rows: list[dict], reach: float, threshold: float) -> Iterator[tuple]:
        """(a, b, links) for some queries: link counts (b null) of both sides, and forest edges."""
        q = unit_rows([r["raw"] for r in rows], self.width, self.kind)
        own = np.array([r["node"] for r in rows], np.int64)
        copies = np.array([r["copies"] for r in rows], np.int64)
        home = np.array([r["home"] for r in rows], np.int64)
        rest = q - self.index.centroids[self.list_id]
        adc = np.zeros((len(q), len(self.x)))
        for j, (dims, book) in enumerate(zip(self.index.spaces, self.index.books, strict=True)):
            adc += distances(rest[:, dims], book)[:, self.codes[:, j]]
        i, j = np.nonzero(np.sqrt(adc) <= reach + self.missed[None, :] + EPS)
        keep = own[i] != self.node[j]
        i, j = i[keep], j[keep]
        hit = np.zeros(len(i), bool)
        for c in range(0, len(i), 1 << 16):
            hit[c : c + (1 << 16)] = (q[i[c : c + (1 << 16)]] * self.x[j[c : c + (1 << 16)]]).sum(axis=1) >= threshold
        i, j = i[hit], j[hit]
        if not len(i):
            return
        # Inside a list both sides ask; from another list the item may not ask back.
        back = (home[i] != self.list_id) & ~np.isin(j * len(self.index.centroids) + home[i], self.asks)
        nodes = np.concatenate((own, self.node))
        count = np.concatenate((np.bincount(i, self.copies[j], len(q)), np.bincount(j[back], copies[i[back]], len(self.x)))).astype(np.int64)
        for k in np.flatnonzero(count):
            yield int(nodes[k]), None, int(count[k])
        root = pair_roots(i, j + len(q), len(nodes))
        for k in np.flatnonzero(root != np.arange(len(root))):
            yield int(nodes[k]), int(nodes[root[k]]), None


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 4096, fit_rows: int = 32768, tag: str = "pq") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows, classes, n, width = vector_classes(vectors, kind, tag)
    index = fit_index(classes, n, width, kind, fit_rows)
    model = spark.sparkContext.broadcast(index)  # bounded: a quarter of fit_rows centroids and 8 books of 64
    reach = float(np.sqrt(2 - 2 * threshold))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = model.value
        step = portion(len(index_.centroids))
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("raw"))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, codes, missed, lists = index_.encode(unit_rows(raw.slice(at, step).to_pylist(), width, kind), reach / 2)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), pa.array(lists, pa.list_(pa.int32()))],
                    names=[*part.schema.names, "list", "codes", "missed", "probes"],
                )

    coded = stored(
        classes.select("node", "copies", "label", "dim", "raw").mapInArrow(
            code, "node long, copies long, label long, dim int, raw binary, list int, codes binary, missed double, probes array<int>"
        ),
        f"{tag}-coded",
    )
    group = ["label", "dim", "list"]
    sizes = coded.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = stored(sizes.select(*[F.col(c).alias(f"_{c}") for c in group], "blocks"), f"{tag}-lists")
    at_list = lambda c: (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col(c) == F.col("_list"))
    items = coded.join(sizes, at_list("list")).select(
        *group, F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "node", "copies", "raw", "codes", "missed", "probes",
        F.lit(None).cast("int").alias("home"),
    )
    asked = coded.select("label", "dim", F.explode("probes").alias("probe"), "node", "copies", "raw", F.col("list").alias("home"))
    queries = asked.join(sizes, at_list("probe")).select(
        "label", "dim", F.col("probe").alias("list"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        "node", "copies", "raw", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("missed"),
        F.lit(None).cast("array<int>").alias("probes"), "home",
    )
    keys = [*group, "block"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after another, items before queries; queries are searched in portions."""
        key, items_, asked_, out = None, [], [], []
        found_block: list[Block] = []

        def run() -> None:
            if items_ and asked_:
                if not found_block:
                    found_block.append(Block(model.value, key[2], width, kind, items_))
                for i in range(0, len(asked_), 512):
                    out.extend(found_block[0].search(asked_[i : i + 512], reach, threshold))
            asked_.clear()

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "b", "links"])

        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[x] for x in keys)
                if k != key:
                    run()
                    key = k
                    items_.clear()
                    found_block.clear()
                if row["kind"] == 0:
                    items_.append(row)
                else:
                    asked_.append(row)
                    if len(asked_) >= 2048:
                        run()
            yield made()
        run()
        yield made()

    both = items.unionByName(queries).repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "kind")
    found = stored(both.mapInArrow(look, "a long, b long, links long"), f"{tag}-links")
    report = link_report(rows.select(F.col("vec_id").alias("id"), "node"), classes, found, tag)
    return report.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
