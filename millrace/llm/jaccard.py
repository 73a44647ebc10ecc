"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of word 5-grams (a shorter text: one gram of all its
   words). Texts with equal sets form a class; only classes are compared.
2. MinHash signatures, cut into bands whose number and rows are chosen for a target
   recall at the threshold; classes are shuffled on band hashes. A bucket gives star
   edges to its smallest member, never all pairs.
3. Candidate classes that hang together are compared on their full sets, inside tasks,
   as blocks of a bounded number of classes against one another; a task gives link
   counts and a spanning forest of its links, not the pairs. A large group is cut into
   blocks by hash and each pair of blocks is a group of its own.
4. Components of the forests.

Two classes in one candidate group are linked whenever their Jaccard is at or over the
threshold, also where their signatures shared no band.

Defined results: texts without words link with nothing; rows with a null doc_id are
returned without links; repeated rows are members of the same class; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.llm.components import components, link_report
from millrace.session import shuffle_partitions, stored

#: Rows up to which a table of two or three integers is broadcast (about 10 MB).
BROADCAST_ROWS = 300_000


def bands_for(threshold: float = 0.8, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands enough for the recall need ``most`` hashes at most."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def gram_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text in ascending order, one text after another, and offsets."""
    hashes, cut = arrays.word_hashes(*arrays.text_bytes(column))
    docs = len(cut) - 1
    owner = np.repeat(np.arange(docs), np.diff(cut))
    gram = arrays.windows_hash(hashes, n)
    whole = arrays.whole_windows(cut, n)
    short = np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < n))
    gram = np.concatenate((gram[whole], arrays.spans_hash(hashes, cut[short], cut[short + 1])))
    owner = np.concatenate((owner[: len(whole)][whole], short))
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[fresh], np.concatenate(([0], np.cumsum(np.bincount(owner[fresh], minlength=docs))))


def set_keys(gram: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set (as int64)."""
    total = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(arrays.mixed(gram ^ arrays.U(0x5851F42D4C957F2D)), out=total[1:])
    return arrays.mixed(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64)


def band_hashes(gram: np.ndarray, cut: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """For each set (none of them empty) a hash for each band, as int64."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(cut) - 1, bands), np.uint64)
    for b in range(bands):
        for _ in range(rows):
            flip, odd = (arrays.U(x) for x in rng.integers(1, 1 << 63, 2, dtype=np.uint64))
            least = np.minimum.reduceat((gram ^ flip) * (odd | arrays.U(1)), cut[:-1])
            out[:, b] = arrays.mixed(out[:, b] * arrays.BASE + least)
        out[:, b] = arrays.mixed(out[:, b] + arrays.U(b + 1))
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (its set's number; null without words), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            gram, cut = gram_sets(batch.column(1), n)
            full = np.flatnonzero(np.diff(cut) > 0)
            packed = np.concatenate((cut[full], cut[-1:]))
            hashes = band_hashes(gram, packed, bands, rows) if len(full) else np.zeros((0, bands), np.int64)
            node, empty = np.zeros(len(cut) - 1, np.int64), np.ones(len(cut) - 1, bool)
            node[full], empty[full] = set_keys(gram, packed), False
            lists = np.zeros(len(cut), np.int32)
            lists[1:] = np.cumsum(~empty) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, mask=empty), pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes.reshape(-1)))],
                names=["doc_id", "node", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, node long, bands array<long>")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the (stored) table has ``rows`` rows at most; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def linked(gram: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, columns: int = 8192) -> np.ndarray:
    """Which of the sets ``left`` and ``right`` (row numbers) have a Jaccard at or over the threshold."""
    sizes = np.array([len(g) for g in gram], np.float64)
    owner = np.repeat(np.arange(len(gram)), sizes.astype(np.int64))
    _, at, count = np.unique(np.concatenate(gram), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(at, (c, c + columns))
        m = np.zeros((len(gram), columns), np.float32)
        m[owner[a:b], at[a:b] - c] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * union - 1e-9


def roots(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component in a symmetric matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(label)).min(axis=1, initial=len(label))
        fresh = np.minimum(label, near)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return label
        label = fresh


def block_links(rows: list[tuple], n: int, threshold: float) -> tuple[list, list, list]:
    """Rows (node, block, copies, text) of one pair of blocks: link counts by node, forest edges.

    Gives columns a, b, links: (node, null, count) or (node, root, null).
    """
    node = np.array([r[0] for r in rows], np.int64)
    block = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    gram, cut = gram_sets(pa.array([r[3] for r in rows], pa.string()), n)
    # A doc_id that occurs more than once also brings texts of other classes, or one twice.
    mine = np.flatnonzero((set_keys(gram, cut) == node) & (np.diff(cut) > 0))
    mine = mine[np.unique(node[mine], return_index=True)[1]]
    node, block, copies = node[mine], block[mine], copies[mine]
    gram = [gram[cut[i] : cut[i + 1]] for i in mine]
    if len(gram) < 2:
        return [], [], []
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    hit = linked(gram, left, right, threshold)
    if block.min() == block.max():
        np.fill_diagonal(hit, False)
        whole = hit
        count = hit @ copies
    else:
        whole = np.zeros((len(node), len(node)), bool)
        whole[np.ix_(left, right)], whole[np.ix_(right, left)] = hit, hit.T
        count = np.zeros(len(node), np.int64)
        count[left], count[right] = hit @ copies[right], hit.T @ copies[left]
    root = roots(whole)
    own, tree = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
    a = np.concatenate((node[own], node[tree]))
    b = [None] * len(own) + node[root[tree]].tolist()
    return a.tolist(), b, count[own].tolist() + [None] * len(tree)


def verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """members: comp, bi, bj, node, block, copies, text; a group (comp, bi, bj) is a pair of blocks."""
    keys = ("comp", "bi", "bj")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], ([], [], [])

        def flush() -> None:
            if len(rows) > 1:
                for all_, new in zip(out, block_links(rows, n, threshold), strict=True):
                    all_.extend(new)

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "links"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            c = batch.to_pydict()
            for k, row in zip(zip(c["comp"], c["bi"], c["bj"], strict=True), zip(c["node"], c["block"], c["copies"], c["text"], strict=True), strict=True):
                if k != key:
                    flush()
                    key, rows = k, []
                rows.append(row)
            if out[0]:
                yield batch_out()
        flush()
        yield batch_out()

    parts = members.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(check, "a long, b long, links long")


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 512, tag: str = "jaccard"
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its linked group), n_links (other documents linked
    directly), text_class_id (smallest doc_id with the same n-gram set), kept (doc_id = class_id)."""
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, n, bands, rows), f"{tag}-signatures")
    classes = stored(
        signed.filter("node is not null and doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")),
        f"{tag}-classes",
    )
    in_band = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = in_band.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = in_band.join(hubs.select(F.col("bucket").alias("_b"), "hub"), F.col("bucket") == F.col("_b")).select(
        F.col("node").alias("a"), F.col("hub").alias("b")
    )
    groups = stored(components(edges, f"{tag}-candidates"), f"{tag}-groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    members = stored(
        groups.join(sizes.withColumnRenamed("root", "comp"), F.col("root") == F.col("comp"))
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .join(classes.select(F.col("node").alias("_n"), "first_doc", "copies"), F.col("node") == F.col("_n"))
        .select("comp", "blocks", "block", "node", "first_doc", "copies"),
        f"{tag}-members",
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small(members), F.col("doc_id") == F.col("first_doc"))
    pairs = texts.select(
        "comp",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_j"),
        "node",
        "block",
        "copies",
        "text",
    ).select("comp", F.least("block", "_j").alias("bi"), F.greatest("block", "_j").alias("bj"), "node", "block", "copies", "text")
    found = stored(verified(pairs, n, threshold), f"{tag}-links")
    report = link_report(
        signed.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")),
        classes.withColumnRenamed("first_doc", "first_id"),
        found,
        tag,
    )
    return report.select(
        F.col("id").alias("doc_id"),
        F.col("component_id").alias("class_id"),
        "n_links",
        F.col("first_id").alias("text_class_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
