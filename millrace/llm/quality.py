"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]):
all pairwise interactions in time linear in the features. Fitted on at most
``max_rows`` labelled rows (the documented bound), picked by hash of doc_id; scoring
reads every text whole, in one pass without a shuffle.

Defined results: null and empty texts have structure features only and get a score like
any other; null labels are not learned from; of several labels of one doc_id the
smallest counts; without labels, or with labels of one kind, every score is the share
of ones (0.5 if there are none); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import arrays

BITS = 15
#: Borders of the structure statistics' bins, a row for each statistic.
SHARE = (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
COUNT = (1, 3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600)
LENGTH = (2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10, 14, 20)
UPPER, DIGIT, PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = DIGIT[48:58] = True
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True


def structure(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, tuple]]:
    """Statistics of each text with the borders of their bins."""
    docs = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    n = np.maximum(np.diff(cut), 1)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    share = lambda mask: (per(mask) / size, SHARE)
    lengths = np.concatenate(([0], np.cumsum(ends - starts)))
    owner = np.repeat(np.arange(docs), np.diff(cut))
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=docs)
    lines = per(data == 10)
    lead = UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    odd_end = PUNCT[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    by_word = lambda mask: (np.bincount(owner, mask, docs) / n, SHARE)
    short = (ends - starts) == 1
    gram = arrays.windows_hash(hashes, 4)
    whole = arrays.whole_windows(cut, 4)
    g, o = gram[whole], owner[: len(gram)][whole]
    at = np.lexsort((g, o))
    again = np.zeros(len(at), bool)
    again[1:] = (g[at][1:] == g[at][:-1]) & (o[at][1:] == o[at][:-1])
    return [
        (np.diff(cut), COUNT),
        (lines, COUNT),
        (np.diff(lengths[cut]) / n, LENGTH),
        (distinct / n, SHARE),
        share(UPPER[data]),
        share(DIGIT[data]),
        share(PUNCT[data]),
        share(data >= 128),
        share(data == ord("!")),
        share(data == ord("|")),
        share(data == ord(".")),
        (lines / n, SHARE),
        by_word(lead),
        by_word(odd_end),
        by_word(short),
        (np.bincount(o[at], again, docs) / n, SHARE),
    ]


def features(batch: pa.RecordBatch, metadata: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and offsets of a batch: each text's hashed words as damped counts of
    length 1 together, and one bin of each statistic and numeric metadata column."""
    data, offsets = arrays.text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, cut = arrays.words(data, offsets)
    hashes = arrays.spans_hash(arrays.BYTE_VALUES[data], starts, ends)
    docs = len(offsets) - 1
    key = np.repeat(np.arange(docs), np.diff(cut)) << BITS | (hashes >> arrays.U(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    owner, value = key >> BITS, np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, docs))
    value = value / norm[owner]
    stats = structure(data, offsets, starts, ends, cut, hashes)
    for name in metadata:
        x = batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
        stats.append((x / 6, COUNT))
    bins = np.stack([(1 << BITS) + 16 * i + np.searchsorted(np.array(b, float), x, "right") for i, (x, b) in enumerate(stats)], axis=1)
    owner = np.concatenate((owner, np.repeat(np.arange(docs), bins.shape[1])))
    number = np.concatenate((key & ((1 << BITS) - 1), bins.reshape(-1)))
    value = np.concatenate((value, np.full(bins.size, 1 / np.sqrt(bins.shape[1]))))
    order = np.argsort(owner, kind="stable")
    return number[order], value[order].astype(np.float32), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs))))


@dataclass
class Machine:
    """w0, the linear weights and the factors (features x rank)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, number: np.ndarray, value: np.ndarray, cut: np.ndarray) -> np.ndarray:
        if not len(cut) - 1:
            return np.zeros(0)
        vx = self.factors[number] * value[:, None]
        sums = np.add.reduceat(vx, cut[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), cut[:-1])
        return self.bias + np.add.reduceat(self.linear[number] * value, cut[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, number: np.ndarray, value: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(number, value, cut), -30, 30)))


def fitted(number: np.ndarray, value: np.ndarray, cut: np.ndarray, label: np.ndarray, width: int, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Logistic loss by AdaGrad over small batches; both labels weigh the same in sum."""
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or not 0 < share < 1:
        return Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(width, np.float32), np.zeros((width, rank), np.float32))
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    epochs = max(epochs, -(-600 * 128 // len(label)))
    m = Machine(0.0, np.zeros(width, np.float32), rng.normal(0, 0.02, (width, rank)).astype(np.float32))
    past_w, past_v = np.full(width, 1e-6, np.float32), np.full((width, rank), 1e-6, np.float32)
    sizes = np.diff(cut)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            own = arrays.ragged(cut[:-1][rows], sizes[rows])
            i, x, c = number[own], value[own], np.concatenate(([0], np.cumsum(sizes[rows])))
            g = (weight[rows] * (m.score(i, x, c) - label[rows])).astype(np.float32) / len(rows)
            each = np.repeat(g, sizes[rows]) * x
            v = m.factors[i]
            sums = np.repeat(np.add.reduceat(v * x[:, None], c[:-1], axis=0), sizes[rows], axis=0)
            u, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, each, len(u)).astype(np.float32) + decay * m.linear[u]
            gv = np.zeros((len(u), rank), np.float32)
            np.add.at(gv, back, each[:, None] * (sums - v * x[:, None]))
            gv += decay * m.factors[u]
            past_w[u] += gw * gw
            past_v[u] += gv * gv
            m.linear[u] -= rate * gw / np.sqrt(past_w[u])
            m.factors[u] -= rate * 0.3 * gv / np.sqrt(past_v[u])
            m.bias -= rate * 0.1 * float(g.sum())
    return m


def width(metadata: tuple[str, ...]) -> int:
    return (1 << BITS) + 16 * (16 + len(metadata))


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 8000, rank: int = 8) -> Machine:
    """Fits on at most ``max_rows`` rows of ``labels`` (doc_id, quality) whose texts are in ``docs``.

    The picked ids are broadcast: no more than ``max_rows``. Their features (a few kB a
    row) come to the driver, where the fit runs.
    """
    seen = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_label"))
    picked = seen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            number, value, cut = features(batch, metadata)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("_label")).cast(pa.int32()),
                    pa.array([number[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["label", "number", "value"],
            )

    chosen = docs.select("doc_id", "text", *metadata).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = (
        chosen.select("text", *metadata, "_label", "_id")
        .mapInArrow(extract, "label int, number binary, value binary")
        .toArrow()
    )
    number = np.frombuffer(b"".join(rows["number"].to_pylist()), "<i4").astype(np.int64)
    value = np.frombuffer(b"".join(rows["value"].to_pylist()), np.float32)
    sizes = np.array([len(x) // 4 for x in rows["number"].to_pylist()], np.int64)
    label = (rows["label"].to_numpy() > 0).astype(np.float32)
    # The rows come in any order; the fit must not depend on it.
    cut = np.concatenate(([0], np.cumsum(sizes)))
    if len(label):
        mark = np.add.reduceat(number * value, cut[:-1]) if len(number) else label
        order = np.lexsort((label, sizes, mark))
        number, value = (x[arrays.ragged(cut[:-1][order], sizes[order])] for x in (number, value))
        label, cut = label[order], np.concatenate(([0], np.cumsum(sizes[order])))
    return fitted(number, value, cut, label, width(metadata), rank)


def scored(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ("n_chars",), out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` (in place of one of that name); the model (some MB, fixed) is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            s = model.value.score(*features(batch, metadata))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64))], names=[*keep, out])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(score, f"{schema}, `{out}` double")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Fits on the labels outside the held-out fifth and scores every document."""
    metadata = options.get("metadata", ("n_chars",))
    machine = fit(docs, labels.filter(~held_out()), **options)
    return scored(docs, machine, metadata).select(
        "*", held_out().alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted")
    )
