"""Classifier, fingerprints, vectors and rollups."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, quality, rollups, sampling, vectors

from . import awkward


def test_linear_time_form_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32))
    number, value, cut = np.array([0, 3, 5, 8, 2, 2]), rng.normal(size=6).astype(np.float32), np.array([0, 4, 6])
    for row in range(2):
        i, x = number[cut[row] : cut[row + 1]], value[cut[row] : cut[row + 1]]
        pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert m.margin(number, value, cut)[row] == pytest.approx(0.3 + float(m.linear[i] @ x) + pairs, abs=1e-4)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    got = quality.quality_scores(docs.select("doc_id", "text", "n_chars"), labels)
    one = got.filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = one[one.quality == 1].score.to_numpy(), one[one.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.6


def test_quality_of_awkward_rows(spark):
    docs = awkward.frame(spark)
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.quality_scores(awkward.empty(spark), labels).count() == 0


def test_fingerprints(spark):
    docs = awkward.frame(spark)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = {}
    for r in sampling.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    prints, errors = {}, []
    for i, r in enumerate(rows):
        text, follow = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + follow[:half]
        own = [g for g in got[r.doc_id] if g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()]
        assert own and own[0].n_chars == len(text)
        assert prints.setdefault(tuple(sorted(Counter(text.split()).items())), own[0].fingerprint) == own[0].fingerprint
        a, b = Counter(text.split()), Counter(changed.split())
        union = sum((a | b).values())
        errors.append(own[0].near_edited - (sum((a & b).values()) / union if union else 1.0))
    assert abs(np.mean(errors)) < 0.05 and np.max(np.abs(errors)) < 0.45
    assert sampling.fingerprints(awkward.empty(spark)).count() == 0
    alone = sampling.fingerprints(docs.filter("doc_id = 204")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def brute_vectors(rows, least=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    units = [unit(r.embedding) if r.label is not None and r.vec_id is not None else None for r in rows]
    links, label = [0] * len(rows), [r.vec_id for r in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i].label == rows[j].label and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    for _ in range(len(rows)):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return sorted((str(r.vec_id), links[i], str(label[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [5, 4096])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 12))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=12) * rng.choice([0, 0.02, 0.15])], int(i % 3)) for i in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [None, *[1.0] * 11], 1), (304, [float("nan")] * 12, 1), (305, [1.0] * 12, None), (306, [1.0] * 3, 1), (307, [1.0, 1.0, 1.001], 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.selectExpr("*", "vec_id as node", "'x' as raw", "1 as home", "2 as copies", "3 as list", "4 as id")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.near_vectors(df, block=block, fit_rows=128).collect())
    assert got == brute_vectors(df.collect())
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_rollup_is_idempotent(spark):
    docs = awkward.frame(spark)
    roll, counts = rollups.Rollup(spark), rollups.token_counts(docs)
    assert roll.totals().count() == 0
    assert roll.commit("a", rollups.signed(counts, F.lit(1))) and not roll.commit("a", rollups.signed(counts, F.lit(1)))
    want = Counter()
    for r in docs.collect():
        want[r.source, r.lang] += len((r.text or "").split())
    one = roll.totals().filter("tokenizer = 'words-1'").collect()
    assert {(r.source, r.lang): r.n_tokens for r in one if r.n_tokens} == {k: v for k, v in want.items() if v}
    assert sum(r.n_docs for r in one) == docs.count()
    assert roll.commit("b", rollups.signed(counts, F.lit(-1))) and roll.totals().count() == 0
    assert roll.commit("none", rollups.signed(counts.limit(0), F.lit(1))) and roll.version() == 3
