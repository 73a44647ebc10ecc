"""Substring, near-duplicate and repeated-byte operators against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import components, induced, jaccard, suffix_arrays, suffix_trees

from . import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, window=13):
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    words = [WORD.findall(r.text or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, order(r)), order(r))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < order(r):
                gone[j : j + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_substrings(spark, chunk):
    docs = awkward.frame(spark)
    got = suffix_trees.substring_digests(docs, chunk_bytes=chunk).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(docs.collect())


def test_substring_texts(spark):
    docs = awkward.frame(spark)
    out = suffix_trees.substring_dedup(docs, ("lang", "node", "score"), chunk_bytes=500)
    want = {(d, s) for d, _, _, s in brute_substrings(docs.collect())}
    got = {(str(r.doc_id), hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest()) for r in out.collect()}
    assert got == want and out.columns == ["doc_id", "text", "lang", "node", "score"]


def test_many_copies_in_many_groups(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(i, text + (f" tail{i}" if i % 2 else ""), "en", "a", 1, 0.0, 1, "", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, awkward.SCHEMA).repartition(5)
    got = suffix_trees.substring_digests(docs, chunk_bytes=400).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(docs.collect())


def test_suffix_tree_parts():
    counts = [(1, 5, 100), (1, 9, 4), (2, 5 << 12 | 7, 90), (2, 5 << 12 | 8, 10)]
    borders = suffix_trees.prefix_borders(counts, 10)
    assert borders[0] == 0 and len(borders) > 1 and (np.diff(borders) > 0).all()
    context = np.array([[1, 2], [1, 2], [1, 3], [2, 2]], np.uint32)
    assert suffix_trees.deep_nodes(context, 2).tolist() == [0, 2, 3] and suffix_trees.deep_nodes(context, 1).tolist() == [0, 3]
    mixed = np.random.default_rng(1).integers(0, 4, (50, 5)).astype(np.uint32)
    assert mixed[suffix_trees.ordered(mixed)].tolist() == sorted(mixed.tolist())


def prefix(t, a, b):
    k = 0
    while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("base", [3, 1 << 20])
@pytest.mark.parametrize("memory", [50, 1 << 20])
def test_induced_sorting(base, memory):
    rng = np.random.default_rng(2)
    for trial in range(60):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 90)).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 7)], 8)
        sa, lcp = induced.suffix_array(t, 60000, memory, base)
        data = t.tobytes()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: data[i:])  # noqa: B023
        assert lcp.tolist() == [0] + [prefix(data, a, b) for a, b in zip(sa[:-1], sa[1:], strict=True)]


def brute_bytes(rows, length):
    texts = [(r.text or "").encode() for r in rows]
    seen = {}
    for t in texts:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]] = seen.get(t[j : j + length], 0) + 1
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        out.append((str(r.doc_id), len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram", "chunk"), [(40, 8, 700), (40, 40, 1 << 20), (400, 48, 3000)])
def test_repeated_bytes(spark, length, gram, chunk):
    docs = awkward.frame(spark)
    got = suffix_arrays.repeated_byte_digests(docs, length, gram, memory=2000, base=200, chunk_bytes=chunk).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(docs.collect(), length)


def brute_near(rows, n=5, least=0.8):
    sets = []
    for r in rows:
        w = WORD.findall(r.text or "")
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    ok = [i for i, r in enumerate(rows) if r.doc_id is not None and sets[i]]
    links, label = [0] * len(rows), {i: i for i in range(len(rows))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(ok, 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(rows)):
        k = root(i)
        best[k] = min(best.get(k, rows[i].doc_id), rows[i].doc_id) if rows[i].doc_id is not None else None
    return sorted((str(r.doc_id), links[i], str(best[root(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates(spark, block):
    docs = awkward.frame(spark)
    got = jaccard.near_duplicates(docs, block=block).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in got) == brute_near(docs.collect())


def test_a_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", 1, 0.0, 1, "", 0))
    docs = spark.createDataFrame(rows, awkward.SCHEMA).repartition(4)
    got = jaccard.near_duplicates(docs, block=16).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in got) == brute_near(docs.collect())


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {k: v for k, v in label.items() if k in got}
    assert {x for p in pairs if p[0] != p[1] for x in p} == set(got)


def test_empty(spark):
    none = awkward.empty(spark)
    assert suffix_trees.substring_digests(none).count() == 0
    assert suffix_arrays.repeated_byte_digests(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0


def test_a_chunk_without_repeats(spark):
    rows = [(i, f"{i} " + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(120)), "en", "a", 1, 0.0, 1, "", 0) for i in range(30)]
    rows += [(100 + i, "same " * 30, "en", "a", 1, 0.0, 1, "", 0) for i in range(2)]
    docs = spark.createDataFrame(rows, awkward.SCHEMA).repartition(3)
    got = suffix_arrays.repeated_byte_digests(docs, 100, 20, chunk_bytes=200).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(docs.collect(), 100)


def test_plans_of_rounds_stay_small(spark, monkeypatch):
    """No stored step of the components contains the plan of the step before it several times."""
    from millrace.llm import components as stars

    joins, write = [], stars.stored

    def counted(df, tag):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, tag)

    monkeypatch.setattr(stars, "stored", counted)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    got = {r.node: r.root for r in stars.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert max(joins) <= 4
