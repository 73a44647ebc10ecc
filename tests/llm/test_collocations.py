"""Phrases against plain counting; filters against round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import arrays, collocations, queries
from millrace.llm import quotient_filters as qf

from . import awkward


def brute(rows, least, top=2000):
    """rows: (text, lang)."""
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in often.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) if 100 * a >= 80 * c[q := p[s : s + k]]}
        rows = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(df, **options):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in collocations.collocations(df, **options).select(*names).collect())


def corpus(seed=4, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Big", "DATA", "日本", "\x1f", "a b"]
    rows = []
    for i in range(n):
        bits = [rng.choice(words) if rng.random() < 0.7 else "New York City Hall" for _ in range(rng.choice([0, 1, 5, 40]))]
        rows.append(("".join(b + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for b in bits), ["en", None, "", "zz"][i % 4]))
    return rows + [(None, "en"), ("", "en"), ("  .,", None), ("tail " * 400, "en"), ("tail " * 400, "en")]


@pytest.mark.parametrize("chunk", [600, 8 << 20])
def test_phrases(spark, chunk):
    rows = corpus()
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "text string, lang string, id long, word string, total int").repartition(3)
    assert mined(df, least=6, top=50, chunk_bytes=chunk) == brute(rows, 6, 50)


def test_awkward_documents(spark):
    df = awkward.frame(spark)
    assert mined(df, least=3) == brute([(r.text, r.lang) for r in df.collect()], 3)
    assert mined(awkward.empty(spark)) == []
    assert mined(df.limit(2), least=10**6) == []


def test_registered_query(spark, sf_dir):
    want = brute([tuple(r) for r in queries.table(spark, sf_dir, "documents").select("text", "lang").collect()], 30)
    got = queries.op11_phrase_collocations(spark, sf_dir)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want and want


def test_scores_are_exact(spark):
    big = [(9 * 10**18 // 2, 9 * 10**18), (3, 7), (10**18 + 1, 3 * 10**18)]
    df = spark.createDataFrame(big, "a long, both long")
    assert [r[0] for r in df.select(collocations.exact_score(df.a, df.both)).collect()] == [2000000 * a // b for a, b in big]


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    starts, ends, _ = arrays.words(data, np.array([0, 8]))
    lang = np.zeros(3, np.int64)
    assert collocations.same(data, starts, ends, lang, np.array([0, 1, 0]))
    assert not collocations.same(data, starts, ends, lang, np.array([0, 0, 0]))
    first, place = collocations.told_apart(data, starts, ends, lang)
    assert first.tolist() == [0, 1] and place.tolist() == [0, 1, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.sampled_from([1, 5, 17, 32]), st.lists(st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), max_size=60), st.integers(1, 9), st.integers(0, 10**12))
def test_filters_lose_nothing(n, bits, rows, parts, extra):
    ids = np.array([r[:n] for r in rows], np.int64).reshape(-1, n) & ((1 << bits) - 1)
    a, b = qf.widths(n, bits)
    left, right = qf.packed(ids, bits)
    keys = qf.permuted(left, right, a, b)
    assert all(np.array_equal(x, y) for x, y in zip(qf.restored(*keys, a, b), (left, right), strict=True))
    half = len(ids) // 2
    filters = []
    for part in (slice(0, half), slice(half, None)):
        c, place = qf.counted(keys[0][part], keys[1][part], a, b)
        assert np.array_equal(c.left[place], keys[0][part])
        c.count = c.count + extra
        assert np.all(np.diff(qf.parts_of(c.left, a, parts)) >= 0)
        for q in (min(a, 1), min(a, 20)):
            back = qf.decoded(qf.encoded(c, a, b, q), a, b, q)
            assert all(np.array_equal(getattr(back, k), getattr(c, k)) for k in ("left", "right", "count"))
        filters.append(c)
    total, places = qf.merged(filters, a, b)
    want = Counter()
    for part in (ids[:half], ids[half:]):
        want.update({k: v + extra for k, v in Counter(map(tuple, part.tolist())).items()})
    got = qf.unpacked(*qf.restored(total.left, total.right, a, b), n, bits)
    assert dict(zip(map(tuple, got.tolist()), total.count.tolist(), strict=True)) == dict(want)
    assert all(np.array_equal(total.left[p], f.left) for p, f in zip(places, filters, strict=True))
