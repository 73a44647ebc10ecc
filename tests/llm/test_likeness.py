"""Likeness of fingerprints against the true likeness, single errors."""

import random
from collections import Counter

import numpy as np

from millrace.llm import sampling

from . import awkward


def test_likeness_errors(spark):
    """The standard error at 0.8 is sqrt(0.8 * 0.2 / 128) = 0.035; that of 32 samples is 0.071."""
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(100)]
    for i in range(240):
        words = [w if rng.random() > 0.11 else f"x{rng.randrange(10**9)}" for w in words]
        rows.append((i, " ".join(words), "en", "a", 1, 0.0, 1, "", 0))
    got = {r.doc_id: r.near_next for r in sampling.fingerprints(spark.createDataFrame(rows, awkward.SCHEMA)).collect()}
    errors = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        x, y = Counter(a[1].split()), Counter(b[1].split())
        errors.append(got[a[0]] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
