from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

from . import awkward


def seats(votes: list[int], house: int) -> list[int]:
    out = [0] * len(votes)
    for _ in range(house):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


@pytest.mark.parametrize(("votes", "house"), [([53, 24, 23], 10), ([1, 1, 1, 997], 7), ([500, 300, 100, 60, 40, 7, 3, 0], 31), ([5], 0), ([3, 3, 3], 9)])
def test_apportionment_is_by_highest_quotients(spark, votes, house):
    df = spark.createDataFrame([(i, v, house, 1) for i, v in enumerate(votes)], "i int, v long, h long, g int")
    got = [r.s for r in mixing.apportion(df, ["g"], "v", "h", "s").orderBy("i").collect()]
    want = seats(votes, house)
    assert sum(got) == house and sorted(got) == sorted(want)


def targets(sizes: dict, share=1.5, most=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = (goal - sum(out.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        free -= full
    return out


def test_mix(spark):
    docs = awkward.frame(spark)
    got = mixing.mix_counts(docs, block_words=8).collect()
    assert len(got) == docs.count()
    words = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    want = targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(24, 0.02 * t)
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(got) == key(mixing.mix_counts(awkward.frame(spark).repartition(5), block_words=8).collect())


def test_texts_are_the_counts(spark):
    docs = awkward.frame(spark).filter("doc_id is not null and doc_id <> 203")
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block_words=8).collect()}
    mixed = mixing.mixed_texts(docs, block_words=8)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {k: v for k, v in counts.items() if v}


def test_empty(spark):
    assert mixing.mix_counts(awkward.empty(spark)).count() == 0
    assert mixing.mixed_texts(awkward.empty(spark)).count() == 0
