"""A string with very many different surroundings is dealt out over the tasks."""

import random
import string

import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_arrays
from millrace.llm.chunks import chunk_table

from . import awkward
from .test_dedup import brute_bytes


def near_copies(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n))
    common, twice = noise(70), noise(150)
    rows = [(i, noise(90) + common + noise(90), "en", "a", 1, 0.0, 1, "", 0) for i in range(300)]
    rows += [(1000 + i, noise(5) + twice[:70] + common + twice[70:] + noise(5), "en", "a", 1, 0.0, 1, "", 0) for i in range(9)]
    return spark.createDataFrame(rows, awkward.SCHEMA).repartition(4, "doc_id")


def test_a_common_string_does_not_meet_in_one_part(spark):
    chunks = chunk_table(near_copies(spark), "heavy", (), 3000)
    largest = {}
    for heavy in (3000, 1 << 40):
        sent = suffix_arrays.segments_sent(chunks, 100, 20, "heavy", heavy)[1]
        size = [r.n for r in sent.groupBy("part").agg(F.sum(F.length("data")).alias("n")).collect()]
        largest[heavy] = max(size) / sum(size)
    assert largest[1 << 40] > 0.5 and largest[3000] < 0.35, largest


@pytest.mark.parametrize("heavy", [0, 3000])
def test_results_of_heavy_hashes(spark, heavy):
    for docs, length, gram in ((near_copies(spark), 100, 20), (awkward.frame(spark), 40, 8)):
        got = suffix_arrays.repeated_byte_digests(docs, length, gram, memory=2000, base=200, chunk_bytes=3000, heavy=heavy).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(docs.collect(), length)
