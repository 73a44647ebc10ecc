"""The pipeline's stages against brute force on a small documents table."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import mixing
from millrace.llm.queries import TOKENIZER

from . import awkward
from .test_dedup import WORD, brute_near, brute_substrings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    awkward.frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i * 3, 1) for i in range(50)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = pipeline.keep_good(spark, docs, folder)
    assert good.columns == docs.columns and good.count() == docs.count()  # only ones are labelled: all stay

    one = pipeline.keep_one_of_each(spark, good, folder).cache()
    want = {d for d, _, c in brute_near(docs.collect()) if d == c or c == "None"}
    assert {str(r.doc_id) for r in one.collect()} == want and one.count() == len(want)

    cut = pipeline.cut_repeats(spark, one, folder).cache()
    kept = {d: (n, r) for d, n, r, _ in brute_substrings(one.collect())}
    assert cut.columns == docs.columns
    assert {str(r.doc_id): len(WORD.findall(r.text or "")) for r in cut.collect()} == {d: n - r for d, (n, r) in kept.items()}
    assert cut.filter("n_chars <> char_length(text)").count() == 0

    mixed = pipeline.mix(spark, cut, folder).cache()
    total = cut.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    taken = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert mixed.columns == docs.columns and abs(taken - 1.5 * total) < 0.2 * total

    t = Tokenizer.from_file(TOKENIZER)
    pieces = pipeline.pack(spark, mixed, folder).collect()
    assert sum(p.length for p in pieces) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    crcs = {zlib.crc32(np.array(t.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in mixed.collect()}
    assert {p.ids_crc32 for p in pieces if p.length == p.doc_tokens} <= crcs


def test_run(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.count() > 0 and "sequence_id" in got.columns
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "substring dedup", "source mix", "packing"]
