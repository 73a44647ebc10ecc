"""A training corpus from documents: five stages, each one operator of ``millrace.llm``.

quality classifier -> near duplicates -> repeated passages -> source mix -> packing.
Every stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, quality, suffix_trees, tokens
from millrace.llm.queries import TOKENIZER, table
from millrace.session import stored

#: No SQL expresses the classifier or the packing; tests compare run() with a brute-force version.
ORACLE_SQL = None
THRESHOLD = 0.3
BLOCK_WORDS = 256


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their order, with n_chars of the text as it now is."""
    return docs.select(*[F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below the threshold."""
    labels = table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels)
    scored = quality.scored(docs, machine, out="__quality")
    return scored.filter(F.col("__quality") >= THRESHOLD).drop("__quality")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    report = jaccard.near_duplicates(docs.select("doc_id", "text"))
    copies = stored(report.filter(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct(), "pipeline-copies")
    left = docs.join(jaccard.small(copies), F.col("doc_id") == F.col("__copy"), "left_anti")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 13 words or more that a document with a smaller doc_id has."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return _measured(suffix_trees.substring_dedup(docs, rest), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: documents become the blocks of theirs that the mix takes."""
    return _measured(mixing.mixed_texts(docs, block_words=BLOCK_WORDS), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids."""
    return tokens.packed_pieces(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("source mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
