"""The queries opN_<name> of the operators in this subpackage; their DuckDB SQL is in ``oracles``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import collocations, jaccard, mixing, prefix_trie, quality, rollups, sampling, suffix_arrays, suffix_trees, tokens, toxicity, vectors
from millrace.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "TOKENIZER", "table"]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.id_file_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.substring_digests(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: every document arrives; every seventh is deleted; every fifth of the rest
    gets its text replaced by its second half. The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counts = rollups.token_counts(docs)
    roll = rollups.Rollup(spark)
    roll.commit("arrivals", rollups.signed(counts, F.lit(1)))
    gone = rollups.signed(rollups.token_counts(docs.filter("doc_id % 7 = 0")), F.lit(-1))
    roll.commit("deletions", gone)
    roll.commit("deletions", gone)
    old = docs.filter("doc_id % 7 <> 0 and doc_id % 5 = 0")
    new = old.withColumn("text", F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"))
    changed = rollups.signed(rollups.token_counts(old), F.lit(-1)).unionByName(rollups.signed(rollups.token_counts(new), F.lit(1)))
    roll.commit("revisions", changed)
    return roll.totals()


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.repeated_byte_digests(table(spark, sf_dir, "documents"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fingerprints(table(spark, sf_dir, "documents"))


def op9_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed_pieces(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text", "lang")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_id_files": op2_token_id_files,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_count_rollup": op5_token_count_rollup,
    "op6_quality_scores": op6_quality_scores,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_vector_near_duplicates": op9_vector_near_duplicates,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_toxicity_scores": op12_toxicity_scores,
    "op13_conversation_trie": op13_conversation_trie,
}
