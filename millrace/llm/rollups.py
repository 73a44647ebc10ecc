"""Delta-maintained token counts.

Totals by source, language and tokenizer version are kept by signed deltas: an insert
adds a document's counts, a delete takes them away, a revision takes the old counts
away and adds the new ones. A batch is committed as one version of the totals table,
which carries the batches it has absorbed: committing a batch again changes nothing.

Each commit writes a new folder and then names it in a marker table; a commit that
dies before the marker leaves the last version in force. Totals have a row a key, so a
commit costs one map-side-combined shuffle of the batch and a join of two small tables.

Defined results: null source or language is a key of its own; a null text counts 0
tokens and one document; keys whose document count is 0 after a delete stay with zeros
until ``totals`` drops them; an empty batch is committed without changes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch

KEYS = ("source", "lang", "tokenizer")
#: Pattern of a token by tokenizer version.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "runs-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def token_counts(docs: DataFrame, *keep: str, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """A row for each document and tokenizer version: keys, n_tokens, and the columns in ``keep``."""
    versions = F.array(
        *[
            F.struct(
                F.lit(name).alias("tokenizer"),
                F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long").alias("n_tokens"),
            )
            for name, pattern in tokenizers.items()
        ]
    )
    return docs.select("source", "lang", *keep, F.explode(versions).alias("_v")).select("source", "lang", *keep, "_v.*")


def signed(changes: DataFrame, sign: Column) -> DataFrame:
    """Contributions of rows with keys and n_tokens, times ``sign`` (1 or -1)."""
    return changes.select(*KEYS, sign.cast("long").alias("n_docs"), (sign * F.col("n_tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder; ``commit`` is idempotent by batch name. One writer at a time."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "rollup")

    def _ledger(self) -> DataFrame:
        schema = "version long, batch string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        return self._ledger().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def totals(self, every: bool = False) -> DataFrame:
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], self.SCHEMA)
        now = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/totals/v={version}")
        return now if every else now.filter("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the batch's signed contributions; False if the batch was there already."""
        ledger = self._ledger()
        if ledger.filter(F.col("batch") == batch).count():
            return False
        version = self.version() + 1
        added = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        after = (
            self.totals(every=True).unionByName(added).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        )
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/v={version}")
        self.spark.createDataFrame([(version, batch)], "version long, batch string").write.mode("append").parquet(f"{self.path}/ledger")
        return True
