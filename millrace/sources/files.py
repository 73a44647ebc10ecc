"""Small files as tables: match logs, scrape files, lists of keys and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.ordered import first_by
from millrace.schemas import MATCH, POSTING


def valid_matches(rows: DataFrame) -> DataFrame:
    """N15, checks: a title or a url, and a score whose whole part is 0 to 10 (empty is 0)."""
    number = F.expr("try_cast(coalesce(nullif(trim(score), ''), '0') as double)")
    whole = F.when(~F.isnan(number), number).try_cast("int")
    named = (F.coalesce(strip(F.col("title")), F.lit("")) != "") | (F.coalesce(strip(F.col("url")), F.lit("")) != "")
    return rows.withColumn("score", whole).filter(named & F.col("score").between(0, 10))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """CSV with or without header and byte-order mark."""
    schema = ", ".join(f"{c} string" for c in MATCH)
    rows = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    rows = rows.withColumn(MATCH[0], F.regexp_replace(MATCH[0], "^﻿", ""))
    return valid_matches(rows.filter(~((F.col(MATCH[0]) == MATCH[0]) & (F.col("title") == "title"))))


def read_landing(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """N16 with what failed: postings (scraped_at, ord, posting columns), and bad records by file (file, bad).

    Files are documents (an object with ``jobs``, or a bare array), each parsed from its stream in one task, or with
    ``lines`` one posting a line, which large files should be: they are split. ``ord`` rises within a file. Bad are what does
    not parse (a document is one record) and records without any posting column; nulls in a list of jobs as well.
    """
    fields = ", ".join(f"{c} string" for c in POSTING)
    jobs = "" if lines else f"jobs array<struct<{fields}>>, "
    read = spark.read.schema(f"scraped_at string, {jobs}{fields}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", not lines)
    # a posting is a field of its own name, so a name may be missing or of another kind without spoiling the others
    rows = read.json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"))
    if not lines:
        own = F.array(F.struct(*POSTING))
        each = F.explode(F.when(F.col("_bad").isNull(), F.coalesce("jobs", own)).otherwise(own))
        rows = rows.select("scraped_at", "_bad", "file", "_from", each.alias("_j")).select("scraped_at", "_bad", "file", "_from", "_j.*")
    # splits of a file start as far apart as a partition is long, so the place in the partition keeps their order
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("ord", F.col("_from") + place).withColumn("_good", F.col("_bad").isNull() & F.coalesce(*POSTING).isNotNull())
    bad = rows.filter(~F.col("_good")).groupBy("file").agg(F.count(F.lit(1)).alias("bad"))
    return rows.filter("_good").select("scraped_at", "ord", *POSTING), bad


def read_postings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An object with ``jobs``, or a bare array, or a posting a line; ``scraped_at`` comes along."""
    return read_landing(spark, path, lines)[0]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order; such files are lists kept by hand, read as one text each."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).filter("line <> '' and not startswith(line, '#')")


def read_company_list(spark: SparkSession, path: str) -> DataFrame:
    """Name | slug1 | slug2; the first of each name counts."""
    parts = F.transform(F.split("line", r"\|"), strip)
    rows = _numbered(spark, path).select("line_no", parts[0].alias("name"), F.filter(F.slice(parts, 2, 99), lambda s: s != "").alias("hints")).filter("name <> ''")
    return first_by(rows.withColumn("_k", F.lower("name")), ["_k"], "line_no").select("name", "hints", "line_no")


def read_archive_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """key<TAB>reason, the first of each key; lines without a key as the second frame."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).filter("trim(line) <> '' and not startswith(trim(line), '#')")
    parts = F.split("line", "\t", 2)
    rows = lines.select("line_no", F.lower(strip(parts[0])).alias("key"), F.coalesce(strip(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("reason"))
    return first_by(rows.filter("key <> ''"), ["key"], "line_no"), rows.filter("key = ''")


def read_board_url_batch(spark: SparkSession, path: str) -> DataFrame:
    """Label | url; a bare url labels itself."""
    parts = F.split("line", r"\|", 2)
    return _numbered(spark, path).select(strip(parts[0]).alias("label"), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0])).alias("url"))


def read_key_set(spark: SparkSession, path: str) -> DataFrame:
    """One key a line."""
    return spark.read.text(path).select(strip(F.col("value")).alias("key")).filter("key <> ''").distinct()


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows at each stage of a scrape, in order."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
