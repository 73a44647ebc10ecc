"""Writers: postings, match log, seen set, exports, snapshots, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.dates import month_day
from millrace.functions.text import text_or_empty
from millrace.operators.ordered import latest_snapshots
from millrace.operators.stats import live
from millrace.operators.tracker import sort_orders
from millrace.rules import EXPORT_COLUMNS
from millrace.schemas import MATCH, POSTING


def write_postings(postings: DataFrame, path: str, scraped_at: str) -> None:
    """The postings of a scrape with its time."""
    postings.select(*POSTING).withColumn("scraped_at", F.lit(scraped_at)).write.mode("append").parquet(path)


def append_matches(rows: DataFrame, path: str, as_csv: bool = False, mode: str = "append") -> None:
    """The match columns in order; CSV quotes every field."""
    out = rows.select(*[F.col(c).cast("string").alias(c) if as_csv else F.col(c) for c in MATCH])
    if as_csv:
        out.write.mode(mode).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        out.withColumn("day", F.left("date_processed", F.lit(10))).write.mode(mode).partitionBy("day").parquet(path)


def append_seen(rows: DataFrame, path: str, dry_run: bool = False, rescore: bool = False) -> None:
    """S3: fingerprints of decided rows, scored and gated; not for dry runs or when scoring again."""
    if not dry_run and not rescore:
        rows.select("fp").distinct().write.mode("append").parquet(path)


def export_projection(tracker: DataFrame) -> DataFrame:
    """Live rows under the export's headers, best score first; null is empty, dates are short."""
    shown = lambda c: month_day(F.col(c)) if c == "date_processed" else text_or_empty(F.col(c))
    return live(tracker).orderBy(*sort_orders("score")).select(*[shown(c).alias(head) for head, c in EXPORT_COLUMNS.items()])


def write_snapshot(tracker: DataFrame, path: str, date: str) -> None:
    """The snapshot of a date; written again, it replaces itself."""
    tracker.write.mode("overwrite").parquet(f"{path}/snapshot_date={date}")


def retain_snapshots(spark: SparkSession, path: str, keep: int = 14, protect: Sequence[str] = ()) -> list[str]:
    """Removes the snapshots that G11 drops and gives their dates. Folders that are being written, or were left by a
    write that failed (no ``_SUCCESS``), neither count nor go. The names of snapshots, a few, are listed by the driver."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    below = lambda name: spark._jvm.org.apache.hadoop.fs.Path(root, name)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    dates = [n.split("=", 1)[1] for n in names if n.startswith("snapshot_date=") and fs.exists(below(f"{n}/_SUCCESS"))]
    marked = latest_snapshots(spark.createDataFrame([(d,) for d in dates], "snapshot_date string"), keep, protect)
    gone = sorted(r.snapshot_date for r in marked.filter("drop").collect())
    for date in gone:
        fs.delete(below(f"snapshot_date={date}"), True)
    return gone


def alerts_digest(hits: DataFrame, lines: int = 1000) -> DataFrame:
    """Pieces of text (company, part, block, n, body) of at most ``lines`` lines, each under its company's name;
    by company, part and block they hold the lines in order. Subject and body are joined from them where they are sent.

    Lines are dealt out by ranges of (company, line), equal ones at random, so that no company meets in one task or row.
    """
    line = F.concat(F.lit("- "), "title", F.lit(" ["), text_or_empty(F.col("location")), F.lit("] "), text_or_empty(F.col("url")))
    ranged = hits.select("company", line.alias("_line"), F.rand(8).alias("_salt")).repartitionByRange("company", "_line", "_salt")
    number = F.row_number().over(Window.partitionBy("company", "part").orderBy("_line"))
    blocks = ranged.withColumn("part", F.spark_partition_id()).withColumn("block", F.floor((number - 1) / lines))
    per = blocks.groupBy("company", "part", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("_line")).alias("_lines"))
    return per.select("company", "part", "block", "n", F.concat("company", F.lit("\n"), F.array_join("_lines", "\n")).alias("body")).orderBy("company", "part", "block")
