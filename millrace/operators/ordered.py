"""First, last and best rows of a key: windows over a carried order column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import dedupe_key


def first_by(df: DataFrame, key: Sequence[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes to them before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def dedupe(df: DataFrame, order: str = "ord") -> DataFrame:
    """G1: the first posting of each K1 in input order."""
    keyed = df.withColumn("_k", dedupe_key(F.col("url"), F.col("title"), F.col("company")))
    return first_by(keyed, ["_k"], order).drop("_k")


def last_wins_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    return first_by(df, [key], F.col(order).desc())


def first_row_per_key(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each non-blank key; blank and repeated ones as the second frame."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    good = (F.coalesce(F.col(key), F.lit("")) != "") & (F.col("_rn") == 1)
    return ranked.filter(good).drop("_rn"), ranked.filter(~good).drop("_rn")


def carry_last(df: DataFrame, value: str, by: Sequence[str], order: str, out: str) -> DataFrame:
    """The last non-null value at or above each row."""
    above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(above))


def cap_rows(df: DataFrame, n: int, by: Sequence[str], order: str) -> DataFrame:
    """The first n rows; 0 is no cap."""
    return first_by(df, by, order, n=n) if n else df


def recent(df: DataFrame, n: int) -> DataFrame:
    """Newest by date, then score."""
    return df.orderBy(F.desc_nulls_last("date_processed"), F.desc_nulls_last("score"), "key").limit(n)


def latest_snapshots(dates: DataFrame, keep: int = 14, protect: Sequence[str] = ()) -> DataFrame:
    """Adds ``drop`` to a table of snapshot dates (a row a snapshot): all but the newest ``keep``."""
    rank = F.row_number().over(Window.orderBy(F.desc("snapshot_date")))
    return dates.withColumn("drop", (rank > keep) & ~F.col("snapshot_date").cast("string").isin(list(protect)))
