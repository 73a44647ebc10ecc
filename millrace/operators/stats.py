"""Aggregates over the tracker, postings and boards."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import pct, simplify_location, source_group, text_or_empty
from millrace.operators.filters import GateRules, gate
from millrace.operators.ordered import first_by


def live(tracker: DataFrame, archived: bool = False) -> DataFrame:
    """P15."""
    return tracker.filter(F.col("deleted_at").isNotNull() if archived else F.col("deleted_at").isNull())


def score_distribution(tracker: DataFrame) -> DataFrame:
    """A1."""
    return live(tracker).filter("score is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"))


def top_companies(tracker: DataFrame, n: int = 15) -> DataFrame:
    """A2."""
    per = live(tracker).filter("company <> ''").groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))
    return per.orderBy(F.desc("n"), F.desc_nulls_last("avg_score"), "company").limit(n)


def status_breakdown(tracker: DataFrame) -> DataFrame:
    """A3."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("Not started"))
    return live(tracker).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def tracker_counts(tracker: DataFrame) -> DataFrame:
    """A4."""
    return tracker.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted")
    )


def counted(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """O3: counts of ``key``, most first, ties by name."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return out.limit(n) if n else out


def source_breakdown(postings: DataFrame) -> DataFrame:
    """A5: counts by source group with whole percents; a row a source goes through one window."""
    per = counted(postings.withColumn("source", source_group(F.coalesce("source", F.lit("unknown")))), "source")
    return per.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def location_breakdown(rows: DataFrame, n: int = 15) -> DataFrame:
    """A6."""
    return counted(rows.withColumn("location", simplify_location(F.col("location"))), "location", n)


def unscored_by_company(postings: DataFrame, seen: DataFrame, n: int = 15) -> DataFrame:
    """Postings (fp, company) not in seen, by company."""
    return counted(postings.dropDuplicates(["fp"]).join(seen.select("fp"), "fp", "left_anti"), "company", n)


def progress(postings: DataFrame, seen: DataFrame, matches: DataFrame, rules: GateRules = GateRules(), seconds_per_posting: int = 75) -> DataFrame:
    """One row. postings and matches carry fp; the gate only counts postings still to come."""
    flags = (
        gate(postings, rules)
        .join(seen.select("fp").distinct().withColumn("_seen", F.lit(True)), "fp", "left")
        .join(matches.select("fp").distinct().withColumn("_match", F.lit(True)), "fp", "left")
    )
    per = flags.groupBy("fp").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_or(F.coalesce("_seen", F.lit(False))).alias("seen"),
        F.bool_or(F.coalesce("_match", F.lit(False))).alias("matched"),
        F.bool_or(F.col("gate").isNotNull()).alias("gated"),
    )
    one = per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.count_if("seen").alias("scored"),
        F.count_if(~F.col("seen")).alias("remaining"),
        F.count_if("matched").alias("scrape_matches"),
        F.count_if(~F.col("seen") & F.col("gated")).alias("gated_ahead"),
    )
    return one.select(
        "*",
        (F.col("scored") - F.col("scrape_matches")).alias("scrape_no_match"),
        F.when(F.col("remaining") == 0, "last scrape").otherwise("this scrape").alias("scrape_label"),
        ((F.col("remaining") - F.col("gated_ahead")) * seconds_per_posting).alias("eta_seconds"),
    )


def company_matches(matches: DataFrame, name: str) -> DataFrame:
    """The matches of companies whose name contains ``name``, whatever its case: score, title (44 characters) and
    location (30), highest whole score first."""
    mine = matches.filter(F.lower("company").contains(name.lower()))
    shown = mine.select("score", F.left(F.coalesce("title", F.lit("")), F.lit(44)).alias("title"), F.left(F.coalesce("location", F.lit("")), F.lit(30)).alias("location"))
    return shown.orderBy(F.floor(F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))).desc(), "title")


def company_detail(postings: DataFrame, seen: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """Counts for companies whose name contains ``name``, whatever its case."""
    mine = lambda d: d.filter(F.lower("company").contains(name.lower()))
    own = mine(postings).join(seen.select("fp").distinct().withColumn("_seen", F.lit(True)), "fp", "left")
    one = own.agg(F.count(F.lit(1)).alias("postings"), F.count_distinct(F.when(F.col("_seen"), F.col("fp"))).alias("scored"))
    return one.join(mine(matches).agg(F.count(F.lit(1)).alias("matches"), F.max("score").alias("best_score")))


def gate_rule_counts(gated: DataFrame) -> DataFrame:
    """A10."""
    return counted(gated.filter("gate is not null").select(F.col("gate.rule").alias("rule")), "rule")


def alert_groups(hits: DataFrame, titles: int = 4) -> DataFrame:
    """Per company the number of hits and the first titles in order (column ord).

    The titles are ranked before they are collected, so a company's list stays short.
    """
    key = F.lower("company")
    first = first_by(hits.withColumn("_k", key), ["_k"], "ord", n=titles).groupBy("_k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("sample_roles")
    )
    per = hits.groupBy(key.alias("_k")).agg(F.min("company").alias("company"), F.count(F.lit(1)).alias("count"))
    return per.join(first, "_k").drop("_k")


def prune_summary(live_rows: DataFrame, pruned: DataFrame) -> DataFrame:
    """Live before, pruned, kept."""
    marked = live_rows.select("key").join(pruned.select("key", F.lit(1).alias("_p")), "key", "left")
    return marked.agg(F.count(F.lit(1)).alias("before"), F.count("_p").alias("pruned")).withColumn("kept", F.col("before") - F.col("pruned"))


def watchlist_audit_rollup(verified: DataFrame) -> DataFrame:
    """Boards by state."""
    return counted(verified, "state")


def distinct_values(tracker: DataFrame, column: str) -> DataFrame:
    """A14."""
    if column not in ("company", "status", "source"):
        raise ValueError(f"not a filterable column: {column}")
    return live(tracker).filter(F.col(column) != "").select(column).distinct().orderBy(F.collate(F.col(column), "UTF8_LCASE"), column)


def dashboard(tracker: DataFrame, alerts: DataFrame, today: datetime.date) -> dict[str, DataFrame]:
    """The parts of the dashboard; live rows are cached once."""
    from millrace.operators.filters import unexpired_alerts
    from millrace.operators.ordered import recent

    now = live(tracker).cache()
    return {
        "scores": score_distribution(now), "companies": top_companies(now), "statuses": status_breakdown(now), "counts": tracker_counts(tracker),
        "locations": location_breakdown(now), "alerts": unexpired_alerts(alerts, today), "recent": recent(now, 10),
    }


def board_samples(boards: DataFrame, jobs: DataFrame, k: int = 3) -> DataFrame:
    """Per board (platform, slug) its number of jobs and the first k as ``title [location]``."""
    on = ["platform", "slug"]
    shown = F.concat("title", F.lit(" ["), text_or_empty(F.col("location")), F.lit("]"))
    first = first_by(jobs, on, "ord", n=k).groupBy(*on).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("s")))), lambda x: x["s"]), "; ").alias("sample")
    )
    per = jobs.groupBy(*on).agg(F.count(F.lit(1)).alias("open"))
    return boards.select(*on).join(per, on, "left").join(first, on, "left").select(
        *on, F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("sample", F.lit("(no open jobs)")).alias("sample")
    )
