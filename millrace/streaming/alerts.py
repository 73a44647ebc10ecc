"""Streams: each posting once, each alert once for its time to live."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.text import strip, text_or_empty
from millrace.operators.filters import is_new_grad, location_prefilter, unexpired_seen
from millrace.operators.joins import fresh_fast_lane, with_fingerprint
from millrace.operators.ordered import first_by
from millrace.plans.cycle import CycleOptions, cycle
from millrace.session import shuffle_partitions
from millrace.sources.normalize import fill_multi_location
from millrace.sources.sinks import append_matches


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream has written so far; nothing before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Seen keys lie in folders by the first digits of their SHA-256, so that a micro-batch reads only the folders of its own.
BUCKET_DIGITS = 2


def _bucket(key: Column) -> Column:
    return F.left(F.sha2(key, 256), F.lit(BUCKET_DIGITS))


def batch_name(checkpoint: str, batch_id: int) -> str:
    """A micro-batch of a stream: the same for a repeated one, another one for another stream's."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id}"


def seen_of(keys: DataFrame, path: str, column: str, name: str, also: str = "") -> DataFrame:
    """Rows of a seen table that may hold one of ``keys`` (distinct values of ``column``): those of the keys' buckets,
    without what this same micro-batch wrote when it was tried before. At most 256 bucket names come to the driver."""
    spark = keys.sparkSession
    seen = table_or_empty(spark, path, f"{column} string{also}, batch string, bucket string")
    buckets = [r[0] for r in keys.select(_bucket(F.col(column))).distinct().collect() if r[0] is not None]
    return seen.filter(F.col("bucket").isin(buckets) & (F.col("batch") != name)).drop("batch", "bucket")


def append_seen_batch(rows: DataFrame, path: str, column: str, name: str) -> None:
    """S3 of a micro-batch: its keys under its name, by buckets; written again, they replace themselves. The number of
    partitions is given, else Spark joins these small rows to one task, which then writes all the buckets' files."""
    keyed = rows.withColumn("bucket", _bucket(F.col(column)))
    keyed.repartition(shuffle_partitions(rows.sparkSession), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={name}")


def stream_new_postings(stream: DataFrame, seen_path: str, matches_path: str, checkpoint: str, options: CycleOptions = CycleOptions(), stamp: Callable[[], str] | None = None) -> StreamingQuery:
    """Every fingerprint is processed once, ever: matches are written, then the fingerprints, both under the
    micro-batch's name. A crash in between repeats the micro-batch, which then replaces what it wrote."""

    def batch(df: DataFrame, batch_id: int) -> None:
        now = stamp() if stamp else datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M")
        name = batch_name(checkpoint, batch_id)
        df = with_fingerprint(df).persist()
        rows, decided = cycle(df.drop("fp"), seen_of(df.select("fp"), seen_path, "fp", name), now, options)
        append_matches(rows, f"{matches_path}/batch={name}", mode="overwrite")
        append_seen_batch(decided.select("fp").distinct(), seen_path, "fp", name)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pulse_days(hits: DataFrame, ttl_days: int = 4) -> DataFrame:
    """W2 over a whole table: hits (company, day) -> company key, first_seen, expires of each alert.

    An alert stands through ``expires``; the first hit after it raises the next. Distinct
    days of a company are few, whatever its number of hits; they are folded in order.
    """
    days = hits.select(F.lower("company").alias("company"), F.to_date("day").alias("day")).distinct()
    per = days.groupBy("company").agg(F.array_sort(F.collect_set("day")).alias("days"))
    start = F.struct(F.lit(None).cast("date").alias("until"), F.array().cast("array<date>").alias("raised"))
    step = lambda a, d: F.when(
        a["until"].isNull() | (d > a["until"]), F.struct(F.date_add(d, ttl_days).alias("until"), F.concat(a["raised"], F.array(d)).alias("raised"))
    ).otherwise(a)
    raised = F.aggregate("days", start, step, lambda a: a["raised"])
    return per.select("company", F.explode(raised).alias("first_seen")).withColumn("expires", F.date_add("first_seen", ttl_days))


class PulseProcessor(StatefulProcessor):
    """State of a company: the last day its alert stands, one date for each company that ever had one."""

    def __init__(self, ttl_days: int) -> None:
        self.ttl = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        hits = pd.concat(list(rows)).sort_values(["day", "company"])
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for day, same in hits.groupby("day", sort=True):
            if until is None or day > until:
                until = day + datetime.timedelta(days=self.ttl)
                roles = sorted(r for some in same.roles for r in some)[:SAMPLE_ROLES]
                out.append((same.company.iloc[0], day, until, int(same["n"].sum()), roles))
        if out:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["company", "first_seen", "expires", "count", "sample_roles"])

    def close(self) -> None:
        pass


#: Titles an alert shows.
SAMPLE_ROLES = 4


def recruitment_pulse(stream: DataFrame, ttl_days: int = 4, lateness: str | None = None, watchlist: DataFrame | None = None) -> DataFrame:
    """W2 as a stream: stream (company, title, day date) -> alerts. Needs the RocksDB state store provider.

    Without ``lateness`` an alert goes out in the micro-batch of its first hit, and micro-batches have to come in the order of
    their days. With it (an interval, "2 days") hits may come that late, in any order: a company's day is summed up before the
    shuffle and goes to its state as one row when the watermark has passed the day, so days are folded in order however the
    input is split; the alert then waits for that. Rows of all titles move the watermark; later hits than ``lateness`` are lost.
    With ``watchlist`` (label), which needs a source column, only rows of a board ("lever:acme") or of a label count (P9).
    Titles shown are one for each of four hash classes, the smallest: bounded, and the same in any order. A null company
    counts as empty; rows without a day count nowhere.
    """
    dated = stream.withColumn("company", text_or_empty(F.col("company"))).withColumn("day", F.to_date("day")).withColumn("_key", F.lower("company"))
    if lateness:
        dated = dated.withColumn("_at", F.col("day").cast("timestamp")).withWatermark("_at", lateness)
    hit = F.coalesce(is_new_grad(F.col("title")), F.lit(False))
    if watchlist is not None:
        labels = watchlist.select(F.lower(strip(F.col("label"))).alias("_label")).filter("_label <> ''").distinct()
        dated = dated.join(labels, F.col("_key") == F.col("_label"), "left")
        hit = hit & (F.contains(text_or_empty(F.col("source")), F.lit(":")) | F.col("_label").isNotNull())
    if lateness:  # a filter would be pushed below the watermark, so other rows go along and count nothing
        seen = dated.select("_at", "_key", "day", F.when(hit, F.col("company")).alias("company"), F.when(hit, F.col("title")).alias("title"))
        share = F.pmod(F.xxhash64("title"), F.lit(SAMPLE_ROLES))
        shown = [F.min(F.when(share == i, F.col("title"))) for i in range(SAMPLE_ROLES)]
        days = seen.groupBy(F.window("_at", "1 day"), "_key").agg(
            F.min("day").alias("day"), F.min("company").alias("company"), F.count("title").alias("n"), F.array_compact(F.array(*shown)).alias("roles")
        )
        rows = days.filter("n > 0").select("_key", "company", "day", "n", "roles")
    else:
        rows = dated.filter(F.col("day").isNotNull() & hit).select("_key", "company", "day", F.lit(1).cast("long").alias("n"), F.array("title").alias("roles"))
    return rows.groupBy("_key").transformWithStateInPandas(
        PulseProcessor(ttl_days), "company string, first_seen date, expires date, count long, sample_roles array<string>", "append", "none"
    )


def tier1_filter(stream: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Only postings of boards flagged tier1."""
    on = watchlist.filter("tier1").select(F.concat("platform", F.lit(":"), "slug").alias("_s")).distinct()
    return stream.join(on, F.col("source") == F.col("_s"), "left_semi")


def fast_lane(
    stream: DataFrame, seen_path: str, deliver: Callable[[DataFrame, str], None], checkpoint: str, now: Callable[[], datetime.datetime], ttl_days: int = 120,
    ignore_seen: bool = False, details: DataFrame | None = None, places: Sequence[str] = (), no_places: Sequence[str] = (),
) -> StreamingQuery:
    """New-graduate postings (P7) in places that fit (F16 where ``details`` are given and the stream has a detail_url,
    then P2) with a URL not alerted in the time to live (J5); of equal URLs in a micro-batch one goes out, postings without
    one always do. ``deliver(hits, name)`` comes first, the record after it; a repeated micro-batch has the same name and
    the same hits, so a deliverer that replaces what it wrote under a name delivers once."""

    def batch(df: DataFrame, batch_id: int) -> None:
        name = batch_name(checkpoint, batch_id)
        hits = df.filter(is_new_grad(F.col("title")))
        if details is not None and "detail_url" in df.columns:
            hits = fill_multi_location(hits, details)
        if places or no_places:
            hits = location_prefilter(hits, places, no_places)
        url = text_or_empty(F.col("url"))
        order = [c for c in ("ord", "company", "title") if c in hits.columns]
        hits = first_by(hits.filter(url != ""), ["url"], *order).unionByName(hits.filter(url == "")).persist()
        if not ignore_seen:
            seen = seen_of(hits.filter(url != "").select("url"), seen_path, "url", name, ", alerted_at string")
            fresh = fresh_fast_lane(hits, unexpired_seen(seen, now(), ttl_days)).persist()
        else:
            fresh = hits
        deliver(fresh, name)
        append_seen_batch(fresh.filter(url != "").select("url", F.lit(now().isoformat()).alias("alerted_at")), seen_path, "url", name)
        fresh.unpersist()
        hits.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
