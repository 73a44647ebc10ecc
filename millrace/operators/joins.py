"""Joins and set operations between postings, seen sets, logs, tracker and boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import fingerprint
from millrace.functions.text import slug_variants, strip
from millrace.operators.ordered import first_by
from millrace.rules import PLATFORMS
from millrace.schemas import TRACKER_TYPES, with_columns_of


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fp", fingerprint(F.col("url"), F.col("title"), F.col("company")))


def new_postings(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose fingerprint is not in ``seen`` (column fp), against the whole set at any age."""
    keyed = df if "fp" in df.columns else with_fingerprint(df)
    return keyed.join(seen.select("fp"), "fp", "left_anti")


def new_rows(known: DataFrame, rows: DataFrame, now: str, order: str = "ord") -> DataFrame:
    """The first row of each key that is not among ``known`` (column key), stamped."""
    fresh = first_by(rows.filter("key is not null and key <> ''"), ["key"], order).join(known.select("key"), "key", "left_anti")
    return with_columns_of(fresh.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now)), TRACKER_TYPES)


def insert_new(tracker: DataFrame, rows: DataFrame, now: str, order: str = "ord") -> DataFrame:
    """Adds rows with new keys (the first of each), never changes an existing one."""
    return with_columns_of(tracker, TRACKER_TYPES).unionByName(new_rows(tracker, rows, now, order))


def scrape_matches(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """How many distinct fingerprints occur in both (column fp)."""
    return postings.select("fp").intersect(matches.select("fp")).agg(F.count(F.lit(1)).alias("scrape_matches"))


def suppress_active_alerts(hits: DataFrame, active: DataFrame) -> DataFrame:
    """Companies without an active alert, whatever their case."""
    on = active.select(F.lower("company").alias("_c"))
    return hits.join(on, F.lower(F.col("company")) == F.col("_c"), "left_anti")


def fresh_fast_lane(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Exact URL not among the seen ones; rows without a URL are always fresh."""
    on = seen.select(F.col("url").alias("_u")).filter("_u <> ''")
    return hits.join(on, F.col("url") == F.col("_u"), "left_anti")


def watchlist_label(postings: DataFrame, watchlist: DataFrame) -> DataFrame:
    """The label of (platform, slug) as company; the list is a small table, Spark broadcasts it by its size."""
    on = first_by(watchlist, ["platform", "slug"], "label").select(F.concat("platform", F.lit(":"), "slug").alias("_s"), F.col("label").alias("_l"))
    return postings.join(on, F.col("source") == F.col("_s")).withColumn("company", F.col("_l")).drop("_s", "_l")


def archive_classify(keys: DataFrame, tracker: DataFrame, include_touched: bool = False) -> DataFrame:
    """Each key's outcome: to_archive, engaged, already or missing."""
    state = tracker.select(F.col("key").alias("_k"), "deleted_at", "status", "date_applied")
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    engaged = (filled("status") | filled("date_applied")) & F.lit(not include_touched)
    outcome = F.when(F.col("_k").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "already").when(engaged, "engaged").otherwise("to_archive")
    return keys.join(state, F.col("key") == F.col("_k"), "left").select(*keys.columns, outcome.alias("outcome"))


def bootstrap_plan(sheet: DataFrame, log: DataFrame, pruned: DataFrame) -> DataFrame:
    """What becomes live and what a tombstone, by key.

    sheet (key, ord, ...) first row of a key; log (key, ord, ...) last; pruned (key).
    Gives key, plan (live-matched, live-inferred, import-csv, import-prune).
    """
    rows = first_by(sheet.filter("key <> ''"), ["key"], "ord").select("key", F.lit(True).alias("_sheet"))
    logged = log.filter("key <> ''").select("key").distinct().withColumn("_log", F.lit(True))
    old = pruned.filter("key <> ''").select("key").distinct().withColumn("_old", F.lit(True))
    both = rows.join(logged, "key", "full").join(old, "key", "full")
    plan = (
        F.when(F.col("_sheet") & F.col("_log"), "live-matched").when(F.col("_sheet"), "live-inferred").when(F.col("_log"), "import-csv").otherwise("import-prune")
    )
    return both.select("key", plan.alias("plan"))


def first_board_hit(names: DataFrame, probes: DataFrame) -> DataFrame:
    """For each name (with array ``hints``) the first board present, by slug order, then platform order.

    probes: platform, slug, present. The slugs of a name are a handful; they are
    exploded and joined on the slug.
    """
    slugs = F.array_distinct(F.concat(F.coalesce("hints", F.array().cast("array<string>")), slug_variants(F.col("name"))))
    tries = names.select("name", F.posexplode(slugs).alias("slug_rank", "slug")).filter("slug <> ''")
    rank = F.array_position(F.array(*map(F.lit, PLATFORMS)), F.col("platform"))
    found = tries.join(probes.filter("present").select("platform", "slug"), "slug").withColumn("platform_rank", rank).filter("platform_rank > 0")
    return first_by(found, ["name"], "slug_rank", "platform_rank").select("name", "platform", "slug", F.trim("name").alias("label"))


def new_companies(names: DataFrame, known: DataFrame, attempted: DataFrame, misses: DataFrame) -> DataFrame:
    """Listed names neither known nor attempted, and no recorded miss unless they come with hints."""
    key = lambda d: d.select(F.lower(F.trim("name")).alias("_n")).distinct()
    own = names.withColumn("_key", F.lower(F.trim("name")))
    left = own.join(key(known), F.col("_key") == F.col("_n"), "left_anti").join(key(attempted), F.col("_key") == F.col("_n"), "left_anti")
    missed = key(misses).withColumn("_missed", F.lit(True))
    out = left.join(missed, F.col("_key") == F.col("_n"), "left").filter(F.col("_missed").isNull() | (F.size(F.coalesce("hints", F.array())) > 0))
    return out.drop("_key", "_n", "_missed")


def live_count(platform, payload, status):
    """Open postings of a probe's payload by platform; -1 where it is no answer."""
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object(payload, path)), F.lit(0))
    count = (
        F.when(platform.isin("greenhouse", "ashby", "workable"), size("$.jobs"))
        .when(platform == "lever", F.coalesce(F.json_array_length(payload), F.lit(0)))
        .when(platform == "smartrecruiters", F.coalesce(F.get_json_object(payload, "$.totalFound").cast("int"), F.lit(0)))
        .when(platform == "recruitee", size("$.offers"))
        .when(platform == "workday", F.coalesce(F.get_json_object(payload, "$.total").cast("int"), F.lit(0)))
        .when(platform == "oracle", F.coalesce(F.get_json_object(payload, "$.items[0].TotalJobsCount").cast("int"), F.lit(0)))
        .otherwise(-1)
    )
    return F.when((status == 200) & payload.isNotNull(), count).otherwise(-1)


def verified_watchlist(watchlist: DataFrame, probes: DataFrame) -> DataFrame:
    """Every board with its live count and whether it is live, empty or unreachable."""
    seen = probes.select("platform", "slug", live_count(F.col("platform"), F.col("payload"), F.col("http_status")).alias("live"))
    joined = watchlist.join(seen, ["platform", "slug"], "left").withColumn("live", F.coalesce("live", F.lit(-1)))
    return joined.withColumn("state", F.when(F.col("live") > 0, "live").when(F.col("live") == 0, "empty").otherwise("unreachable"))


def add_to_watchlist(watchlist: DataFrame, found: DataFrame) -> DataFrame:
    """Appended unless (platform, slug) is there."""
    return watchlist.unionByName(found.join(watchlist.select("platform", "slug"), ["platform", "slug"], "left_anti"), allowMissingColumns=True)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources one after another, with their order."""
    return reduce(DataFrame.unionByName, [f.withColumn("source_order", F.lit(i)) for i, f in enumerate(frames)])


def except_keys(keys: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct keys in none of the others."""
    return reduce(lambda left, o: left.join(o.select("key"), "key", "left_anti"), others, keys.select("key").distinct())
