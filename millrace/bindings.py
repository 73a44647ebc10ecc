"""Bindings of the driver's tables to the operators, each with the same binding in DuckDB SQL.

Keys are the operator's ID and name. Bindings B1 to B10 say which columns play a
posting's or a tracker's part.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import dates, keys, text, urls
from millrace.operators import filters, joins, ordered, prune, scoring, stats, tracker
from millrace.schemas import TRACKER_TYPES, with_columns_of
from millrace.plans import cycle
from millrace.sources import files, lists, normalize, sinks
from millrace.streaming import alerts

NOW = "2024-06-01T00:00:00+00:00"
TODAY = datetime.date(1998, 6, 15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, if given, its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- B1: documents as postings ------------------------------------------------------


def b1(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("company"), F.lit("").alias("location"), F.lit("").alias("salary"),
        F.lit("").alias("url"), F.col("text").alias("description"), F.col("lang").alias("source"), F.col("doc_id").alias("ord"),
    )


B1 = """b1 AS (SELECT split_part(text, chr(10), 1) AS title, source AS company, '' AS location, '' AS url,
  text AS description, lang AS source, doc_id AS ord FROM documents)"""
KEYED = B1 + """, keyed AS (SELECT *, lower(title || '|' || company) AS k,
  substring(sha256(lower(regexp_replace(title || '|' || company, '^\\s+|\\s+$', '', 'g'))), 1, 16) AS fp FROM b1)"""
SMALL_RULES = {"shout": [r"!!"], "cells": [r" \| "], "marks": [r"[%$&#*]{3}"], "_note": ["never read"]}


@query("f3_fingerprint", f"WITH {KEYED} SELECT ord, fp FROM keyed")
def _(spark, d):
    return joins.with_fingerprint(b1(spark, d)).select("ord", "fp")


@query(
    "f4_f5_row_and_dedupe_keys",
    f"WITH {B1} SELECT ord, lower(title || '|' || company) AS dedupe_key, lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g') || '|' || company) AS row_key FROM b1",
)
def _(spark, d):
    c = [F.col(x) for x in ("url", "title", "company")]
    return b1(spark, d).select("ord", keys.dedupe_key(*c).alias("dedupe_key"), keys.row_key(*c).alias("row_key"))


@query("g1_dedupe", f"WITH {KEYED} SELECT min(ord) AS ord, company FROM keyed GROUP BY k, company")
def _(spark, d):
    return ordered.dedupe(b1(spark, d)).select("ord", "company")


@query(
    "p1_keyword_prefilter",
    f"""WITH {B1}, t AS (SELECT *, lower(title || ' ' || description) AS x FROM b1)
SELECT ord, company FROM t WHERE NOT regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])was\\s+the($|[^\\p{{L}}\\p{{N}}_])')
AND regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])(the|la|der)($|[^\\p{{L}}\\p{{N}}_])') AND regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])of($|[^\\p{{L}}\\p{{N}}_])')""",
)
def _(spark, d):
    return filters.keyword_prefilter(b1(spark, d), include=["the", "la", "der"], require=["of"], exclude=["was the"]).select("ord", "company")


GATED = f"""{B1}, gated AS (SELECT *, CASE WHEN contains(lower(source), 'es') THEN 'source' WHEN regexp_matches(title, '!!') THEN 'shout'
  WHEN regexp_matches(title, ' \\| ') THEN 'cells' WHEN regexp_matches(title, '[%$&#*]{{3}}') THEN 'marks' END AS rule FROM b1)"""


def gated(spark, d) -> DataFrame:
    return filters.gate(b1(spark, d), filters.GateRules(blocked_sources=["es"], title_reject=SMALL_RULES, location_allow=[], location_deny=[]))


@query("p3_p4_p6_gate", f"WITH {GATED} SELECT ord, rule FROM gated")
def _(spark, d):
    return gated(spark, d).select("ord", F.col("gate.rule").alias("rule"))


@query("a10_gate_rule_counts", f"WITH {GATED} SELECT rule, count(*) AS n FROM gated WHERE rule IS NOT NULL GROUP BY rule")
def _(spark, d):
    deduped = b1(spark, d)
    kept = filters.gate(deduped, filters.GateRules(blocked_sources=["es"], title_reject=SMALL_RULES, location_allow=[], location_deny=[]))
    return stats.gate_rule_counts(kept)


@query(
    "p4_gate_title_detail",
    """SELECT p_partkey, regexp_extract(t, '(?i)\\bring\\b|\\bgear\\b', 0) AS detail FROM (SELECT p_partkey, p_type || ' ' || p_name AS t FROM part)
WHERE regexp_matches(t, '(?i)\\bring\\b|\\bgear\\b')""",
)
def _(spark, d):
    t = table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_type", "p_name"))
    g = t.withColumn("gate", filters.gate_title(F.col("title"), {"metal": [r"\bring\b", r"\bgear\b"]}))
    return g.filter("gate is not null").select("p_partkey", F.col("gate.detail").alias("detail"))


@query("c9_run_summary", f"WITH {GATED} SELECT count(*) AS rows, count(*) FILTER (rule IS NULL) AS passed, count(rule) AS gated FROM gated")
def _(spark, d):
    return scoring.run_summary(gated(spark, d))


@query(
    "c8_gated_rows_output",
    f"WITH {GATED} SELECT ord, 0 AS score, false AS suitable, 'gated: source (es)' AS concerns FROM gated WHERE rule = 'source'",
)
def _(spark, d):
    return scoring.gated_rows_output(gated(spark, d), NOW).filter("gate.rule = 'source'").select("ord", "score", "suitable", "concerns")


@query(
    "a8_progress",
    f"""WITH {KEYED}, g AS (SELECT *, regexp_matches(title, '!!') OR regexp_matches(title, ' \\| ') AS bad FROM keyed),
f AS (SELECT fp, count(*) AS rows, bool_or(bad) AS bad FROM g GROUP BY fp),
s AS (SELECT DISTINCT fp FROM g WHERE ord % 3 = 0), m AS (SELECT DISTINCT fp FROM g WHERE ord % 9 = 0),
x AS (SELECT f.*, s.fp IS NOT NULL AS seen, m.fp IS NOT NULL AS matched FROM f LEFT JOIN s USING (fp) LEFT JOIN m USING (fp)),
o AS (SELECT CAST(sum(rows) AS BIGINT) AS total, count(*) FILTER (seen) AS scored, count(*) FILTER (NOT seen) AS remaining,
  count(*) FILTER (matched) AS scrape_matches, count(*) FILTER (NOT seen AND bad) AS gated_ahead FROM x)
SELECT *, scored - scrape_matches AS scrape_no_match, CASE WHEN remaining = 0 THEN 'last scrape' ELSE 'this scrape' END AS scrape_label,
  (remaining - gated_ahead) * 75 AS eta_seconds FROM o""",
)
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    gate_rules = filters.GateRules(blocked_sources=[], title_reject={"shout": ["!!"], "cells": [r" \| "]}, location_allow=[], location_deny=[])
    return stats.progress(p, p.filter("ord % 3 = 0"), p.filter("ord % 9 = 0"), gate_rules)


@query(
    "j3_u3_scrape_matches",
    f"WITH {KEYED} SELECT count(*) AS scrape_matches FROM (SELECT fp FROM keyed WHERE ord % 2 = 0 INTERSECT SELECT fp FROM keyed WHERE ord % 3 = 0)",
)
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    return joins.scrape_matches(p.filter("ord % 2 = 0"), p.filter("ord % 3 = 0"))


@query(
    "j1_new_postings",
    f"WITH {KEYED} SELECT ord, fp FROM keyed WHERE fp NOT IN (SELECT fp FROM keyed WHERE ord % 4 = 0)",
)
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    return joins.new_postings(p, p.filter("ord % 4 = 0").select("fp")).select("ord", "fp")


@query(
    "a7_unscored_by_company",
    f"""WITH {KEYED}, u AS (SELECT fp, company FROM keyed WHERE fp NOT IN (SELECT fp FROM keyed WHERE ord % 4 = 0) GROUP BY fp, company)
SELECT company, count(*) AS n FROM u GROUP BY company ORDER BY n DESC, company LIMIT 15""",
)
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    return stats.unscored_by_company(p, p.filter("ord % 4 = 0").select("fp").distinct())


@query(
    "a9_company_detail",
    f"""WITH {KEYED}, c AS (SELECT * FROM keyed WHERE contains(lower(company), 'src1')), s AS (SELECT DISTINCT fp FROM keyed WHERE ord % 3 = 0)
SELECT (SELECT count(*) FROM c) AS postings, (SELECT count(DISTINCT c.fp) FROM c JOIN s USING (fp)) AS scored,
  (SELECT count(*) FROM c WHERE ord % 5 = 0) AS matches, (SELECT CAST(max(ord % 11) AS INT) FROM c WHERE ord % 5 = 0) AS best_score""",
)
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    m = p.filter("ord % 5 = 0").withColumn("score", (F.col("ord") % 11).cast("int"))
    return stats.company_detail(p, p.filter("ord % 3 = 0"), m, "SRC1")


@query(
    "a5_source_breakdown",
    """WITH g AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'watchlist (' || lang || ')' ELSE source END AS source FROM documents),
c AS (SELECT source, count(*) AS n FROM g GROUP BY source), t AS (SELECT sum(n) AS t FROM c)
SELECT source, n, CAST(round_even(100.0 * n / t, 0) AS INT) AS pct FROM c, t""",
)
def _(spark, d):
    t = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(":"), "source")).otherwise(F.col("source")).alias("source"))
    return stats.source_breakdown(t)


@query(
    "n5_hn_fields",
    f"""WITH {B1}, p AS (SELECT ord, title, list_transform(string_split(title, '|'), lambda x: trim(x)) AS parts FROM b1)
SELECT ord, CASE WHEN len(parts) >= 2 THEN parts[2][1:150] ELSE title[1:120] END AS title, CASE WHEN len(parts) >= 2 THEN parts[1][1:100] ELSE '' END AS company,
CASE WHEN len(parts) >= 2 THEN COALESCE(parts[3], '')[1:100] ELSE '' END AS location FROM p""",
)
def _(spark, d):
    return b1(spark, d).select("ord", normalize.hn_fields(F.col("title")).alias("f")).select("ord", "f.*")


# --- B3: suppliers' places -----------------------------------------------------------

B3 = "b3 AS (SELECT s_suppkey, n_name || '; ' || r_name AS location, s_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def b3(spark, d) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("s_suppkey", F.concat_ws("; ", "n_name", "r_name").alias("location"), F.col("s_name").alias("company"))


@query(
    "p2_location_prefilter",
    f"""WITH {B3}, p AS (SELECT s_suppkey, location, unnest(list_transform(string_split(lower(location), ';'), lambda x: trim(x))) AS place FROM b3)
SELECT DISTINCT s_suppkey, location FROM p WHERE regexp_matches(place, '\\b(asia|nation_1|nation_7|europe)\\b') AND NOT regexp_matches(place, '\\b(europe|nation_7)\\b')""",
)
def _(spark, d):
    return filters.location_prefilter(b3(spark, d), ["asia", "nation_1", "nation_7", "europe"], ["europe", "nation_7"]).select("s_suppkey", "location")


@query("f27_split_places", f"WITH {B3} SELECT s_suppkey, unnest(list_transform(string_split(lower(location), ';'), lambda x: trim(x))) AS place FROM b3")
def _(spark, d):
    return b3(spark, d).select("s_suppkey", F.explode(text.split_places(F.col("location"))).alias("place"))


@query(
    "p5_gate_location",
    f"""WITH {B3} SELECT s_suppkey, regexp_extract(location, '(?i)\\bamerica\\b|\\bnation_(1|2)\\b', 0) AS detail FROM b3
WHERE regexp_matches(location, '(?i)\\bamerica\\b|\\bnation_(1|2)\\b') AND NOT regexp_matches(location, '(?i)\\bnation_1\\b')""",
)
def _(spark, d):
    g = b3(spark, d).withColumn("gate", filters.gate_location(F.col("location"), [r"\bnation_1\b"], [r"\bamerica\b", r"\bnation_(1|2)\b"]))
    return g.filter("gate is not null").select("s_suppkey", F.col("gate.detail").alias("detail"))


@query("a6_location_breakdown", f"WITH {B3} SELECT left(location, 35) AS location, count(*) AS n FROM b3 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def _(spark, d):
    return stats.location_breakdown(b3(spark, d), 15)


# --- B4: orders as tracker -------------------------------------------------------------


def b4(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.concat(F.lit("k"), k.cast("string")).alias("key"), F.concat(F.lit("Order "), (k % 97).cast("string")).alias("title"),
        F.col("o_orderpriority").alias("company"), F.concat(F.lit("place "), (k % 13).cast("string")).alias("location"), (k % 11).cast("int").alias("score"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("date_processed"),
        F.when(k % 7 == 0, NOW).alias("deleted_at"), F.when(k % 7 == 0, F.when(k % 2 == 0, "prune").otherwise("user")).alias("deleted_reason"),
        F.when(k % 5 == 0, "applied").alias("date_applied"), F.when(k % 17 == 0, "a_b%c").alias("notes"), F.col("o_orderstatus").alias("source"),
    )
    return with_columns_of(rows, TRACKER_TYPES)


B4 = f"""b4 AS (SELECT 'k' || o_orderkey AS key, 'Order ' || (o_orderkey % 97) AS title, o_orderpriority AS company, 'place ' || (o_orderkey % 13) AS location,
  CAST(o_orderkey % 11 AS INT) AS score, nullif(o_orderstatus, 'P') AS status, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS date_processed,
  CASE WHEN o_orderkey % 7 = 0 THEN '{NOW}' END AS deleted_at, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'prune' ELSE 'user' END END AS deleted_reason,
  CASE WHEN o_orderkey % 5 = 0 THEN 'applied' END AS date_applied, CASE WHEN o_orderkey % 17 = 0 THEN 'a_b%c' END AS notes, o_orderstatus AS source, o_orderkey FROM orders)"""


@query("a1_score_distribution", f"WITH {B4} SELECT score, count(*) AS n FROM b4 WHERE deleted_at IS NULL AND score IS NOT NULL GROUP BY score")
def _(spark, d):
    return stats.score_distribution(b4(spark, d))


@query(
    "a2_top_companies",
    f"WITH {B4} SELECT company, count(*) AS n, avg(score) AS avg_score, max(score) AS max_score FROM b4 WHERE deleted_at IS NULL AND company <> '' GROUP BY company ORDER BY n DESC, avg_score DESC, company LIMIT 3",
)
def _(spark, d):
    return stats.top_companies(b4(spark, d), 3)


@query("a3_status_breakdown", f"WITH {B4} SELECT COALESCE(NULLIF(status, ''), 'Not started') AS status, count(*) AS n FROM b4 WHERE deleted_at IS NULL GROUP BY 1")
def _(spark, d):
    return stats.status_breakdown(b4(spark, d))


@query("a4_tracker_counts", f"WITH {B4} SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, count(deleted_at) AS deleted FROM b4")
def _(spark, d):
    return stats.tracker_counts(b4(spark, d))


@query("a14_distinct_values", f"WITH {B4} SELECT DISTINCT company FROM b4 WHERE deleted_at IS NULL AND company <> ''")
def _(spark, d):
    return stats.distinct_values(b4(spark, d), "company")


@query(
    "p16_search",
    f"WITH {B4} SELECT key, score FROM b4 WHERE deleted_at IS NULL AND (title ILIKE '%r 1_%' OR company ILIKE '%r 1_%' OR location ILIKE '%r 1_%' OR notes ILIKE '%r 1_%') AND score >= 4 AND status IS NULL",
)
def _(spark, d):
    return tracker.search(b4(spark, d), q="R 1_", status="__none__", min_score=4).select("key", "score")


@query("p16_search_archived", f"WITH {B4} SELECT key, status FROM b4 WHERE deleted_at IS NOT NULL AND company = '5-LOW' AND status = 'F'")
def _(spark, d):
    return tracker.search(b4(spark, d), company="5-LOW", status="F", archived=True, sort="company").select("key", "status")


for _name, _sql in {
    "date": "date_processed DESC NULLS LAST, score DESC NULLS LAST", "score": "score DESC NULLS LAST, date_processed DESC NULLS LAST",
    "company": "lower(company) NULLS FIRST, score DESC NULLS LAST", "title": "lower(title) NULLS FIRST",
    "status": "status IS NULL, lower(status) NULLS FIRST, score DESC NULLS LAST",
}.items():

    @query(f"o1_o2_sort_{_name}_limit", f"WITH {B4} SELECT key, score FROM b4 WHERE deleted_at IS NULL ORDER BY {_sql}, key LIMIT 40")
    def _(spark, d, name=_name):
        return tracker.search(b4(spark, d), sort=name, limit=40).select("key", "score")


@query("g12_recent", f"WITH {B4} SELECT key, date_processed FROM b4 ORDER BY date_processed DESC NULLS LAST, score DESC NULLS LAST, key LIMIT 10")
def _(spark, d):
    return ordered.recent(b4(spark, d), 10).select("key", "date_processed")


@query("p19_get_by_key", f"WITH {B4} SELECT key, title FROM b4 WHERE key = 'k101'")
def _(spark, d):
    return tracker.get_by_key(b4(spark, d), "k101").select("key", "title")


@query(
    "t2_update_user_fields",
    f"""WITH {B4}, e AS (SELECT key, arg_max(v, ord) AS v FROM (SELECT 'k' || (event_id % 3000) AS key, event_type AS v, event_id AS ord FROM events) GROUP BY key)
SELECT key, COALESCE(v, status) AS status, notes FROM b4 LEFT JOIN e USING (key)""",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 3000).cast("string")).alias("key"), F.col("event_type").alias("status"), F.col("event_id").alias("ord"))
    return tracker.update_user_fields(b4(spark, d), e, NOW).select("key", "status", "notes")


@query(
    "t3_soft_delete",
    f"""WITH {B4} SELECT key, CASE WHEN deleted_at IS NULL AND o_orderkey % 3 = 0 THEN 'review' ELSE deleted_reason END AS deleted_reason,
CASE WHEN deleted_at IS NULL AND o_orderkey % 3 = 0 THEN 'later' ELSE deleted_at END AS deleted_at FROM b4""",
)
def _(spark, d):
    t = b4(spark, d)
    k = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"))
    return tracker.soft_delete(t, k, "review", "later").select("key", "deleted_reason", "deleted_at")


@query(
    "t4_t7_undo_prune",
    f"WITH {B4} SELECT key, CASE WHEN deleted_reason = 'prune' THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN deleted_reason = 'prune' THEN NULL ELSE deleted_reason END AS deleted_reason FROM b4",
)
def _(spark, d):
    return tracker.undo_prune(b4(spark, d), "prune", NOW).select("key", "deleted_at", "deleted_reason")


@query(
    "j7_t8_archive_classify",
    f"""WITH {B4}, k AS (SELECT 'k' || event_id AS key FROM events) SELECT k.key, CASE WHEN b4.key IS NULL THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'already'
WHEN COALESCE(trim(status), '') <> '' OR COALESCE(trim(date_applied), '') <> '' THEN 'engaged' ELSE 'to_archive' END AS outcome FROM k LEFT JOIN b4 USING (key)""",
)
def _(spark, d):
    k = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"))
    return joins.archive_classify(k, b4(spark, d))


@query(
    "j2_insert_new",
    f"""WITH {B4}, n AS (SELECT 'k' || (event_id * 2) AS key, min(event_id) AS ord, CAST(arg_min(event_id, event_id) % 11 AS INT) AS score FROM events GROUP BY 1)
SELECT key, score FROM b4 UNION ALL SELECT key, score FROM n WHERE key NOT IN (SELECT key FROM b4)""",
)
def _(spark, d):
    n = table(spark, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") * 2).cast("string")).alias("key"), (F.col("event_id") % 11).cast("int").alias("score"), F.col("event_id").alias("ord"))
    return joins.insert_new(b4(spark, d), n, NOW).select("key", "score")


@query(
    "s4_export_projection",
    f"""WITH {B4} SELECT CAST(score AS VARCHAR) AS "Score", title AS "Job Title", company AS "Company", strftime(CAST(date_processed AS TIMESTAMP), '%b %-d') AS "Date Found",
COALESCE(status, '') AS "Status", COALESCE(notes, '') AS "Notes" FROM b4 WHERE deleted_at IS NULL""",
)
def _(spark, d):
    return sinks.export_projection(b4(spark, d)).select("Score", "Job Title", "Company", "Date Found", "Status", "Notes")


@query(
    "s7_g11_snapshot_retention",
    """WITH s AS (SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS snapshot_date FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY snapshot_date DESC) AS rn FROM s)
SELECT snapshot_date, rn > 14 AND snapshot_date <> '1996-01-01' AS "drop" FROM r""",
)
def _(spark, d):
    months = table(spark, d, "orders").select(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("snapshot_date")).distinct()
    return ordered.latest_snapshots(months, 14, ["1996-01-01"])


@query("t6_prune_internships", f"WITH {B4} SELECT key FROM b4 WHERE deleted_at IS NULL AND title = 'Order 7' AND COALESCE(status, '') = '' AND COALESCE(date_applied, '') = ''")
def _(spark, d):
    t = b4(spark, d).withColumn("title", F.when(F.col("title") == "Order 7", "Summer Intern 7").otherwise(F.col("title")))
    return tracker.prune_internships(t, NOW)[0]


@query(
    "j8_g7_g8_bootstrap_plan",
    f"""WITH s AS (SELECT DISTINCT 'k' || (o_orderkey % 4000) AS key FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT DISTINCT 'k' || (event_id % 5000) AS key FROM events WHERE event_id % 3 = 0),
p AS (SELECT DISTINCT 'k' || c_custkey AS key FROM customer) SELECT key, CASE WHEN s.key IS NOT NULL AND l.key IS NOT NULL THEN 'live-matched' WHEN s.key IS NOT NULL THEN 'live-inferred'
WHEN l.key IS NOT NULL THEN 'import-csv' ELSE 'import-prune' END AS plan FROM s FULL JOIN l USING (key) FULL JOIN p USING (key)""",
)
def _(spark, d):
    key = lambda c: F.concat(F.lit("k"), c.cast("string")).alias("key")
    s = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(key(F.col("o_orderkey") % 4000), F.col("o_orderkey").alias("ord"))
    ev = table(spark, d, "events").filter("event_id % 3 = 0").select(key(F.col("event_id") % 5000), F.col("event_id").alias("ord"))
    return joins.bootstrap_plan(s, ev, table(spark, d, "customer").select(key(F.col("c_custkey"))))


@query("u2_except_keys", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND o_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"))
    return joins.except_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), c, table(spark, d, "events").select(F.col("user_id").alias("key")))


@query("g7_last_wins_by_key", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return ordered.last_wins_by_key(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


# --- B2, B5: parts as scored postings ---------------------------------------------------


def b5(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    skills = F.transform(F.slice(F.array(*[F.lit(f"s{i}") for i in range(5)]), F.lit(1), (k % 6).cast("int")), lambda x: x)
    return table(spark, d, "part").select(
        k.alias("k"), F.concat_ws(" ", "p_type", "p_name").alias("title"), F.col("p_brand").alias("company"), F.when(k % 2 == 0, "New York, NY").otherwise("Paris").alias("location"),
        pick(rules.ROLE_FAMILIES).alias("role_family"), pick(rules.SENIORITIES).alias("seniority"), (k % 3).cast("int").alias("min_years_experience"),
        pick(rules.START_TIMINGS).alias("start_timing"), (k % 29 == 0).alias("clearance_required"), (k % 31 == 0).alias("advanced_degree_required"),
        skills.alias("matched_skills"), F.lit("").alias("evidence"),
    )


def _case(column: str, table_: dict, default: int = 0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


def _nth(words) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[p_partkey % {len(words)} + 1]"


B5 = f"""b5 AS (SELECT p_partkey AS k, p_brand AS company, p_type || ' ' || p_name AS title, p_partkey % 2 = 0 AS ny, {_nth(rules.ROLE_FAMILIES)} AS fam, {_nth(rules.SENIORITIES)} AS sen, p_partkey % 3 AS yrs,
  {_nth(rules.START_TIMINGS)} AS st, p_partkey % 29 = 0 AS clr, p_partkey % 31 = 0 AS deg, p_partkey % 6 AS sk FROM part),
r5 AS (SELECT *, concat_ws('; ', CASE WHEN fam = 'non_technical' THEN 'non-technical role' END, CASE WHEN sen = 'senior_plus' THEN 'senior/staff-level role' END,
  CASE WHEN sen = 'intern' THEN 'internship or temporary position' END, CASE WHEN yrs > 1 THEN 'requires ' || yrs || '+ years experience' END, CASE WHEN st = '2026_or_earlier' THEN 'starts 2026 or earlier' END,
  CASE WHEN clr THEN 'active security clearance required' END, CASE WHEN deg THEN 'MS/PhD required' END) AS rej FROM b5),
s5 AS (SELECT *, CAST(CASE WHEN rej <> '' THEN 1 ELSE least(10, greatest(0, {_case('fam', rules.FAMILY_BASE, 3)} + {_case('sen', rules.SENIORITY_DELTA)} + {_case('st', rules.START_DELTA)}
  + CASE WHEN ny THEN 1 ELSE 0 END + CASE WHEN fam IN ('security', 'ml_ai') THEN 1 ELSE 0 END + CASE WHEN least(sk, 5) >= 3 THEN 1 ELSE 0 END)) END AS INT) AS score FROM r5)"""


@query("c3_c4_c5_score", f"WITH {B5} SELECT k, score, score >= 7 AS suitable FROM s5")
def _(spark, d):
    return scoring.score(b5(spark, d)).select("k", "score", "suitable")


@query(
    "c6_c7_verdict_row",
    f"""WITH {B5} SELECT k, CASE WHEN rej <> '' THEN rej ELSE concat_ws('; ', CASE WHEN sen = 'unclear' THEN 'level not stated in posting' END, CASE WHEN st = 'unclear' THEN 'start date not stated' END,
CASE WHEN fam = 'other_technical' THEN 'technical but outside target role families' END) END AS concerns, fam || '/' || sen || ', ' || yrs || 'y exp, starts ' || st || '.' AS reason FROM s5""",
)
def _(spark, d):
    return scoring.verdict_row(scoring.score(b5(spark, d)), NOW).select("k", "concerns", "reason")


@query(
    "c1_parse_classification",
    "SELECT p_partkey AS k, p_partkey % 5 <> 0 AND p_size <= 15 AS ok FROM part",
)
def _(spark, d):
    k = F.col("p_partkey")
    made = table(spark, d, "part").select(
        k.alias("k"),
        F.to_json(
            F.struct(
                F.when(k % 5 == 0, "poet").otherwise("data").alias("role_family"), F.lit("junior").alias("seniority"), F.col("p_size").alias("min_years_experience"), F.lit("unclear").alias("start_timing"),
                F.lit(False).alias("clearance_required"), F.lit(False).alias("advanced_degree_required"), F.array(F.lit("SQL")).alias("matched_skills"), F.lit("x").alias("evidence"),
            )
        ).alias("answer"),
    )
    good, bad = scoring.parse_classification(made, "answer")
    return good.select("k", F.lit(True).alias("ok")).unionByName(bad.select("k", F.lit(False).alias("ok")))


@query("c10_batch_health", "SELECT count(*) AS scored, count(*) FILTER (p_size > 20) AS errors, NOT (count(*) > 0 AND count(*) = count(*) FILTER (p_size > 20)) AS usable FROM part")
def _(spark, d):
    return scoring.batch_health(table(spark, d, "part").select((F.col("p_size") > 20).alias("failed")))


TITLES = ["Security Engineer", "ML Engineer", "Backend Engineer", "Senior Security Engineer", "Sales Engineer"]


def b2(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("k"), k.cast("string")).alias("key"), F.element_at(F.array(*map(F.lit, TITLES)), (k % 5 + 1).cast("int")).alias("title"), F.col("p_brand").alias("company"),
        F.when(k % 3 == 0, "New York").when(k % 3 == 1, "Boston").otherwise("Oslo").alias("location"), (F.col("p_size") % 11).cast("int").alias("score"), F.when(k % 50 == 0, "keep").alias("notes"),
    )
    return with_columns_of(rows, TRACKER_TYPES)


@query(
    "g9_g10_plan_prunes",
    """WITH r AS (SELECT 'k' || p_partkey AS key, p_partkey % 5 AS t, p_brand AS company, p_partkey % 3 AS l, p_size % 11 AS score FROM part WHERE p_partkey % 50 <> 0),
e AS (SELECT *, CASE WHEN t = 3 THEN 'too senior' WHEN t = 4 THEN 'non-engineering' WHEN l = 2 THEN 'location' END AS why FROM r),
k AS (SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY company ORDER BY CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END, l, score DESC, key) AS rn FROM e WHERE why IS NULL) WHERE rn <= 2)
SELECT key, COALESCE(why, 'over the limit') AS why FROM e WHERE key NOT IN (SELECT key FROM k)""",
)
def _(spark, d):
    return prune.plan_prunes(b2(spark, d))


@query("a12_prune_summary", "SELECT count(*) AS before, (SELECT count(*) FROM part WHERE p_size > 25) AS pruned, count(*) FILTER (p_size <= 25) AS kept FROM part")
def _(spark, d):
    t = b2(spark, d)
    gone = table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"))
    return stats.prune_summary(t, gone)


@query(
    "f19_j9_first_board_hit",
    """WITH n AS (SELECT DISTINCT p_brand || ' ' || p_type || ' Corp' AS name FROM part), s AS (SELECT name, lower(regexp_replace(name, ' Corp$', '')) AS b FROM n),
v AS (SELECT name, 0 AS r, regexp_replace(b, '[^a-z0-9]', '', 'g') AS slug FROM s UNION ALL SELECT name, 1, regexp_replace(b, '[^a-z0-9]+', '-', 'g') FROM s),
p AS (SELECT DISTINCT regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug, 'lever' AS platform, 1 AS pr FROM part WHERE p_size > 10
  UNION SELECT DISTINCT regexp_replace(lower(p_brand || p_type), '[^a-z0-9]', '', 'g'), 'ashby', 2 FROM part WHERE p_size > 40)
SELECT name, platform, slug, name AS label FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, pr) AS rn FROM v JOIN p USING (slug)) WHERE rn = 1""",
)
def _(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.concat_ws(" ", "p_brand", "p_type", F.lit("Corp")).alias("name"), F.array().cast("array<string>").alias("hints")).distinct()
    v = text.slug_variants(F.concat_ws(" ", "p_brand", "p_type"))
    lever = p.filter("p_size > 10").select(F.lit("lever").alias("platform"), v[1].alias("slug"), F.lit(True).alias("present")).distinct()
    ashby = p.filter("p_size > 40").select(F.lit("ashby").alias("platform"), v[0].alias("slug"), F.lit(True).alias("present")).distinct()
    return joins.first_board_hit(names, lever.unionByName(ashby))


@query(
    "j11_a13_watchlist_audit",
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) END AS live FROM customer)
SELECT CASE WHEN live > 0 THEN 'live' WHEN live = 0 THEN 'empty' ELSE 'unreachable' END AS state, count(*) AS n FROM b GROUP BY 1""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.lit("greenhouse").alias("platform"), F.col("c_custkey").cast("string").alias("slug"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("_s")).agg(F.collect_list(F.struct("o_orderkey")).alias("jobs"))
    jobs = F.to_json(F.struct(F.coalesce("jobs", F.array().cast("array<struct<o_orderkey:bigint>>")).alias("jobs")))
    probes = c.join(o, F.col("slug") == F.col("_s"), "left").select("platform", "slug", F.when(F.col("slug").cast("int") % 4 == 0, 500).otherwise(200).alias("http_status"), jobs.alias("payload"))
    return stats.watchlist_audit_rollup(joins.verified_watchlist(c, probes))


@query(
    "a16_board_samples",
    """WITH j AS (SELECT o_custkey, 'Order ' || o_orderkey || ' [' || o_orderpriority || ']' AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS open FROM orders),
f AS (SELECT o_custkey, any_value(open) AS open, string_agg(s, '; ' ORDER BY rn) FILTER (rn <= 3) AS sample FROM j GROUP BY 1)
SELECT 'lever' AS platform, CAST(c_custkey AS VARCHAR) AS slug, COALESCE(open, 0) AS open, COALESCE(sample, '(no open jobs)') AS sample FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
)
def _(spark, d):
    boards = table(spark, d, "customer").select(F.lit("lever").alias("platform"), F.col("c_custkey").cast("string").alias("slug"))
    jobs = table(spark, d, "orders").select(
        F.lit("lever").alias("platform"), F.col("o_custkey").cast("string").alias("slug"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("location"), F.col("o_orderkey").alias("ord"),
    )
    return stats.board_samples(boards, jobs)


@query("j12_add_to_watchlist", "SELECT 'lever' AS platform, c_custkey AS slug FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT 'lever', o_custkey FROM orders WHERE o_custkey % 2 = 1")
def _(spark, d):
    w = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("lever").alias("platform"), F.col("c_custkey").alias("slug"))
    return joins.add_to_watchlist(w, table(spark, d, "orders").select(F.lit("lever").alias("platform"), F.col("o_custkey").alias("slug")).distinct())


@query("j10_new_companies", "SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 <> 0 AND (c_custkey % 5 <> 0 OR c_custkey % 7 = 0)")
def _(spark, d):
    c = table(spark, d, "customer")
    at = lambda cond: c.filter(cond).select(F.upper("c_name").alias("name"))
    names = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("hint"))).otherwise(F.array().cast("array<string>")).alias("hints"))
    return joins.new_companies(names, at("c_custkey % 2 = 0"), at("c_custkey % 3 = 0"), at("c_custkey % 5 = 0")).select("name")


# --- B6: pages --------------------------------------------------------------------------


@query(
    "f6_clean_url",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '(#.*)$', 1) AS h, split_part(split_part(url, '#', 1), '?', 1) AS path, regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '') AS a FROM p), f AS (SELECT *, list_filter(a, lambda x: NOT regexp_matches(x, '(?i)^(utm_[^=]*|ref)(=|$)')) AS b FROM k)
SELECT page_id, CASE WHEN len(a) = len(b) THEN url ELSE path || CASE WHEN len(b) > 0 THEN '?' || array_to_string(b, '&') ELSE '' END || h END AS url FROM f""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.clean_url(F.col("url")).alias("url"))


_ENCODED = """replace(replace(replace(replace(replace(url_encode({c}), '%3A', ':'), '%2F', '/'), '%2C', ','), '%3B', ';'), '%3D', '=')"""


@query(
    "f6_clean_url_encoded",
    f"""WITH u AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) || '?a=b+c&k&%75tm_x=1&REF=2&q=%E2%82%AC*~/:' || page_id AS url FROM pages),
p AS (SELECT page_id, url, split_part(url, '?', 1) AS path, list_transform(string_split(split_part(url, '?', 2), '&'), lambda x: struct_pack(
  k := url_decode(replace(split_part(x, '=', 1), '+', ' ')),
  v := url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' ')))) AS a FROM u),
k AS (SELECT page_id, path, list_filter(a, lambda x: NOT regexp_matches(x.k, '(?i)^(utm_.*|ref)$')) AS b FROM p)
SELECT page_id, path || '?' || array_to_string(list_transform(b, lambda x: {_ENCODED.format(c="x.k")} || '=' || {_ENCODED.format(c="x.v")}), '&') AS url FROM k""",
)
def _(spark, d):
    """F6 where names and values are encoded in other ways than the one the rule gives."""
    path = F.split_part(F.split_part(F.col("url"), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    url = F.concat(path, F.lit("?a=b+c&k&%75tm_x=1&REF=2&q=%E2%82%AC*~/:"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", urls.clean_url(url).alias("url"))


@query(
    "f1_character_references",
    """SELECT doc_id, '’' || COALESCE(source, '') || ' – ç ♥ &#39; & < ' || doc_id || chr(CAST(192 + doc_id % 1000 AS INT)) AS text FROM documents""",
)
def _(spark, d):
    """references by number and by name, decoded once."""
    raw = F.concat(
        F.lit("&#8217;"), F.coalesce("source", F.lit("")), F.lit(" &#x2013; &ccedil; &hearts; &amp;#39; &#38; &lt; "), F.col("doc_id").cast("string"),
        F.lit("&#"), (F.lit(192) + F.col("doc_id") % 1000).cast("string"), F.lit(";"),
    )
    return table(spark, d, "documents").select("doc_id", text.unescape(raw).alias("text"))


@query(
    "f9_cell_urls_decoded",
    """SELECT page_id, list_concat(list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1), lambda x: replace(x, '&amp;', '&')), [url || '?a=1&b=2']) AS links FROM pages""",
)
def _(spark, d):
    """hrefs, then a Markdown link that carries a reference."""
    cell = F.concat("html", F.lit("[x]("), "url", F.lit("?a=1&amp;b=2)"))
    return table(spark, d, "pages").select("page_id", urls.cell_urls(cell).alias("links"))


@query(
    "a9_company_matches",
    f"""WITH {KEYED} SELECT CAST(ord % 11 AS INT) AS score, left(COALESCE(title, ''), 44) AS title, left(COALESCE(location, ''), 30) AS location
FROM keyed WHERE contains(lower(company), 'src1') AND ord % 5 = 0 ORDER BY score DESC, title""",
)
def _(spark, d):
    """The matches of the companies asked for, best first."""
    m = joins.with_fingerprint(b1(spark, d)).filter("ord % 5 = 0").withColumn("score", (F.col("ord") % 11).cast("int"))
    return stats.company_matches(m, "SRC1")


@query("f1_html_to_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("f9_cell_urls", """SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS links FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(urls.HREF), 1)).cast("long").alias("links"))


@query(
    "f18_find_board_target",
    """SELECT page_id, lower(regexp_extract(url, 'https?://([^/?#]+)/([^/?#]+)', 1)) AS host, regexp_extract(url, 'https?://([^/?#]+)/([^/?#]+)', 2) AS site FROM pages WHERE regexp_matches(url, 'https?://([^/?#]+)/([^/?#]+)')""",
)
def _(spark, d):
    found = table(spark, d, "pages").select("page_id", urls.find_board_target(F.col("url"), F.lit(None).cast("string"), "https?://([^/?#]+)", "/([^/?#]+)").alias("t"))
    return found.filter("t is not null").select("page_id", "t.*")


# --- B7: events as hits over time ---------------------------------------------------------


@query(
    "w2_recruitment_pulse",
    """WITH RECURSIVE d AS (SELECT DISTINCT event_type || '-' || user_id AS company, CAST(ts AS DATE) AS day FROM events),
a(company, first_seen) AS (SELECT company, min(day) FROM d GROUP BY company
  UNION ALL SELECT a.company, (SELECT min(day) FROM d WHERE d.company = a.company AND d.day > a.first_seen + 4) FROM a WHERE (SELECT min(day) FROM d WHERE d.company = a.company AND d.day > a.first_seen + 4) IS NOT NULL)
SELECT company, first_seen, first_seen + 4 AS expires FROM a""",
)
def _(spark, d):
    hits = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("company"), F.to_date("ts").alias("day"))
    return alerts.pulse_days(hits)


@query(
    "j5_fresh_fast_lane",
    "SELECT event_id FROM events WHERE user_id % 10 = 0 OR (user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'))",
)
def _(spark, d):
    hit = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string"))
    e = table(spark, d, "events").withColumn("url", hit)
    return joins.fresh_fast_lane(e, e.filter("ts < timestamp '2024-01-02'")).select("event_id")


@query("j4_suppress_active_alerts", "SELECT event_id FROM events WHERE lower(event_type) NOT IN ('error', 'view')")
def _(spark, d):
    e = table(spark, d, "events").withColumn("company", F.col("event_type"))
    on = e.filter("event_type in ('error', 'view')").select(F.upper("event_type").alias("company"))
    return joins.suppress_active_alerts(e, on).select("event_id")


@query(
    "a11_alert_groups",
    """SELECT event_type AS company, count(*) AS count, array_to_string(list_transform(list_sort(list(event_id))[1:4], lambda x: CAST(x AS VARCHAR)), ',') AS sample_roles FROM events GROUP BY 1""",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("company"), F.col("event_id").cast("string").alias("title"), F.col("event_id").alias("ord"))
    return stats.alert_groups(e).withColumn("sample_roles", F.array_join("sample_roles", ","))


@query("p17_unexpired_alerts", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def _(spark, d):
    e = table(spark, d, "events").withColumn("expires", F.date_format("ts", "yyyy-MM-dd"))
    return filters.unexpired_alerts(e, datetime.date(2024, 1, 20)).select("event_id")


@query("p18_unexpired_seen", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) >= TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, d):
    stamp = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return filters.unexpired_seen(table(spark, d, "events").withColumn("alerted_at", stamp), datetime.datetime(2024, 1, 15), 5).select("event_id")


@query("s8_alerts_digest", "SELECT event_type AS company, count(*) AS n FROM events WHERE user_id = 3 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").filter("user_id = 3").select(F.col("event_type").alias("company"), F.col("event_id").cast("string").alias("title"), F.lit("").alias("location"), F.lit("").alias("url"))
    return sinks.alerts_digest(e).groupBy("company").agg(F.sum("n").alias("n"))


@query(
    "s8_alerts_digest_whole",
    "SELECT event_type AS company, count(*) AS n, CAST(sum(7 + length(CAST(event_id AS VARCHAR))) AS BIGINT) AS chars FROM events GROUP BY 1",
)
def _(spark, d):
    """All events; the characters of all lines with their breaks."""
    e = table(spark, d, "events").select(F.col("event_type").alias("company"), F.col("event_id").cast("string").alias("title"), F.lit("").alias("location"), F.lit("").alias("url"))
    return sinks.alerts_digest(e).groupBy("company").agg(F.sum("n").alias("n"), F.sum(F.length("body") - F.length("company")).alias("chars"))


@query(
    "f22_month_day",
    "SELECT event_id, strftime(ts, '%b %-d') AS shown FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", dates.month_day(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("shown"))


@query(
    "f23_infer_full_date",
    """WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29))
SELECT o_orderkey, strftime(make_date(CASE WHEN m * 100 + dd > 615 THEN 1997 ELSE 1998 END, m, dd), '%Y-%m-%d') || ' 00:00' AS found FROM o""",
)
def _(spark, d):
    o = table(spark, d, "orders").filter("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    return o.select("o_orderkey", dates.infer_full_date(F.date_format("o_orderdate", "MMM d"), TODAY).alias("found"))


@query(
    "f23_infer_full_date_whole",
    """WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders)
SELECT o_orderkey, CASE WHEN m = 2 AND dd = 29 THEN '' ELSE strftime(make_date(CASE WHEN m * 100 + dd > 615 THEN 1997 ELSE 1998 END, m, CASE WHEN m = 2 THEN least(dd, 28) ELSE dd END), '%Y-%m-%d') || ' 00:00' END AS found FROM o""",
)
def _(spark, d):
    """All orders; 29 February is in neither year and gives ''."""
    return table(spark, d, "orders").select("o_orderkey", dates.infer_full_date(F.date_format("o_orderdate", "MMM d"), TODAY).alias("found"))


@query("f25_n15_coerce_scores", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity / 4.0) AS INT) AS score FROM lineitem WHERE trunc(l_quantity / 4.0) BETWEEN 0 AND 10")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("t").alias("title"), F.lit("").alias("url"), (F.col("l_quantity") / 4.0).cast("string").alias("score"))
    return files.valid_matches(rows).select("l_orderkey", "l_linenumber", "score")


# --- B10: conversations: values carried from line to line ------------------------------------


@query(
    "g3_carry_section",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations""",
)
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.left("text", F.lit(20)))).withColumn("at", F.struct("turn", "role", "text"))
    return ordered.carry_last(c, "head", ["conv_id"], "at", "section").select("conv_id", "turn", "section")


@query(
    "g3_carry_section_whole",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations""",
)
def _(spark, d):
    """The whole text of the last user turn."""
    c = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("text"))).withColumn("at", F.struct("turn", "role", "text"))
    return ordered.carry_last(c, "head", ["conv_id"], "at", "section").select("conv_id", "turn", "section")


@query("g6_cap_rows", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn <= 2")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("at", F.struct("turn", "role", "text"))
    return ordered.cap_rows(c, 2, ["conv_id"], "at").select("conv_id", "turn")


# --- B9: payloads made of customers and orders ---------------------------------------------


def b9(spark, d, item, wrap: str | None, slug: str = "acme") -> DataFrame:
    """A payload of up to a hundred customers: ``item`` is the struct of one, ``wrap`` the field that holds the array."""
    rows = table(spark, d, "customer").withColumn("_i", item).groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.collect_list("_i").alias("a"))
    body = F.to_json(F.struct(F.col("a").alias(wrap))) if wrap else F.to_json("a")
    return rows.select(F.lit("x").alias("source_type"), F.lit(slug).alias("slug"), F.lit("Acme").alias("label"), "page", body.alias("payload"))


def _name():
    return F.col("c_name")


def _seg():
    return F.col("c_mktsegment")


def _remote():
    return F.col("c_custkey") % 2 == 0


def _url():
    return F.concat(F.lit("u"), F.col("c_custkey").cast("string"))


def _html():
    return F.concat(F.lit("<p>text <b>"), F.col("c_custkey").cast("string"), F.lit("</b></p>"))


_SUFFIX = "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' (Remote)' ELSE c_mktsegment END"


def _sql(title="c_name", company="'acme'", location="c_mktsegment", url="'u' || c_custkey", description="'text ' || c_custkey", source="''", where="TRUE", salary="''"):
    return f"SELECT {title} AS title, {company} AS company, {location} AS location, {salary} AS salary, {url} AS url, {description} AS description, {source} AS source FROM customer WHERE {where}"




@query("n1_norm_remoteok", _sql(company="c_mktsegment", location="'Remote'", salary="'$' || format('{:,}', c_custkey + 1000) || ' - $' || format('{:,}', c_custkey + 2000)", description="'TAGS: a, b' || chr(10) || 'text ' || c_custkey", source="'remoteok'", where="c_custkey % 3 <> 0"))
def _(spark, d):
    k = F.col("c_custkey")
    item = F.struct(F.when(k % 3 != 0, _name()).alias("position"), _seg().alias("company"), F.lit("").alias("location"), (k + 1000).alias("salary_min"), (k + 2000).alias("salary_max"), F.array(F.lit("a"), F.lit("b")).alias("tags"), _html().alias("description"), _url().alias("url"))
    return normalize.norm_remoteok(b9(spark, d, item, None))


@query("n3_norm_remotive", _sql(company="c_mktsegment", location="'Remote'", source="'remotive'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), _seg().alias("company_name"), F.lit("").alias("candidate_required_location"), _url().alias("url"), _html().alias("description"))
    return normalize.norm_remotive(b9(spark, d, item, "jobs"))


@query("n4_norm_arbeitnow", _sql(company="'co'", location=_SUFFIX, description="'TAGS: a, full' || chr(10) || 'text ' || c_custkey", source="'arbeitnow'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), F.lit("co").alias("company_name"), _seg().alias("location"), _remote().alias("remote"), F.array(F.lit("a")).alias("tags"), F.array(F.lit("full")).alias("job_types"), _url().alias("url"), _html().alias("description"))
    return normalize.norm_arbeitnow(b9(spark, d, item, "data"))


@query("n7_norm_greenhouse", _sql(source="'greenhouse:acme'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), F.struct(_seg().alias("name")).alias("location"), _url().alias("absolute_url"), _html().alias("content"))
    return normalize.norm_greenhouse(b9(spark, d, item, "jobs"))


@query("n8_norm_lever", _sql(description="'team, full' || chr(10) || 'text ' || c_custkey", source="'lever:acme'"))
def _(spark, d):
    item = F.struct(_name().alias("text"), F.struct(F.lit("team").alias("team"), F.lit("full").alias("commitment"), _seg().alias("location")).alias("categories"), _html().alias("description"), _url().alias("hostedUrl"))
    return normalize.norm_lever(b9(spark, d, item, None))


@query("n9_norm_ashby", _sql(location=_SUFFIX, description="'dept'", source="'ashby:acme'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), F.lit("").alias("location"), _seg().alias("locationName"), _remote().alias("isRemote"), _url().alias("applyUrl"), F.lit("").alias("descriptionHtml"), F.lit("dept").alias("departmentName"))
    return normalize.norm_ashby(b9(spark, d, item, "jobs"))


@query("n10_norm_smartrecruiters", _sql(location="'Rome, ' || " + _SUFFIX, url="'https://jobs.smartrecruiters.com/acme/' || c_custkey", source="'smartrecruiters:acme'"))
def _(spark, d):
    item = F.struct(
        F.col("c_custkey").alias("id"), _name().alias("name"), F.struct(F.lit("Rome").alias("city"), F.lit("").alias("region"), _seg().alias("country"), _remote().alias("remote")).alias("location"),
        F.struct(F.struct(F.struct(_html().alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd"),
    )
    return normalize.norm_smartrecruiters(b9(spark, d, item, "content"))


@query("n11_norm_workable", _sql(location=_SUFFIX, source="'workable:acme'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), F.struct(_seg().alias("city"), F.when(_remote(), "remote").alias("workplace")).alias("location"), _url().alias("shortlink"), _html().alias("description"))
    return normalize.norm_workable(b9(spark, d, item, "jobs"))


@query("n12_norm_recruitee", _sql(location="'Oslo, ' || c_mktsegment", source="'recruitee:acme'"))
def _(spark, d):
    item = F.struct(_name().alias("title"), F.lit("Oslo").alias("city"), _seg().alias("country_code"), _url().alias("url"), _html().alias("description"))
    return normalize.norm_recruitee(b9(spark, d, item, "offers"))


@query(
    "n13_norm_workday",
    _sql(company="'a.wd1.x.com/Site'", location="CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END", url="'https://a.wd1.x.com/Site/job/' || c_custkey",
         description="CASE WHEN c_custkey % 2 = 0 THEN '3 Locations' ELSE c_mktsegment END || chr(10) || 'Posted Today'", source="'workday:a.wd1.x.com/Site'"),
)
def _(spark, d):
    item = F.struct(_name().alias("title"), F.when(_remote(), "3 Locations").otherwise(_seg()).alias("locationsText"), F.lit("Posted Today").alias("postedOn"), F.concat(F.lit("/job/"), F.col("c_custkey").cast("string")).alias("externalPath"))
    return normalize.norm_workday(b9(spark, d, item, "jobPostings", "a.wd1.x.com/Site")).drop("detail_url")


@query(
    "f16_fill_multi_location",
    "SELECT c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Rome; Oslo, NO' ELSE c_mktsegment END AS location, CASE WHEN c_custkey % 2 = 0 THEN 'Rome; Oslo, NO' ELSE c_mktsegment END || chr(10) || 'Posted Today' AS description FROM customer",
)
def _(spark, d):
    item = F.struct(_name().alias("title"), F.when(_remote(), "3 Locations").otherwise(_seg()).alias("locationsText"), F.lit("Posted Today").alias("postedOn"), F.concat(F.lit("/job/"), F.col("c_custkey").cast("string")).alias("externalPath"))
    posts = normalize.norm_workday(b9(spark, d, item, "jobPostings", "a.wd1.x.com/Site"))
    details = posts.filter("detail_url is not null").select("detail_url", F.array(F.lit("Rome"), F.lit(" Oslo,  NO ")).alias("places"))
    return normalize.fill_multi_location(posts, details).select("title", "location", "description")


@query("n14_norm_oracle", _sql(company="'h.x.com/S1'", url="'https://h.x.com/hcmUI/CandidateExperience/en/sites/S1/job/' || c_custkey", description="c_mktsegment || chr(10) || 'Posted 2024-01-01'", source="'oracle:h.x.com/S1'"))
def _(spark, d):
    item = F.struct(F.col("c_custkey").alias("Id"), _name().alias("Title"), _seg().alias("PrimaryLocation"), F.lit("2024-01-01").alias("PostedDate"))
    raw = b9(spark, d, item, "requisitionList", "h.x.com/S1")
    return normalize.norm_oracle(raw.withColumn("payload", F.concat(F.lit('{"items":['), "payload", F.lit("]}"))))


@query("n2_norm_wwr_rss", _sql(title="CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END", company="CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END", location="'Remote'", source="'weworkremotely'"))
def _(spark, d):
    title = F.when(_remote(), F.concat(_seg(), F.lit(": "), _name())).otherwise(_seg())
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), _url(), F.lit("</link><description>text "), F.col("c_custkey").cast("string"), F.lit("</description></item>"))
    rows = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("payload"))
    return normalize.norm_wwr_rss(rows.withColumn("slug", F.lit("")))


@query("n21_split_bad_payloads", "SELECT event_type AS source_type, count(*) AS bad FROM events WHERE event_id % 4 = 0 GROUP BY 1")
def _(spark, d):
    raw = table(spark, d, "events").select(F.col("event_type").alias("source_type"), F.when(F.col("event_id") % 4 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("payload"))
    return normalize.split_bad_payloads(raw)[1]


@query("n6_norm_list")
def _(spark, d):
    """Every customer's orders as a Markdown list document; rows only here, brute force in the tests."""
    o = table(spark, d, "orders").withColumn("line", F.concat(
        F.lit("| "), F.when(F.col("o_orderkey") % 3 == 0, "↳").otherwise(F.col("o_orderpriority")), F.lit(" | Engineer "), F.col("o_orderkey").cast("string"),
        F.lit(" | Oslo | [Apply](https://x.io/j?id="), F.col("o_orderkey").cast("string"), F.lit("&utm_source=l) |"),
    ))
    head = F.lit("## Jobs\n| Company | Role | Location | Link |\n|---|---|---|---|\n")
    docs = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    return lists.norm_list(docs.withColumn("label", F.lit("x/y"))).select("doc", "ord", "company", "title", "url", "source")


@query("u1_s1_union_and_funnel", "SELECT 0 AS step, 'fetched' AS stage, 2 * count(*) AS n FROM customer UNION ALL SELECT 1, 'deduped', count(*) FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("title"), F.lit("").alias("company"), F.lit("").alias("url"), F.col("c_custkey").alias("ord"))
    both = joins.union_sources(c, c)
    return files.funnel({"fetched": both, "deduped": ordered.dedupe(both)})


@query("j6_watchlist_label", "SELECT o_orderkey, 'Label ' || c_custkey AS company FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("lever").alias("platform"), F.col("c_custkey").cast("string").alias("slug"), F.concat(F.lit("Label "), F.col("c_custkey").cast("string")).alias("label"))
    o = table(spark, d, "orders").select("o_orderkey", F.lit("").alias("company"), F.concat(F.lit("lever:"), F.col("o_custkey").cast("string")).alias("source"))
    return joins.watchlist_label(o, c).select("o_orderkey", "company")


@query("p9_is_watchlist_row", "SELECT o_orderkey, o_orderkey % 10 = 0 OR o_orderpriority = '5-LOW' AS watched FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("company"), F.when(F.col("o_orderkey") % 10 == 0, "lever:x").otherwise("board").alias("source"))
    return filters.is_watchlist_row(o, o.filter("company = '5-LOW'").select(F.lower("company").alias("label"))).select("o_orderkey", "watched")


# --- whole plans ---------------------------------------------------------------------------


@query(
    "e1_cycle_rule_counts",
    f"""WITH {KEYED}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM keyed) WHERE rn = 1),
w AS (SELECT * FROM one WHERE regexp_matches(lower(title || ' ' || description), '(^|[^\\p{{L}}\\p{{N}}_])(the|la|der)($|[^\\p{{L}}\\p{{N}}_])')
  AND fp NOT IN (SELECT fp FROM keyed WHERE ord % 10 = 3)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord) AS r2 FROM w) WHERE r2 = 1)
SELECT CASE WHEN regexp_matches(title, '(?i)\\b(sales|presales|pre-sales)\\b') THEN 'non_technical' ELSE 'pass' END AS rule, count(*) AS n FROM f GROUP BY 1""",
)
def _(spark, d):
    """Dedupe, keyword filter, seen postings out, gate: rows by rule."""
    posts = b1(spark, d)
    seen = joins.with_fingerprint(posts.filter("ord % 10 = 3")).select("fp")
    left = cycle.survivors(posts, seen, cycle.CycleOptions(include=["the", "la", "der"]))
    return stats.counted(left.select(F.coalesce("gate.rule", F.lit("pass")).alias("rule")), "rule")


@query("e1_cycle_matches")
def _(spark, d):
    """A whole cycle with the rule classifier; every row with its score and reason."""
    posts = b1(spark, d)
    seen = joins.with_fingerprint(posts.filter("ord % 10 = 3")).select("fp")
    return cycle.cycle(posts, seen, NOW, cycle.CycleOptions(all_rows=True))[0].select("title", "company", "score", "suitable", "reason")


@query("c2_classify_by_labels", f"WITH {KEYED} SELECT a.ord, b.lang AS role_family FROM keyed a JOIN (SELECT fp, min(source) AS lang FROM keyed GROUP BY fp) b USING (fp)")
def _(spark, d):
    p = joins.with_fingerprint(b1(spark, d))
    none = F.lit(None)
    labels = p.groupBy("fp").agg(F.min("source").alias("role_family")).select(
        "fp", "role_family", F.lit("junior").alias("seniority"), F.lit(0).alias("min_years_experience"), F.lit("unclear").alias("start_timing"),
        F.lit(False).alias("clearance_required"), F.lit(False).alias("advanced_degree_required"), F.array().cast("array<string>").alias("matched_skills"), none.cast("string").alias("evidence"),
    )
    return scoring.classify(p.drop("fp"), labels).select("ord", "role_family")


@query(
    "t5_prune_apply",
    """WITH r AS (SELECT 'k' || p_partkey AS key, p_partkey % 5 AS t, p_brand AS company, p_partkey % 3 AS l, p_size % 11 AS score FROM part WHERE p_partkey % 50 <> 0),
k AS (SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY company ORDER BY CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END, l, score DESC, key) AS rn FROM r WHERE t < 3 AND l < 2) WHERE rn <= 2)
SELECT deleted_reason, count(*) AS n FROM (SELECT CASE WHEN r.key IS NOT NULL AND r.key NOT IN (SELECT key FROM k) THEN 'prune' END AS deleted_reason FROM part LEFT JOIN r ON r.key = 'k' || p_partkey) GROUP BY 1""",
)
def _(spark, d):
    return stats.counted(prune.prune_apply(b2(spark, d), NOW), "deleted_reason")


@query("p13_p14_protected_engaged", f"WITH {B4} SELECT key, status IS NOT NULL OR date_applied IS NOT NULL OR notes IS NOT NULL AS protected, status IS NOT NULL OR date_applied IS NOT NULL AS engaged FROM b4")
def _(spark, d):
    return b4(spark, d).select("key", prune.is_protected().alias("protected"), prune.is_engaged().alias("engaged"))


@query("p12_hard_excluded", "SELECT p_partkey % 5 AS t, CASE WHEN p_partkey % 5 = 3 THEN 'too senior' WHEN p_partkey % 5 = 4 THEN 'non-engineering' WHEN p_partkey % 3 = 2 THEN 'location' ELSE 'kept' END AS why, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, d):
    t = b2(spark, d).withColumn("t", F.substring("key", 2, 20).cast("long") % 5)
    why = prune.hard_excluded(F.col("title"), F.col("location"), F.col("reason"), F.col("concerns"))
    return t.groupBy("t", F.coalesce(why, F.lit("kept")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_p8_titles", "SELECT p_partkey, p_partkey % 4 = 0 AS intern, p_partkey % 4 = 1 AS grad FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    title = F.concat_ws(" ", "p_name", F.when(k == 0, "Intern 2027").when(k == 1, "New Grad").when(k == 2, "Internal"))
    return table(spark, d, "part").select("p_partkey", filters.is_internship(title).alias("intern"), filters.is_new_grad(title).alias("grad"))


@query("p10_p11_sections_and_marks", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'o') AND NOT contains(lower(p_type), 'promo') AND p_size % 2 = 1")
def _(spark, d):
    row = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(text.CLOSED))).otherwise(F.col("p_name"))
    keep = filters.section_allowed(F.col("p_type"), ["O"], ["Promo"]) & ~filters.row_flag_skip(text.legend_flags(row))
    return table(spark, d, "part").filter(keep).select("p_partkey")


@query("f2_norm_ws", "SELECT page_id, trim(regexp_replace(left(html, 500), '[\\s\\x0B]+', ' ', 'g')) AS t FROM pages WHERE NOT regexp_matches(left(html, 500), '[\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]')")
def _(spark, d):
    p = table(spark, d, "pages").filter(~F.left("html", F.lit(500)).rlike("[\u0085\u00a0\u2000-\u200a\u3000]"))
    return p.select("page_id", text.norm_ws(F.left("html", F.lit(500))).alias("t"))


UNICODE_SPACE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("f2_norm_ws_whole", f"SELECT page_id, trim(regexp_replace(html, '{UNICODE_SPACE}', ' ', 'g')) AS t FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.norm_ws(F.col("html")).alias("t"))


@query("f14_f15_places", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', x (Remote)' ELSE c_mktsegment || ', x' END AS place FROM customer")
def _(spark, d):
    place = text.join_place(F.col("c_mktsegment"), F.lit(""), F.lit("x"))
    return table(spark, d, "customer").select("c_custkey", text.remote_suffix(place, F.col("c_custkey") % 2 == 0).alias("place"))


@query("f7_f17_list_and_board_urls", "SELECT c_custkey, 'https://raw.githubusercontent.com/o' || c_custkey || '/r/main/README.md' AS raw, 'o' || c_custkey AS tenant FROM customer")
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    made = urls.canonical_list_url(F.concat(F.lit("https://github.com/o"), k, F.lit("/r.git")))
    slug = urls.parse_workday_slug(F.concat(F.lit("https://o"), k, F.lit(".wd1.x.com/Site")))
    return table(spark, d, "customer").select("c_custkey", made["url"].alias("raw"), slug["tenant"].alias("tenant"))


@query("f20_f21_f24_buckets", "SELECT CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'watchlist (lever)' ELSE c_mktsegment END AS source, count(*) AS n, CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM customer), 0) AS INT) AS pct FROM customer GROUP BY 1")
def _(spark, d):
    src = F.when(F.col("c_mktsegment").contains("BUILD"), F.concat(F.lit("lever:"), "c_name")).otherwise(F.col("c_mktsegment"))
    return stats.source_breakdown(table(spark, d, "customer").select(src.alias("source")))


@query("f26_clean_cell", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders")
def _(spark, d):
    c = F.when(F.col("o_orderkey") % 3 == 0, " . ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")))
    return table(spark, d, "orders").select("o_orderkey", text.clean_cell(c).alias("v"))


@query("s6_evolve_schema", f"WITH {B4} SELECT key, score, CAST(NULL AS VARCHAR) AS pay FROM b4")
def _(spark, d):
    from millrace.schemas import evolve_schema

    return evolve_schema(b4(spark, d).drop("pay"), 1, 2).select("key", "score", "pay")


@query("a15_dashboard_counts", f"WITH {B4} SELECT 'scores' AS part, count(DISTINCT score) AS n FROM b4 WHERE deleted_at IS NULL UNION ALL SELECT 'statuses', count(DISTINCT COALESCE(status, '')) FROM b4 WHERE deleted_at IS NULL UNION ALL SELECT 'recent', 10")
def _(spark, d):
    none = spark.createDataFrame([], "company string, expires string")
    parts = stats.dashboard(b4(spark, d), none, TODAY)
    return files.funnel({n: parts[n] for n in ("scores", "statuses", "recent")}).select(F.col("stage").alias("part"), "n")


@query("w1_w3_stream_once", "SELECT lower(event_type) AS company, count(DISTINCT user_id) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def _(spark, d):
    """Events as a stream in micro-batches against the table of pairs seen so far: each (type, user) once, ever."""
    from millrace.session import scratch

    schema = table(spark, d, "events").schema
    seen, ck = scratch(spark, "stream-seen"), scratch(spark, "stream-checkpoint")

    def batch(df: DataFrame, _: int) -> None:
        before = alerts.table_or_empty(spark, seen, "fp string, company string")
        hits = df.filter("user_id % 3 <> 0").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("fp"), F.lower("event_type").alias("company"))
        joins.new_postings(hits.distinct(), before).write.mode("append").parquet(seen)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return stats.counted(spark.read.parquet(seen), "company")


#: Places of B-events: the city of a user; user_id modulo 4 is 0 for one that a detail record names.
CITY = "CASE user_id % 4 WHEN 1 THEN 'Berlin' WHEN 2 THEN 'New York; Paris' WHEN 3 THEN '' END"


@query("w3_fast_lane_whole", "SELECT lower(event_type) AS company, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def _(spark, d):
    """All events through the fast lane, as new-graduate postings with a URL for each (type, user); each delivery counts."""
    from millrace.session import scratch

    sent, seen, ck = (scratch(spark, f"fast-lane-{n}") for n in ("sent", "seen", "checkpoint"))
    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    hits = e.select(F.lit("New Grad Engineer").alias("title"), F.lower("event_type").alias("company"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("url"))
    deliver = lambda df, name: df.write.mode("overwrite").parquet(f"{sent}/batch={name}")
    alerts.fast_lane(hits, seen, deliver, ck, lambda: datetime.datetime.fromisoformat(NOW)).awaitTermination()
    return stats.counted(spark.read.parquet(sent), "company")


@query(
    "w3_fast_lane_places",
    f"""WITH h AS (SELECT DISTINCT event_type, user_id, CASE WHEN user_id % 4 = 0 THEN CASE WHEN user_id % 8 = 0 THEN 'Rome; Boston' ELSE 'Rome' END ELSE {CITY} END AS location FROM events)
SELECT lower(event_type) AS company, location, count(*) AS n FROM h WHERE location = '' OR regexp_matches(lower(location), '(new york|boston)') GROUP BY 1, 2""",
)
def _(spark, d):
    """All events through the fast lane in four micro-batches, as new-graduate postings with a URL for each (type, user);
    deliveries are counted as they are. Places outside the rules, also those only a detail record names, stay out."""
    from millrace.session import scratch

    sent, seen, ck, landed = (scratch(spark, f"fast-lane-{n}") for n in ("sent", "seen", "checkpoint", "landed"))
    e = table(spark, d, "events")
    detail = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("d"), F.col("user_id").cast("string")))
    hits = e.select(
        F.lit("New Grad Engineer").alias("title"), F.lower("event_type").alias("company"), F.expr(CITY).alias("location"), F.lit("").alias("description"),
        F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("url"), detail.alias("detail_url"), F.col("event_id").alias("ord"),
    )
    hits.repartition(4, "ord").write.parquet(landed)
    users = e.select("user_id").filter("user_id % 4 = 0").distinct()
    details = users.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("detail_url"), F.expr("CASE WHEN user_id % 8 = 0 THEN array('Rome', 'Boston') ELSE array('Rome') END").alias("places"))
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    deliver = lambda df, name: df.write.mode("overwrite").parquet(f"{sent}/batch={name}")
    alerts.fast_lane(stream, seen, deliver, ck, lambda: datetime.datetime.fromisoformat(NOW), details=details, places=["new york", "boston"]).awaitTermination()
    return spark.read.parquet(sent).groupBy("company", "location").agg(F.count(F.lit(1)).alias("n"))


@query("w1_stream_new_postings", f"WITH {KEYED} SELECT company, count(DISTINCT fp) AS n FROM keyed WHERE company IS NOT NULL GROUP BY 1")
def _(spark, d):
    """All documents as postings through W1 in four micro-batches, and the same again as a second stream: the rows of
    the match log, gated ones included. Each fingerprint is in it once."""
    from millrace.session import scratch, shuffle_partitions

    seen, matches, landed = (scratch(spark, f"new-postings-{n}") for n in ("seen", "matches", "landed"))
    posts = b1(spark, d)
    files = shuffle_partitions(spark)  # of a micro-batch, so that it is no task's whole work
    posts.repartition(4 * files, "ord").write.parquet(landed)
    for _ in range(2):
        stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", files).parquet(landed)
        alerts.stream_new_postings(stream, seen, matches, scratch(spark, "new-postings-checkpoint"), cycle.CycleOptions(all_rows=True), lambda: NOW).awaitTermination()
    return stats.counted(spark.read.parquet(matches).filter("company is not null"), "company")


#: Match rows of the events; half of them have an order's key as their URL.
EVENT_URL = "'k' || (CASE WHEN event_id % 2 = 0 THEN event_id % 5000 ELSE 1000000000 + event_id // 3 END)"
T1_SQL = f"""{B4}, m AS (SELECT event_id AS ord, event_id % 3 AS part, {EVENT_URL} AS key, CAST(event_id % 11 AS INT) AS score FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, ord) AS rn FROM m) WHERE rn = 1 AND key NOT IN (SELECT key FROM b4))"""


def tracker_store(spark, d) -> tracker.TrackerStore:
    """A store with the orders, then a third of the events' match rows at a time, then every tenth live order archived."""
    from millrace.session import scratch

    store = tracker.TrackerStore(spark, scratch(spark, "tracker"), every=3)
    store.bootstrap(b4(spark, d))
    e = table(spark, d, "events")
    url = F.expr(EVENT_URL.replace("//", "div"))
    for part in range(3):
        rows = e.filter(F.col("event_id") % 3 == part).select(
            *[F.lit("").alias(c) for c in ("company", "location", "salary", "source", "suitable", "matched_skills", "concerns", "reason", "date_processed")],
            F.col("event_type").alias("title"), url.alias("url"), (F.col("event_id") % 11).cast("string").alias("score"), F.col("event_id").alias("ord"),
        )
        store.store_matches(rows, f"t{part + 1}")
    gone = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"))
    store.change(gone, lambda rows: tracker.soft_delete(rows, gone, "user", "t4"), "archive")
    return store


@query(
    "t1_t9_store_history",
    f"""WITH {T1_SQL} SELECT 'bootstrap' AS note, 'snapshot' AS kind, count(*) AS added, count(*) AS seen FROM b4
UNION ALL SELECT 't' || (part + 1), 'add', (SELECT count(*) FROM f WHERE f.part = m.part), count(*) FROM m GROUP BY part
UNION ALL SELECT 'archive', 'change', 0, count(*) FROM b4 WHERE o_orderkey % 10 = 0 AND deleted_at IS NULL""",
)
def _(spark, d):
    """T9, T1 three times, T3: what each commit says of itself; snapshots that the log made itself are left out."""
    return tracker_store(spark, d).history().filter("kind <> 'snapshot' or note <> ''").select("note", "kind", "added", "seen")


@query(
    "t1_t9_store_tracker",
    f"""WITH {T1_SQL} SELECT key, score, CASE WHEN o_orderkey % 10 = 0 AND deleted_at IS NULL THEN 't4' ELSE deleted_at END AS deleted_at,
CASE WHEN o_orderkey % 10 = 0 AND deleted_at IS NULL THEN 'user' ELSE deleted_reason END AS deleted_reason, CAST(NULL AS VARCHAR) AS created_at FROM b4
UNION ALL SELECT key, score, NULL, NULL, 't' || (part + 1) FROM f""",
)
def _(spark, d):
    """The tracker after those commits, read through the log."""
    return tracker_store(spark, d).read().select("key", "score", "deleted_at", "deleted_reason", "created_at")


@query(
    "t8_apply_archive",
    f"""WITH {B4}, k AS (SELECT DISTINCT 'k' || event_id AS key FROM events), t AS (SELECT b4.*, deleted_at IS NULL AND COALESCE(trim(status), '') = '' AND COALESCE(trim(date_applied), '') = ''
AND key IN (SELECT key FROM k) AS hit FROM b4)
SELECT key, CASE WHEN hit THEN '{TODAY}' ELSE deleted_at END AS deleted_at, CASE WHEN hit THEN 'review' ELSE deleted_reason END AS deleted_reason FROM t""",
)
def _(spark, d):
    """The whole tracker after the archive of the events' keys; engaged rows and tombstones stay as they are."""
    k = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"))
    return tracker.apply_archive(b4(spark, d), k, str(TODAY)).select("key", "deleted_at", "deleted_reason")


@query(
    "g8_first_row_per_key",
    f"""WITH {B1}, r AS (SELECT ord, title, row_number() OVER (PARTITION BY title ORDER BY ord) AS rn FROM b1)
SELECT ord, CASE WHEN COALESCE(title, '') <> '' AND rn = 1 THEN 'first' ELSE 'other' END AS part FROM r""",
)
def _(spark, d):
    """The first posting of each title, and the blank and repeated ones."""
    first, other = ordered.first_row_per_key(b1(spark, d), "title", "ord")
    return first.select("ord", F.lit("first").alias("part")).unionByName(other.select("ord", F.lit("other").alias("part")))


#: Days that the watermark has passed at the end: all but those of the last slice of a quarter of the days, and one more.
PULSE_SQL = """WITH RECURSIVE b AS (SELECT max(CAST(ts AS DATE)) AS last, (max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 4) // 4 + 1 AS late FROM events),
h AS (SELECT event_type || '-' || user_id % 50 AS company, CAST(ts AS DATE) AS day, count(*) AS n FROM events, b
  WHERE event_id % 3 = 0 AND (user_id % 4 = 0 OR user_id % 50 < 10) AND CAST(ts AS DATE) < last - CAST(late AS INT) GROUP BY ALL),
raised AS (SELECT company, min(day) AS first_seen FROM h GROUP BY company
  UNION ALL SELECT h.company, min(h.day) FROM raised r JOIN h ON h.company = r.company AND h.day > r.first_seen + 4 GROUP BY h.company)
SELECT company, first_seen, first_seen + 4 AS expires, n FROM raised JOIN h USING (company) WHERE day = first_seen"""


@query("w2_recruitment_pulse_stream", PULSE_SQL)
def _(spark, d):
    """W2 as a stream over all events, every third a new-graduate posting, landed in four slices of days whose rows come in
    any order: the alerts of the days that the watermark has passed. Its session has the state store W2 needs."""
    from millrace.session import scratch

    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, landed, ck = (scratch(own, f"pulse-{n}") for n in ("alerts", "landed", "checkpoint"))
    group = F.col("user_id") % 50
    e = table(own, d, "events").select(
        F.concat_ws("-", "event_type", group.cast("string")).alias("company"), F.when(F.col("event_id") % 3 == 0, "New Grad Engineer").otherwise("Engineer").alias("title"),
        F.when(F.col("user_id") % 4 == 0, "lever:x").otherwise("remote").alias("source"), F.to_date("ts").alias("day"), group.alias("part"),
    )
    labels = e.filter("part < 10").select(F.col("company").alias("label")).distinct()
    first, last = e.agg(F.min("day"), F.max("day")).first()
    width = ((last - first).days + 4) // 4
    for i in range(4):
        lo = first + datetime.timedelta(days=i * width)
        e.filter(F.col("day").between(lo, lo + datetime.timedelta(days=width - 1))).drop("part").repartition(4).write.mode("append").parquet(landed)
    stream = own.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 4).parquet(landed)
    pulse = alerts.recruitment_pulse(stream, lateness=f"{width + 1} days", watchlist=labels)
    pulse.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return own.read.schema(pulse.schema).parquet(out).select("company", "first_seen", "expires", F.col("count").alias("n"))


# --- Trees and landing files -------------------------------------------------------------------


def _comment(fields, below):
    """JSON of one comment: the struct ``fields`` and the JSON list ``below`` of its answers."""
    own = F.to_json(fields)
    return F.concat(F.left(own, F.length(own) - 1), F.lit(', "children": '), below, F.lit("}"))


TURNS_SQL = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS depth, COALESCE(text, '') AS text FROM conversations)"""


@query(
    "n5_comment_tree",
    f"""WITH {TURNS_SQL} SELECT conv_id // 20 AS thread, conv_id || '-' || depth AS id, CASE WHEN depth > 1 THEN conv_id || '-' || (depth - 1) END AS parent_id, depth,
CASE WHEN depth < max(depth) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS n_children, text FROM t""",
)
def _(spark, d):
    """Threads of twenty conversations, each turn an answer to the one before: trees as deep as the longest conversation."""
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("at"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
    numbered = F.reverse(F.transform("at", lambda x, i: F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), (i + 1).cast("string")).alias("id"), x["text"].alias("text"))))
    nested = F.aggregate(numbered, F.lit("[]"), lambda below, x: F.concat(F.lit("["), _comment(x, below), F.lit("]")))
    top = turns.select(F.expr("conv_id div 20").alias("thread"), F.substring(nested, 2, 1 << 30).alias("one")).select("thread", F.expr("left(one, length(one) - 1)").alias("one"))
    threads = top.groupBy("thread").agg(F.concat(F.lit('{"id": "story", "children": ['), F.array_join(F.collect_list("one"), ","), F.lit("]}")).alias("payload"))
    return normalize.comment_tree(threads).select("thread", "id", "parent_id", "depth", "n_children", "text")


@query(
    "n5_norm_hn_hiring",
    """SELECT c_name AS title, c_mktsegment AS company, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Oslo' END AS location, '' AS salary, 'https://news.ycombinator.com/item?id=' || c_custkey AS url,
c_mktsegment || ' | ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' | Oslo' END || chr(10) || 'We look for engineers & others to join us.' AS description, 'hn_hiring' AS source
FROM customer WHERE c_custkey % 4 <> 0""",
)
def _(spark, d):
    """A comment for each customer; every fourth is short, all have an answer that is long enough for a posting but is none."""
    k = F.col("c_custkey")
    said = F.concat("c_mktsegment", F.lit(" | "), "c_name", F.when(k % 3 == 0, "").otherwise(" | Oslo"), F.lit("<br>We look for engineers &amp; others to join us."))
    answer = F.struct(F.concat(F.lit("a"), k.cast("string")).alias("id"), F.lit("Nobody | Answers | Nowhere, at more than forty characters").alias("text"))
    item = F.struct(k.cast("string").alias("id"), F.when(k % 4 == 0, "[deleted]").otherwise(said).alias("text"), F.array(answer).alias("children"))
    return normalize.norm_hn_hiring(b9(spark, d, item, "children"))


LANDED_SQL = """SELECT o_orderpriority AS title, 'c' || o_custkey AS company, 'u' || o_orderkey AS url, {at} AS scraped_at, '{kind}' AS kind FROM orders WHERE {good}"""
LANDED = {"documents": "o_orderkey // 2000 % 7 <> 3", "lines": "o_orderkey % 10 <> 3"}


def landed_files(spark, d) -> dict[str, str]:
    """All orders as postings on disk: documents (objects and bare arrays in turn) of up to 2,000, some cut short; and lines, some cut short."""
    from millrace.session import scratch

    paths = {kind: scratch(spark, f"landing-{kind}") for kind in LANDED}
    page = F.expr("o_orderkey div 2000")
    j = F.struct(F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("company"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    o = table(spark, d, "orders").select("o_orderkey", page.alias("page"), j.alias("j"))
    jobs = o.groupBy("page").agg(F.collect_list("j").alias("jobs"))
    doc = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("t"), F.col("page").cast("string")).alias("scraped_at"), "jobs"))).otherwise(F.to_json("jobs"))
    cut = lambda c, off: F.when(off, F.left(c, F.length(c) - 5)).otherwise(c)
    jobs.select("page", cut(doc, F.col("page") % 7 == 3).alias("value")).write.partitionBy("page").text(paths["documents"])
    o.select(cut(F.to_json(F.struct("j.*", F.lit("t").alias("scraped_at"))), F.col("o_orderkey") % 10 == 3).alias("value")).write.text(paths["lines"])
    return paths


@query("n16_read_postings", " UNION ALL ".join(
    LANDED_SQL.format(kind=kind, good=good, at={"documents": "CASE WHEN o_orderkey // 2000 % 2 = 0 THEN 't' || o_orderkey // 2000 END", "lines": "'t'"}[kind]) for kind, good in LANDED.items()
))
def _(spark, d):
    both = [files.read_postings(spark, path, kind == "lines").withColumn("kind", F.lit(kind)) for kind, path in landed_files(spark, d).items()]
    return both[0].unionByName(both[1]).select("title", "company", "url", "scraped_at", "kind")


@query("n16_bad_records", "SELECT 'documents' AS kind, count(DISTINCT o_orderkey // 2000) AS bad FROM orders WHERE o_orderkey // 2000 % 7 = 3 UNION ALL SELECT 'lines', count(*) FROM orders WHERE o_orderkey % 10 = 3")
def _(spark, d):
    both = [files.read_landing(spark, path, kind == "lines")[1].agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select(F.lit(kind).alias("kind"), "bad") for kind, path in landed_files(spark, d).items()]
    return both[0].unionByName(both[1])


# --- List documents: the same text in both engines, parsed by windows in SQL ------------------------

LINK = "CASE WHEN o_orderkey % 7 = 0 THEN '🔒' WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE {a} || 'https://x.io/j?id=' || o_orderkey || '&utm_source=l' || {b} END"
LIST_CELLS = {
    "company": "CASE WHEN o_orderkey % 3 = 0 THEN '↳' WHEN o_orderkey % 5 = 0 THEN '' ELSE '**' || o_orderpriority || '**' END",
    "title": "'Engineer ' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN ' 🛂' ELSE '' END",
    "place": "CASE WHEN o_orderkey % 4 = 0 THEN 'Oslo<br>Rome' ELSE o_orderstatus END",
    "link": LINK.format(a="'[Apply]('", b="')'"),
    "anchor": LINK.format(a="""'<a href="'""", b="""'">Apply</a>'"""),
}
#: Even orders are lines of a Markdown table whose columns stand in two orders; odd ones are rows of an HTML table over four lines.
LIST_LINE = """CASE WHEN o_orderkey % 2 = 1 THEN '<tr>' || chr(10) || '<td>' || {company} || '</td><td>' || {title} || '</td>' || chr(10) || '<td>' || {place} || '</td>' || chr(10) || '<td>' || {anchor} || '</td></tr>'
WHEN o_custkey % 2 = 0 THEN '| ' || {company} || ' | ' || {title} || ' | ' || {place} || ' | ' || {link} || ' |'
ELSE '| ' || {title} || ' | ' || {company} || ' | ' || {link} || ' | ' || {place} || ' |' END""".format(**LIST_CELLS)
LIST_HEAD = """'Intro' || chr(10) || '| Early | Engineer | Oslo | [Apply](https://x.io/j?id=0) |' || chr(10) || '## Jobs ##' || chr(10) || CASE WHEN doc % 2 = 0 THEN '| Company | Role | Location | Link |' ELSE '| Role | Company | Link | Location |' END || chr(10) || '|---|:---:|---|---|'"""
LIST_MID = """CASE WHEN doc % 3 = 0 THEN '### Interns' ELSE 'No section' END || chr(10) || '<table>' || chr(10) || '<tr><th>Company</th><th>Role</th><th>Location</th><th>Link</th></tr>'"""


@query(
    "n6_list_documents",
    f"""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS k, {LIST_LINE} AS line FROM orders),
p AS (SELECT doc, string_agg(line, chr(10) ORDER BY k) FILTER (k % 2 = 0) AS even, string_agg(line, chr(10) ORDER BY k) FILTER (k % 2 = 1) AS odd FROM r GROUP BY doc),
d AS (SELECT doc, string_split(concat_ws(chr(10), {LIST_HEAD}, even, {LIST_MID}, odd, '</table>'), chr(10)) AS lines FROM p),
l AS (SELECT doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
m AS (SELECT *, last_value(CASE WHEN line LIKE '%</tr>%' THEN 0 WHEN line LIKE '<tr%' THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM l),
g AS (SELECT *, sum(CASE WHEN inside = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS g FROM m),
j AS (SELECT doc, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS line FROM g GROUP BY doc, g),
c AS (SELECT *, CASE WHEN line LIKE '<tr%' THEN regexp_extract_all(line, '(?s)<t[dh]>(.*?)</t[dh]>', 1) WHEN line LIKE '|%' THEN list_transform(string_split(line[2:-2], '|'), lambda x: trim(x)) END AS cells,
  last_value(CASE WHEN line LIKE '##%' THEN trim(line, '# ') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS section FROM j),
h AS (SELECT *, list_contains(cells, 'Company') AND list_contains(cells, 'Role') AS head FROM c WHERE len(cells) >= 3 AND cells[1] <> '---'),
t AS (SELECT *, max(CASE WHEN head THEN i END) OVER (PARTITION BY doc ORDER BY i) AS tab, last_value(CASE WHEN head THEN cells END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS cols FROM h),
f AS (SELECT *, replace(cells[list_position(cols, 'Company')], '**', '') AS own FROM t WHERE NOT head AND tab IS NOT NULL),
o AS (SELECT *, COALESCE(last_value(CASE WHEN own NOT IN ('', '↳') THEN own END IGNORE NULLS) OVER (PARTITION BY doc, tab ORDER BY i), '') AS company FROM f)
SELECT doc, company, trim(replace(cells[list_position(cols, 'Role')], '🛂', '')) AS title, replace(cells[list_position(cols, 'Location')], '<br>', ' / ') AS location, section,
  regexp_extract(cells[list_position(cols, 'Link')], 'https://x.io/j.id=[0-9]+', 0) AS url, contains(line, '🛂') AS no_sponsor
FROM o WHERE section <> 'Interns' AND NOT contains(line, '🔒') AND contains(line, 'https://')""",
)
def _(spark, d):
    """N6 with G2, G4, G5, F8, F10, F11 and F13: a document a customer with rows before any header, two orders of columns,
    marked, closed and linkless rows, companies named above, a section left out, and rows over several lines."""
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.expr(LIST_LINE).alias("line"))
    half = lambda odd: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") % 2 == odd, F.struct("k", "line")))), lambda x: x["line"]), "\n"), F.lit(""))
    docs = r.groupBy("doc").agg(half(0).alias("even"), half(1).alias("odd"))
    docs = docs.select("doc", F.concat_ws("\n", F.expr(LIST_HEAD), "even", F.expr(LIST_MID), "odd", F.lit("</table>")).alias("text"), F.lit("x/y").alias("label"))
    told = F.col("description")
    return lists.norm_list(docs, exclude=["intern"]).select(
        "doc", "company", "title", "location", F.regexp_extract(told, "(?m)^Category: (.*)$", 1).alias("section"), "url", told.contains("does NOT offer visa sponsorship").alias("no_sponsor")
    )


@query("s7_snapshots_kept", "SELECT '199' || y || '-12-31' AS date, count(*) AS n FROM orders, (SELECT unnest([5, 6, 7]) AS y) WHERE year(o_orderdate) <= 1990 + y GROUP BY y")
def _(spark, d):
    """The tracker's snapshots at six years' ends, one of them written twice; of those on disk the newest three stay."""
    from millrace.session import scratch

    path, o = scratch(spark, "snapshots"), table(spark, d, "orders")
    for year in (1992, 1993, 1994, 1995, 1996, 1996, 1997):
        sinks.write_snapshot(o.filter(F.year("o_orderdate") <= year), path, f"{year}-12-31")
    sinks.retain_snapshots(spark, path, 3)
    return spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))
