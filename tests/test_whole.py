"""Operators on all rows of their tables, with the rows and characters that a shorter query leaves out."""

from pyspark.sql import functions as F

from millrace import bindings
from millrace.sources import sinks


def test_digest_in_pieces(spark):
    hits = spark.range(0, 2500).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("company"),
        F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("location"), F.lit("u").alias("url"),
    )
    got = sinks.alerts_digest(hits, 100).collect()
    assert max(r.n for r in got) <= 100 and all(r.body.count("\n") == r.n for r in got)
    for company in ("hot", "small"):
        want = sorted(f"- {r.title} [] u" for r in hits.collect() if r.company == company)
        own = [r.body.split("\n") for r in sorted(got, key=lambda r: (r.part, r.block)) if r.company == company]
        assert all(b[0] == company for b in own) and [x for b in own for x in b[1:]] == want


def test_white_space_of_whole_pages(spark, tmp_path):
    import duckdb

    spaces = [chr(i) for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    bodies = [c + "a" + c + " b" * 600 + c + "\n" + c + "c" + c for c in spaces] + ["".join(spaces), "", "a\u200b\u180eb"]
    pages = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.t for r in bindings.QUERIES["f2_norm_ws_whole"](spark, str(tmp_path)).collect()}
    kept = lambda t: " ".join("".join(" " if c in spaces else c for c in t).split(" ")).split(" ")
    assert got == {i: " ".join(w for w in kept(t) if w) for i, t in enumerate(bodies)}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert dict(con.execute(bindings.ORACLES["f2_norm_ws_whole"]).fetchall()) == got


def test_leap_days(spark, tmp_path):
    import datetime

    rows = [(1, datetime.date(1996, 2, 29)), (2, datetime.date(1996, 2, 28)), (3, datetime.date(1996, 6, 16))]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.found for r in bindings.QUERIES["f23_infer_full_date_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "1998-02-28 00:00", 3: "1997-06-16 00:00"}


def test_whole_sections(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u" * 90 + "\nend"), (1, 2, "assistant", "a"), (2, 0, "user", "v" * 21)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.section for r in bindings.QUERIES["g3_carry_section_whole"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): None, (1, 1): "u" * 90 + "\nend", (1, 2): "u" * 90 + "\nend", (2, 0): "v" * 21}


def test_fast_lane_runs_on_all_users(spark, sf_dir, monkeypatch):
    from millrace.streaming import alerts

    calls, real = [], alerts.fast_lane
    monkeypatch.setattr(alerts, "fast_lane", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {r.company: r.n for r in bindings.QUERIES["w3_fast_lane_whole"](spark, sf_dir).collect()}
    events = bindings.table(spark, sf_dir, "events")
    assert calls and got == {r.c: r.n for r in events.groupBy(F.lower("event_type").alias("c")).agg(F.countDistinct("user_id").alias("n")).collect()}
