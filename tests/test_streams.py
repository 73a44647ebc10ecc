"""Streams equal their batch form, however the input is split."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming import alerts

POSTING = "title string, company string, location string, salary string, url string, description string, source string, ord long"


def land(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.mark.parametrize("split", [1, 3])
def test_each_posting_once(spark, tmp_path, split):
    jobs = [(f"Software Engineer, New Grad {i % 4}", "c", "NYC", "", f"https://x.io/{i % 4}", "2027", "ashby:x", i) for i in range(12)]
    parts = [jobs[i::split] for i in range(split)]
    stream = land(spark, f"{tmp_path}/in", parts, POSTING)
    alerts.stream_new_postings(stream, f"{tmp_path}/seen", f"{tmp_path}/matches", f"{tmp_path}/ck", stamp=lambda: "2024-01-01 00:00").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/matches").count() == 4
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 4


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    """The commit of the last micro-batch is lost; it runs again and replaces itself. A second stream adds nothing."""
    jobs = [(f"Software Engineer, New Grad {i % 4}", "c", "NYC", "", f"https://x.io/{i % 4}", "2027", "ashby:x", i) for i in range(12)]
    stream = land(spark, f"{tmp_path}/in", [jobs[:2], jobs[2:]], POSTING)
    run = lambda ck: alerts.stream_new_postings(stream, f"{tmp_path}/seen", f"{tmp_path}/matches", f"{tmp_path}/{ck}", stamp=lambda: "2024-01-01 00:00").awaitTermination()
    found = lambda: (spark.read.parquet(f"{tmp_path}/matches").count(), spark.read.parquet(f"{tmp_path}/seen").count())
    run("ck")
    assert found() == (4, 4)
    for f in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / f).unlink()
    run("ck")
    assert found() == (4, 4)
    run("other")
    assert found() == (4, 4)


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "fp string")
    alerts.append_seen_batch(keys, f"{tmp_path}/seen", "fp", "a-0")
    part = alerts.seen_of(keys.filter("fp in ('k7', 'k8')"), f"{tmp_path}/seen", "fp", "a-1")
    names = {r.fp for r in part.collect()}
    assert {"k7", "k8"} <= names and len(names) < 30
    assert "PartitionFilters: [isnotnull(batch" in part._jdf.queryExecution().toString()
    assert alerts.seen_of(keys, f"{tmp_path}/seen", "fp", "a-0").count() == 0
    assert alerts.seen_of(keys, f"{tmp_path}/none", "fp", "a-0").count() == 0


def test_buckets_are_written_by_several_tasks(spark, tmp_path):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "fp string")
    alerts.append_seen_batch(keys, f"{tmp_path}/seen", "fp", "a-0")
    assert len({p.name.split("-")[1] for p in (tmp_path / "seen").rglob("part-*.parquet")}) > 1


def test_fast_lane_places(spark, tmp_path):
    """Places come from the detail record where a posting only had a count; unfit ones and repeats are not delivered."""
    schema = POSTING + ", detail_url string"
    rows = [("New Grad Engineer", "c", place, "", url, "", "s", i, detail) for i, (place, url, detail) in enumerate(
        [("Berlin", "a", None), ("NYC", "b", None), ("NYC", "b", None), (None, "c", "d1"), (None, "d", "d2"), ("", None, None), ("Boston", "", None)]
    )]
    stream = land(spark, f"{tmp_path}/in", [rows, rows[:3]], schema)
    details = spark.createDataFrame([("d1", ["Paris"]), ("d2", ["Paris", "NYC"])], "detail_url string, places array<string>")
    deliver = lambda d, name: d.write.mode("overwrite").parquet(f"{tmp_path}/sent/batch={name}")
    alerts.fast_lane(stream, f"{tmp_path}/seen", deliver, f"{tmp_path}/ck", lambda: datetime.datetime(2024, 1, 1), details=details, places=["nyc", "boston"]).awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/sent").collect()
    assert sorted(r.url or "" for r in sent) == ["", "", "b", "d"]
    assert [r.location for r in sent if r.url == "d"] == ["Paris; NYC"]


def test_fast_lane(spark, tmp_path):
    rows = [("New Grad Engineer", "c", "", "", u, "", "s", i) for i, u in enumerate(["a", "b", "", "a", "c"])]
    stream = land(spark, f"{tmp_path}/in", [rows[:3], rows[3:]], POSTING)
    sent = []
    alerts.fast_lane(stream, f"{tmp_path}/seen", lambda d, _: sent.extend(r.url for r in d.collect()), f"{tmp_path}/ck", lambda: datetime.datetime(2024, 1, 1)).awaitTermination()
    assert sorted(sent) == ["", "a", "b", "c"]


def test_pulse(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    hits = [("ACME", "New Grad", day(0)), ("Acme", "New Grad", day(0)), ("acme", "New Grad", day(4)), ("Acme", "New Grad", day(5)), ("B", "New Grad", day(2)), ("B", "Intern", day(9))]
    schema = "company string, title string, day date"
    batch = alerts.pulse_days(spark.createDataFrame([h for h in hits if "Intern" not in h[1]], schema)).collect()
    want = {("acme", day(0), day(4)), ("acme", day(5), day(9)), ("b", day(2), day(6))}
    assert {(r.company, r.first_seen, r.expires) for r in batch} == want
    stream = land(spark, f"{tmp_path}/in", [hits[:2], hits[2:3], hits[3:]], schema)
    q = alerts.recruitment_pulse(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.lower("company").alias("c"), "company", "first_seen", "expires", "count").collect()
    assert {(r.c, r.first_seen, r.expires) for r in got} == want
    assert {(r.company, r["count"]) for r in got if r.first_seen == day(0)} == {("ACME", 2)}


def test_pulse_in_any_order(spark, tmp_path):
    """Days come mixed within the lateness; they are folded in order. The last days wait for the watermark."""
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    hits = [("Acme", f"New Grad {i % 7}", "lever:acme", day(i % 12)) for i in range(60)] + [("Other", "New Grad", "remote", day(1)), ("Known", "New Grad", "", day(2)), (None, "New Grad", "a:b", day(3)), ("Acme", "New Grad", "a:b", None)]
    late = [hits[1::2], hits[::2], [("Acme", "Intern", "lever:acme", day(40))]]
    stream = land(spark, f"{tmp_path}/in", late, "company string, title string, source string, day date")
    known = spark.createDataFrame([(" KNOWN",), (None,)], "label string")
    pulse = alerts.recruitment_pulse(stream, lateness="12 days", watchlist=known)
    pulse.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.company, r.first_seen, r["count"]) for r in got) == [("", day(3), 1), ("Acme", day(0), 5), ("Acme", day(5), 5), ("Acme", day(10), 5), ("Known", day(2), 1)]
    assert all(r.expires == r.first_seen + datetime.timedelta(days=4) and 1 <= len(r.sample_roles) <= 4 for r in got)


def test_tier1(spark):
    posts = spark.createDataFrame([("lever:a",), ("lever:b",), ("x",)], "source string")
    boards = spark.createDataFrame([("lever", "a", True), ("lever", "b", False)], "platform string, slug string, tier1 boolean")
    assert [r.source for r in alerts.tier1_filter(posts, boards).collect()] == ["lever:a"]
