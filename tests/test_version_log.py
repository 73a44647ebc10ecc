"""The tracker's log: commits of their own rows only, one winner per version, snapshots, older versions."""

import pytest

from millrace.operators import tracker
from millrace.operators.version_log import Conflict, VersionLog, claim
from millrace.schemas import TRACKER_TYPES, with_columns_of

MATCH = "url string, title string, company string, location string, salary string, source string, score string, suitable string, matched_skills string, concerns string, reason string, date_processed string, ord int"


def rows(spark, *urls):
    return spark.createDataFrame([(u, "t", "c", "", "", "", str(i), "True", "", "", "", "", i) for i, u in enumerate(urls)], MATCH)


def base(spark, *keys):
    return with_columns_of(spark.createDataFrame([(k, 3) for k in keys], "key string, score int"), TRACKER_TYPES)


def test_a_commit_writes_only_its_rows(spark, tmp_path):
    store = tracker.TrackerStore(spark, f"file://{tmp_path}/t", every=100)
    store.bootstrap(base(spark, *[f"k{i}" for i in range(50)]))
    assert store.store_matches(rows(spark, "k1", "n1", "n2", "n1"), "t1") == (2, 4)
    keys = spark.createDataFrame([("k3",), ("n1",), ("none",)], "key string")
    assert store.change(keys, lambda r: tracker.soft_delete(r, keys, "user", "t2")) == (3, 2)
    assert store.change(keys, lambda r: tracker.soft_delete(r, keys, "user", "t3")) == (4, 0)
    assert [(r.version, r.kind, r.rows) for r in store.history().collect()] == [(1, "snapshot", 50), (2, "add", 2), (3, "change", 2), (4, "change", 0)]
    now = {r.key: r for r in store.read().collect()}
    assert len(now) == 52 and now["k3"].deleted_at == now["n1"].deleted_at == "t2" and now["n2"].created_at == "t1"
    assert store.read(2).filter("deleted_at is not null").count() == 0 and store.read(1).count() == 50
    assert {r.key: r for r in store.read().collect()} == now


def test_two_writers_cannot_both_win(spark, tmp_path):
    log = VersionLog(spark, f"file://{tmp_path}/t", "key string, n int")
    one, two = (log.write(spark.createDataFrame([(k, 1)], "key string, n int"), 1) for k in "ab")
    assert log.commit(1, "add", *one) == 1
    with pytest.raises(Conflict):
        log.commit(1, "add", *two)
    assert [r.key for r in log.read().collect()] == ["a"]
    assert not claim(spark, f"file://{tmp_path}/t/log", "000000000001.json", "x") and log.version() == 1


def test_the_second_writer_starts_again(spark, tmp_path):
    """Between the first writer's read and its claim another one adds the same keys."""
    path = f"file://{tmp_path}/t"
    store, other = tracker.TrackerStore(spark, path), tracker.TrackerStore(spark, path)
    store.bootstrap(base(spark, "k"))
    write, met = store.log.write, []

    def late(*a):
        if not met:
            met.append(other.store_matches(rows(spark, "x", "y"), "other"))
        return write(*a)

    store.log.write = late
    assert store.store_matches(rows(spark, "x", "z"), "mine") == (1, 2) and met == [(2, 2)]
    assert {r.key: r.created_at for r in store.read().collect()} == {"k": None, "x": "other", "y": "other", "z": "mine"}


def test_snapshots_bound_what_is_read(spark, tmp_path):
    store = tracker.TrackerStore(spark, f"file://{tmp_path}/t", every=2)
    store.bootstrap(base(spark, "k"))
    for i in range(4):
        store.store_matches(rows(spark, f"u{i}", "k"), f"t{i}")
    kinds = [r.kind for r in store.history().collect()]
    assert kinds.count("snapshot") > 1 and len(store.log._in_force(store.version())) <= 3
    assert sorted(r.key for r in store.read().collect()) == ["k", "u0", "u1", "u2", "u3"]


def test_empty_batches(spark, tmp_path):
    store = tracker.TrackerStore(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        store.store_matches(rows(spark, "a"), "t")
    store.bootstrap(base(spark, "k").limit(0))
    assert store.store_matches(rows(spark, "a").limit(0), "t") == (0, 0)
    assert store.read().count() == 0
