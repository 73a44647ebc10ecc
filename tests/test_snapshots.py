"""Snapshots on disk: written anew, kept, protected, unfinished."""

from millrace.sources import sinks


def test_retention(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    assert sinks.retain_snapshots(spark, path) == []
    for date in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-03", "2024-01-04"):
        sinks.write_snapshot(spark.range(3), path, date)
    (tmp_path / "snapshots" / "snapshot_date=2024-01-09").mkdir()
    assert sinks.retain_snapshots(spark, path, 2, ["2024-01-01"]) == ["2024-01-02"]
    assert sinks.retain_snapshots(spark, path, 2) == ["2024-01-01"]
    left = spark.read.parquet(path).groupBy("snapshot_date").count().collect()
    assert sorted((str(r.snapshot_date), r["count"]) for r in left) == [("2024-01-03", 3), ("2024-01-04", 3)]
    assert (tmp_path / "snapshots" / "snapshot_date=2024-01-09").exists()
