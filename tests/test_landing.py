"""Landing files and comment trees: broken, empty and odd ones."""

import json

from millrace.sources import files, normalize


def write(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    return str(folder)


def test_documents(spark, tmp_path):
    job = {"title": "Dev", "company": None, "url": "u1", "salary": 5, "more": [1]}
    path = write(
        tmp_path / "docs", whole=json.dumps({"scraped_at": "t", "jobs": [job, {"url": "u2"}, None, {}]}, indent=2), bare=json.dumps([job, {"title": "x"}]),
        cut='{"jobs": [{"title": "lost"}, {"ti', none='{"jobs": []}', other='{"rows": [1]}', blank="",
    )
    good, bad = files.read_landing(spark, path)
    rows = sorted(good.collect(), key=lambda r: (r.scraped_at or "", r.ord))
    assert [(r.scraped_at, r.title, r.url, r.salary) for r in rows] == [(None, "Dev", "u1", "5"), (None, "x", None, None), ("t", "Dev", "u1", "5"), ("t", None, "u2", None)]
    counts = {r.file.rsplit("/", 1)[-1]: r.bad for r in bad.collect()}
    assert counts == {"whole.json": 2, "cut.json": 1, "other.json": 1}


def test_lines_are_split_and_keep_their_order(spark, tmp_path):
    lines = [json.dumps({"title": f"Dev {i}", "url": "x" * (i % 50), "scraped_at": "t"}) for i in range(5000)]
    lines[7], lines[8] = lines[7][:-4], "5"
    path = write(tmp_path / "lines", a="\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        good, bad = files.read_landing(spark, path, lines=True)
        assert good.rdd.getNumPartitions() > 3
        rows = sorted((r.ord, r.title) for r in good.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [t for _, t in rows] == [f"Dev {i}" for i in range(5000) if i not in (7, 8)]
    assert len({o for o, _ in rows}) == len(rows)
    assert [r.bad for r in bad.collect()] == [2]


def test_comment_tree(spark):
    tree = {"id": 0, "children": [{"id": 1, "text": "a", "children": [{"id": 2, "text": None, "children": [{"id": 3, "text": "c"}]}, {"text": "d", "children": 5}]}, {"id": 4, "text": "e", "children": []}]}
    threads = spark.createDataFrame([("t", json.dumps(tree)), ("broken", '{"children": [{"id"'), ("null", None), ("none", "{}"), ("flat", '{"children": {"id": 1}}')], "thread string, payload string")
    got = sorted((r.thread, r.path, r.id, r.parent_id, r.depth, r.n_children, r.text) for r in normalize.comment_tree(threads).collect())
    assert got == [
        ("t", [0], "1", None, 1, 2, "a"), ("t", [0, 0], "2", "1", 2, 1, None), ("t", [0, 0, 0], "3", "2", 3, 0, "c"), ("t", [0, 1], None, "1", 2, 0, "d"), ("t", [1], "4", None, 1, 0, "e"),
    ]
    assert normalize.comment_tree(threads.filter("thread <> 't'")).count() == 0
