"""File streams, debouncing and windows."""

import datetime as dt

from lattica.streaming import watch


def test_files_arrive_once_and_last_version_counts(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / "b.bin").write_bytes(b"\x00")
    seen = []
    events = watch.file_events(spark, str(root))
    for _ in range(2):
        q = watch.refresh(events, lambda df, bulk: seen.extend((r.path.rsplit("/", 1)[-1], r.content) for r in df.collect()), str(tmp_path / "check"), every=None)
        q.awaitTermination(60)
        (root / "c.py").write_text("y = 2\n")
    assert seen == [("a.py", "x = 1\n"), ("c.py", "y = 2\n")]


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))


def drained(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_bursts_are_one_row(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(milliseconds=200)), ("a", t + dt.timedelta(seconds=5)), ("z", t + dt.timedelta(hours=1))]
    got = drained(watch.debounced(stream(spark, tmp_path, rows, "path string, ts timestamp")), spark, "bursts")
    assert sorted(r.n for r in got if r.path == "a") == [1, 2]


def test_opened_and_closed(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "context", t), (1, "scan", t + dt.timedelta(minutes=5)), (2, "context", t), (2, "scan", t + dt.timedelta(hours=3))]
    got = drained(watch.closing(stream(spark, tmp_path, rows, "task_id long, command string, timestamp timestamp"), "context", "scan"), spark, "closed")
    assert [r.task_id for r in got] == [1]
