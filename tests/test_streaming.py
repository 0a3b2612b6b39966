import datetime as dt
import json

from skerry.streaming import watch


def _events(spark, rows):
    t0 = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(p, k, o, t0 + dt.timedelta(milliseconds=ms)) for p, k, o, ms in rows], watch.EVENTS)


def test_bursts(spark):
    df = _events(spark, [("a", "changed", None, 0), ("a", "changed", None, 400), ("a", "changed", None, 1000), ("b", "renamed", "c", 100), (None, "overflow", None, 50)])
    got = sorted((r.path, r.events) for r in watch.settled(df).collect())
    assert got == [("*", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert {r.path for r in watch.batches(watch.settled(df)).collect()} == {"*", "a", "b", "c"}


def test_watch_calls_once_for_each_event(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    seen = []

    def refresh(paths, full):
        seen.append((sorted(r.path for r in paths.collect()), full))

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        watch.watch(spark, str(folder), str(tmp_path / "ck"), refresh, once=True).awaitTermination(120)

    put("1.json", [{"path": "a", "kind": "changed", "ts": "2025-01-01T00:00:00Z"}, {"path": "a", "kind": "changed", "ts": "2025-01-01T00:00:00Z"}])
    run()
    put("2.json", [{"path": "n", "kind": "renamed", "old_path": "o", "ts": "2025-01-01T00:00:01Z"}, {"kind": "overflow", "ts": "2025-01-01T00:00:01Z"}])
    run()
    run()
    assert seen == [(["a"], False), (["n", "o"], True)]


def test_reindex(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    fresh = spark.createDataFrame([("a", 9)], "path string, v int")
    paths = spark.createDataFrame([("a",), ("gone",)], "path string")
    assert {tuple(r) for r in watch.reindex(t, fresh, paths).collect()} == {("a", 9), ("b", 2)}
