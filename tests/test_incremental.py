import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.runtime import numbered_files, write_once
from skerry.operators.incremental import IncrementalRun, Intervals, LedgerMoved, indexed_state, new_or_changed, processed_time, within

spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=8)


def numbers(x):
    return {n for lo, hi in x.spans for n in range(lo, hi)}


@given(spans, spans)
def test_intervals_are_sets(a, b):
    x, y = Intervals.of(a), Intervals.of(b)
    assert numbers(x) == {n for lo, hi in a for n in range(lo, hi)}
    assert numbers(x | y) == numbers(x) | numbers(y)
    assert numbers(x - y) == numbers(x) - numbers(y)
    for s in (x, y, x | y, x - y):
        assert all(p[1] < q[0] for p, q in zip(s.spans, s.spans[1:]))
    assert all((n in x) == (n in numbers(x)) for n in range(61))


def test_within_is_exact_at_bounds(spark):
    df = spark.range(-5, 200).withColumnRenamed("id", "p").unionByName(spark.createDataFrame([(None,)], "p bigint"))
    cut = Intervals.of([(0, 3), (10, 11), (50, 120)])
    assert sorted(r.p for r in within(df, "p", cut).collect()) == sorted(numbers(cut))
    open_end = Intervals.of([(7, 2**62)])
    assert sorted(r.p for r in within(df, "p", open_end).collect()) == list(range(7, 200))
    assert within(df, "p", Intervals()).count() == 0


def test_runs_take_each_record_once(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/ledger")
    source = lambda ns: spark.createDataFrame([(n, f"r{n}") for n in ns], "seq bigint, v string")
    run.run(source([1, 2, 3, 7]), "seq", lambda d: d)
    assert run.processed().spans == ((1, 4), (7, 8))

    def broken(df):
        return df.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception):
        run.run(source([1, 2, 3, 4, 7, 9]), "seq", broken)
    assert run.processed().spans == ((1, 4), (7, 8))
    # 5 commits late, below the greatest number that has been processed
    assert run.run(source([1, 2, 3, 4, 5, 7, 9]), "seq", lambda d: d).spans == ((4, 6), (9, 10))
    assert run.run(source([1, 2, 3, 4, 5, 7, 9]), "seq", lambda d: d).spans == ()
    assert sorted(r.seq for r in run.output().collect()) == [1, 2, 3, 4, 5, 7, 9]


def test_of_two_runs_that_read_one_ledger_one_commits(spark, tmp_path):
    a, b = (IncrementalRun(spark, f"file://{tmp_path}/l") for _ in range(2))
    data = spark.createDataFrame([(1, "x"), (2, "y")], "seq bigint, v string")

    def late(df):
        b.run(data, "seq", lambda d: d)  # reads and commits between the other run's read and its commit
        return df

    with pytest.raises(LedgerMoved):
        a.run(data, "seq", late)
    assert sorted(r.seq for r in a.output().collect()) == [1, 2]
    assert a.run(data, "seq", lambda d: d).spans == ()
    more = spark.createDataFrame([(n, "z") for n in range(5)], "seq bigint, v string")
    assert a.run(more, "seq", lambda d: d).spans == ((0, 1), (3, 5))
    assert sorted(r.seq for r in b.output().collect()) == [0, 1, 2, 3, 4]


def test_of_many_runs_at_once_each_record_comes_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    data = spark.range(50).withColumnRenamed("id", "seq")

    def attempt(_):
        try:
            return len(IncrementalRun(spark, f"file://{tmp_path}/m").run(data, "seq", lambda d: d).spans)
        except LedgerMoved:
            return -1

    with ThreadPoolExecutor(6) as pool:
        ends = list(pool.map(attempt, range(6)))
    assert ends.count(1) == 1
    assert sorted(r.seq for r in IncrementalRun(spark, f"file://{tmp_path}/m").output().collect()) == list(range(50))


@pytest.mark.parametrize("by_link", [True, False])
def test_a_file_is_written_once(spark, tmp_path, by_link):
    path = f"file://{tmp_path}/n/00000003.json"
    write_once(spark, path, "a", by_link)
    with pytest.raises(FileExistsError):
        write_once(spark, path, "b", by_link)
    assert numbered_files(spark, f"file://{tmp_path}/n") == {3: "a"}
    assert [f.name for f in (tmp_path / "n").iterdir() if not f.name.endswith(".crc")] == ["00000003.json"]


def test_closed_ranges(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/c")
    data = spark.createDataFrame([(n,) for n in (3, 5, 11, 25)] + [(None,)], "seq bigint")
    assert run.run(data, "seq", lambda d: d, Intervals.of([(0, 10), (20, 30)])).spans == ((0, 10), (20, 30))
    assert run.run(data, "seq", lambda d: d, Intervals.of([(0, 40)])).spans == ((10, 20), (30, 40))
    assert sorted(r.seq for r in run.output().collect()) == [3, 5, 11, 25]


def _t(hour):
    return dt.datetime(2025, 1, 1, hour)


def test_new_or_changed(spark):
    runs = spark.createDataFrame([(1, _t(1), _t(2), "ok"), (2, _t(3), None, "failed"), (3, _t(5), _t(6), "OK"), (3, _t(5), _t(6), "OK"), (4, _t(8), None, "running"), (5, None, None, "ok")], "run_id bigint, started_at timestamp, finished_at timestamp, status string")
    files = spark.createDataFrame(
        [("same", "AB", _t(1)), ("changed", "aa", _t(1)), ("bad_run", "cc", _t(3)), ("late_bad", "dd", _t(5)), ("late_bad", "ee", _t(9)), ("nullsum", None, _t(1)), (None, "zz", _t(1)), ("before", "ff", _t(0)), ("gone", "11", _t(1))],
        "path string, checksum string, indexed_at timestamp",
    ).withColumn("now", F.lit("clash")).withColumn("present", F.lit(1))
    scan = spark.createDataFrame(
        [("same", "ab", _t(9)), ("changed", "aa", _t(8)), ("changed", "bb", _t(9)), ("bad_run", "cc", _t(9)), ("late_bad", "dd", _t(9)), ("nullsum", "x", _t(9)), ("unread", None, _t(9)), ("same", None, _t(10)), ("before", "ff", _t(9)), ("new", "", _t(9)), (None, "q", _t(9))],
        "path string, checksum string, scanned_at timestamp",
    )
    assert sorted(r.path for r in new_or_changed(files, scan, runs).collect()) == ["bad_run", "before", "changed", "new", "nullsum"]
    empty = files.limit(0)
    assert new_or_changed(empty, scan.limit(0), runs).count() == 0
    assert new_or_changed(empty, scan, runs.limit(0)).count() == 7
    assert len(processed_time(runs).spans) == 2


def test_indexed_state_goes_on_from_its_ledger(spark, tmp_path):
    runs = [(1, _t(1), "ok"), (2, _t(3), "failed")]
    files = [("a", "1", _t(1)), ("b", "2", _t(2)), ("a", "9", _t(3))]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    ddl, run_ddl, folder = "path string, checksum string, indexed_at timestamp", "run_id bigint, started_at timestamp, status string", f"file://{tmp_path}/s"
    state = lambda: {r.path: r.checksum for r in indexed_state(frame(files, ddl), frame(runs, run_ddl), folder).collect()}
    assert state() == {"a": "1", "b": "2"}
    runs += [(3, _t(5), "ok"), (4, _t(7), "running")]
    files[:] = [("a", "3", _t(6)), ("b", "7", _t(8))]  # what is processed needn't be there any more
    assert state() == {"a": "3", "b": "2"}
    runs[3] = (4, _t(7), "ok")  # no end is known of its time
    assert state() == {"a": "3", "b": "7"}
    files.append(("c", "8", _t(9)))
    assert state() == {"a": "3", "b": "7", "c": "8"}
