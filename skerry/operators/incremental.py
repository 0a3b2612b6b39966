"""Processing only what is new or changed (problem 2).

What has been processed is kept as disjoint, merged intervals of sequence numbers. A run
subtracts them from what is available, processes the gaps, late arrivals among them, and
commits the merged intervals in the same step that makes its output visible: neither a
failure before the commit nor a repeated run can skip or repeat a record.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.runtime import checkpoint_dir, numbered_files, write_once


class LedgerMoved(RuntimeError):
    """Another run has committed since this one read the ledger."""


@dataclass(frozen=True)
class Intervals:
    """A set of integers as sorted, disjoint, non-adjacent half-open intervals."""

    spans: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def of(spans: Iterable[tuple[int, int]]) -> Intervals:
        merged: list[list[int]] = []
        for lo, hi in sorted((lo, hi) for lo, hi in spans if lo < hi):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        return Intervals(tuple((lo, hi) for lo, hi in merged))

    def __or__(self, other: Intervals) -> Intervals:
        return Intervals.of([*self.spans, *other.spans])

    def __sub__(self, other: Intervals) -> Intervals:
        left: list[tuple[int, int]] = []
        cuts = list(other.spans)
        at = 0
        for lo, hi in self.spans:
            while at < len(cuts) and cuts[at][1] <= lo:
                at += 1
            k = at
            while k < len(cuts) and cuts[k][0] < hi:
                if lo < cuts[k][0]:
                    left.append((lo, cuts[k][0]))
                lo = max(lo, cuts[k][1])
                k += 1
            if lo < hi:
                left.append((lo, hi))
        return Intervals(tuple(left))

    def __contains__(self, n: int) -> bool:
        return any(lo <= n < hi for lo, hi in self.spans)


#: Buckets into which the span of all intervals is cut for the join with rows.
_BUCKETS = 1024
#: (bucket, interval) pairs of 24 bytes each that may be broadcast; with more the join shuffles.
_BROADCAST_PAIRS = 100_000
_FAR = 2**62


def within(df: DataFrame, position: str, intervals: Intervals) -> DataFrame:
    """The rows whose ``position`` (bigint) lies in one of the intervals; rows with a null one are left out.

    An equi-join by bucket with the bounds as a residue: linear in rows, whatever the number of
    intervals. The interval side is made on the driver, so its size is known; it is broadcast up to
    a bound and shuffled beyond.
    """
    spark = df.sparkSession
    if not intervals.spans:
        return df.where(F.lit(False))
    lo = intervals.spans[0][0]
    hi = max([b for _, b in intervals.spans if b < _FAR] + [intervals.spans[-1][0] + 1])
    width = max(1, (hi - lo) // _BUCKETS + 1)
    top = (hi - lo) // width
    pairs = [
        (b, a, z)
        for a, z in intervals.spans
        for b in range((a - lo) // width, min(top, (z - 1 - lo) // width) + 1)
    ]
    bounds = spark.createDataFrame(pairs, "skerry_bucket bigint, skerry_from bigint, skerry_to bigint")
    if len(pairs) <= _BROADCAST_PAIRS:
        bounds = F.broadcast(bounds)
    at = F.col(position)
    bucket = F.expr(f"least((skerry_at - {lo}L) div {width}L, {top}L)")
    keyed = df.withColumn("skerry_at", at).withColumn("skerry_bucket_of", bucket)
    return keyed.join(
        bounds,
        (F.col("skerry_bucket_of") == F.col("skerry_bucket")) & (F.col("skerry_at") >= F.col("skerry_from")) & (F.col("skerry_at") < F.col("skerry_to")),
        "left_semi",
    ).drop("skerry_at", "skerry_bucket_of")


def processed_time(runs: DataFrame) -> Intervals:
    """The stretches of time, in microseconds, that successful runs own.

    A run owns from its start until the next run's start, the last one for ever. Runs are the
    sequence numbers here: neighbouring successful runs merge, and failed, aborted and unfinished
    ones remain as gaps. The run table holds one row for each run ever made, not one for each
    record, and is read to the driver as two columns. Runs without a start own nothing; of runs
    that start together the one with the greatest run_id owns the time.
    """
    rows = runs.select(F.unix_micros(F.col("started_at").cast("timestamp")).alias("t"), "run_id", F.lower("status").alias("status")).where("started_at is not null").distinct().collect()
    rows.sort(key=lambda r: (r.t, r.run_id if r.run_id is not None else -1))
    ends = [r.t for r in rows[1:]] + [_FAR]
    available = Intervals.of([(rows[0].t, _FAR)]) if rows else Intervals()
    unfinished = Intervals.of((r.t, end) for r, end in zip(rows, ends) if r.status != "ok")
    return available - unfinished


class IncrementalRun:
    """Exactly-once processing of the records of a table by their sequence numbers.

    ``folder`` lies on storage that all executors share. A run reads the ledger once, which gives it
    the processed intervals and the number of its own commit. Its output goes to ``data/<id>``; the
    commit is one file ``commits/<number>.json`` that names this folder and holds all processed
    intervals. It is put in place whole, and only where no file of that number is, so of two runs that
    read the same ledger one commits and the other fails with ``LedgerMoved`` and can be repeated.
    Readers see outputs named by commits only, so what a failed attempt leaves behind is never read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _commits(self) -> list[dict]:
        return [json.loads(text) | {"number": n} for n, text in sorted(numbered_files(self.spark, f"{self.folder}/commits").items())]

    def ledger(self) -> tuple[Intervals, int]:
        """The processed intervals, and the number of the next commit, from one read."""
        commits = self._commits()
        return (Intervals.of(map(tuple, commits[-1]["processed"])), commits[-1]["number"] + 1) if commits else (Intervals(), 0)

    def processed(self) -> Intervals:
        return self.ledger()[0]

    def output(self) -> DataFrame | None:
        """All committed output."""
        folders = [c["data"] for c in self._commits() if c["data"]]
        return self.spark.read.parquet(*folders) if folders else None

    def run(self, records: DataFrame, sequence: str, process: Callable[[DataFrame], DataFrame], available: Intervals | None = None) -> Intervals:
        """Process the records that no committed run has processed; gives the intervals newly done.

        ``records`` is read as it is now; sequence numbers that appear later, even below the greatest
        one processed, are still gaps and come with a later run. ``available`` names ranges that are
        closed, in which no more records can appear; without it each number that ``records`` has now is
        available by itself, and no number beside it. Intervals are held on the driver: as many as the
        numbering has gaps. Records with a null number are never processed.
        """
        done, number = self.ledger()
        if available is None:
            # islands of consecutive numbers, built within stretches of 2^20 so that no task sees all
            numbers = records.where(F.col(sequence).isNotNull()).select(F.col(sequence).cast("bigint").alias("n")).distinct().withColumn("part", F.shiftright("n", 20))
            island = F.col("n") - F.row_number().over(Window.partitionBy("part").orderBy("n"))
            spans = numbers.select("n", "part", island.alias("island")).groupBy("part", "island").agg(F.min("n").alias("lo"), (F.max("n") + 1).alias("hi"))
            available = Intervals.of((r.lo, r.hi) for r in spans.select("lo", "hi").toLocalIterator())
        gaps = available - done
        if not gaps.spans:
            return gaps
        fresh = within(records.withColumn("skerry_number", F.col(sequence).cast("bigint")), "skerry_number", gaps).drop("skerry_number")
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        process(fresh).write.parquet(data)
        self._commit(number, data, done | gaps)
        return gaps

    def _commit(self, number: int, data: str, processed: Intervals) -> None:
        name = f"{self.folder}/commits/{number:08d}.json"
        try:
            write_once(self.spark, name, json.dumps({"data": data, "processed": processed.spans}))
        except FileExistsError as e:
            raise LedgerMoved(f"another run has committed {name}") from e


def _latest(rows: DataFrame, at: str) -> DataFrame:
    """(path, checksum, at) of the last row of each path; of rows with equal time the greatest checksum counts."""
    last = rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct(at, "checksum")).alias("last"))
    return last.select("path", F.col("last.checksum").alias("checksum"), F.col(f"last.{at}").alias(at))


def indexed_state(files: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame | None:
    """(path, checksum, at) as the successful runs left each path, None if there are no such runs.

    The records are the rows of ``files``, the ranges available are the stretches of time that
    successful runs own; what the ledger in ``folder`` has already is not read again, and its output
    is the last row of each path in each batch of gaps. The stretch of a last run has no end yet, so
    more can come into it: its rows are read each time and not committed. Without ``folder`` the ledger
    is a new one in the checkpoint folder, so all ranges are gaps.
    """
    spark = files.sparkSession
    ledger = IncrementalRun(spark, folder or f"{checkpoint_dir(spark)}/skerry-ledger-{uuid.uuid4().hex}")
    records = files.select("path", F.lower("checksum").alias("checksum"), F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("at"))
    owned = processed_time(runs)
    still = Intervals.of((lo, hi) for lo, hi in owned.spans if hi >= _FAR)
    ledger.run(records, "at", lambda rows: _latest(rows, "at"), owned - still)
    parts = [df for df in (ledger.output(), within(records, "at", still) if still.spans else None) if df is not None]
    return _latest(functools.reduce(DataFrame.unionByName, parts), "at") if parts else None


def new_or_changed(files: DataFrame, scan: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """Paths whose present checksum isn't the one that the last successful run left: (path).

    The present checksum of a path is that of its latest scan row that has one, by scanned_at; the
    indexed one that of its latest row among rows owned by a successful run, by indexed_at. They are
    compared without regard to letter case. Paths without a scanned checksum are no case, a path
    without such an indexed row, or whose indexed row has a null checksum, is one; a null path is
    none. Of rows with equal time the greatest checksum counts; a null time is earlier than any.
    The indexed state comes through the ledger of ``indexed_state``.
    """
    seen = scan.where(F.col("checksum").isNotNull()).select("path", F.lower("checksum").alias("checksum"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"))
    now = _latest(seen, "at").select("path", F.col("checksum").alias("now"))
    state = indexed_state(files, runs, folder)
    if state is None:
        return now.select("path")
    both = now.join(state.select("path", F.col("checksum").alias("then")), "path", "left")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("path")
