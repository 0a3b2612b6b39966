"""Differences between two copies of a table (problem 5).

Both copies go through one range partitioning, so they share its split points; each
partition is sorted by key and side and read once, front to back, by a two-pointer merge
that works on whole Arrow batches and drops copies of a row as it meets them. Rows are
exchanged once. A key with very many rows, null among them, is cut into several partitions;
what such a part says of a key is a few values for each column, and these are added up.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.runtime import shuffle_partitions

_OUT = "area string, row_key string, diff string"
#: Rows of one key beyond this are folded into the values that decide instead of being held.
_HELD_ROWS = 20_000


def _changes(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Where two aligned columns differ; null equals null only."""
    same = pc.fill_null(pc.equal(left, right), False).to_numpy(zero_copy_only=False)
    both_null = pc.and_(pc.is_null(left), pc.is_null(right)).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(left.type):
        both_nan = pc.and_(pc.fill_null(pc.is_nan(left), False), pc.fill_null(pc.is_nan(right), False)).to_numpy(zero_copy_only=False)
        same = same | both_nan
    return ~(same | both_null)


class _Values:
    """What decides about one key: of each side and column up to two different values, null being one.

    Two rows of the two sides differ in a column unless both sides have one and the same value there.
    Sums of this kind can be taken anywhere and added up, so a key may be spread over many tasks.
    """

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = columns
        self.sides: dict[int, dict[str, pa.Array]] = {}

    def _keep(self, side: int, column: str, values: pa.Array) -> None:
        kept = self.sides.setdefault(side, {})
        kept[column] = (pa.concat_arrays([kept[column], values]) if column in kept else values).unique().slice(0, 2)

    def add(self, rows: pa.Table) -> None:
        for side in (0, 1):
            part = rows.filter(pc.equal(rows["side"], side))
            if part.num_rows:
                self.sides.setdefault(side, {})
                for c in self.columns:
                    self._keep(side, c, part[c].combine_chunks())

    def packed(self) -> bytes:
        return pickle.dumps(self.sides)

    def add_packed(self, data: bytes) -> None:
        for side, kept in pickle.loads(data).items():
            self.sides.setdefault(side, {})
            for c, values in kept.items():
                self._keep(side, c, values)

    def differences(self) -> list[str]:
        if len(self.sides) == 1:
            return ["only_right" if 1 in self.sides else "only_left"]
        left, right = self.sides[0], self.sides[1]
        return [c for c in self.columns if len(left[c]) > 1 or len(right[c]) > 1 or _changes(left[c], right[c])[0]]


def _rows_out(area: str, keys: list, diffs: list, parts: list | None = None) -> pa.RecordBatch:
    parts = [None] * len(keys) if parts is None else parts
    return pa.RecordBatch.from_arrays(
        [pa.array([area] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(diffs, pa.string()), pa.array(parts, pa.binary())],
        names=["area", "row_key", "diff", "part"],
    )


def _starts(rows: pa.Table) -> np.ndarray:
    key = rows["key"].combine_chunks()
    new = _changes(key.slice(1), key.slice(0, len(key) - 1)) if len(key) > 1 else np.zeros(0, bool)
    return np.append(0, np.flatnonzero(new) + 1)


def _without_copies(rows: pa.Table, columns: Sequence[str]) -> pa.Table:
    """``rows`` without those that equal the one before them."""
    n = rows.num_rows
    if n < 2:
        return rows
    other = np.zeros(n - 1, bool)
    for c in ("key", "side", *columns):
        col = rows[c].combine_chunks()
        other |= _changes(col.slice(1), col.slice(0, n - 1))
    return rows if other.all() else rows.filter(pa.array(np.append(True, other)))


def _merge(area: str, columns: Sequence[str]):
    def closed(rows: pa.Table) -> pa.RecordBatch:
        """All keys of ``rows`` are complete."""
        n = rows.num_rows
        starts = _starts(rows)
        ends = np.append(starts[1:], n)
        side = rows["side"].to_numpy()
        text = rows["key_text"].combine_chunks()
        single = ends - starts == 1
        pair = (ends - starts == 2) & (side[starts] != side[np.minimum(starts + 1, n - 1)])
        keys: list = []
        diffs: list = []
        alone = starts[single]
        keys += text.take(pa.array(alone)).to_pylist()
        diffs += np.where(side[alone] == 0, "only_left", "only_right").tolist()
        at = starts[pair]
        if len(at):
            ours, theirs = pa.array(at), pa.array(at + 1)
            for c in columns:
                col = rows[c].combine_chunks()
                hit = at[_changes(col.take(ours), col.take(theirs))]
                keys += text.take(pa.array(hit)).to_pylist()
                diffs += [c] * len(hit)
        for k in np.flatnonzero(~single & ~pair):
            acc = _Values(columns)
            acc.add(rows.slice(starts[k], ends[k] - starts[k]))
            found = acc.differences()
            keys += [text[int(starts[k])].as_py()] * len(found)
            diffs += found
        return _rows_out(area, keys, diffs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Differences of the keys that lie within the split, and the sums of its first and last key, which may go on in others."""
        held: pa.Table | None = None
        hot: _Values | None = None
        opened = False  # whether the first key is behind
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = _without_copies(rows if held is None else pa.concat_tables([held, rows]), columns)
            starts = _starts(rows)
            last = int(starts[-1])
            if last and (hot is not None or not opened):
                end = int(starts[1])
                key = rows["key_text"][0].as_py()
                acc = hot or _Values(columns)
                acc.add(rows.slice(0, end))
                if opened:
                    found = acc.differences()
                    yield _rows_out(area, [key] * len(found), found)
                else:
                    yield _rows_out(area, [key], [None], [acc.packed()])
                rows, last, hot, opened = rows.slice(end), last - end, None, True
            if last:
                yield closed(rows.slice(0, last))
            held = rows.slice(last).combine_chunks()
            if held.num_rows > _HELD_ROWS:
                hot = hot or _Values(columns)
                hot.add(held)
                held = held.slice(held.num_rows - 1)  # stays as a mark of the key; adding it twice changes nothing
        if held is not None and held.num_rows:
            acc = hot or _Values(columns)
            acc.add(held)
            yield _rows_out(area, [held["key_text"][0].as_py()], [None], [acc.packed()])

    return merge


def _ranged(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], area: str) -> DataFrame:
    """Differences found within splits, and sums of the keys at the ends of splits: (area, row_key, diff, part)."""
    spark = left.sparkSession
    sides = [df.select(F.col(key).alias("key"), *(F.col(c) for c in columns), F.lit(i).alias("side"), F.spark_partition_id().alias("skerry_split")) for i, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1])
    # a key with many rows is cut by the input splits that they come from
    ranged = both.repartitionByRange(shuffle_partitions(spark), "key", "skerry_split").drop("skerry_split").withColumn("key_text", F.col("key").cast("string")).sortWithinPartitions("key", "side")
    return ranged.mapInArrow(_merge(area, list(columns)), f"{_OUT}, part binary")


def _combined(found: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    """The differences, the sums of keys at the ends of splits being added up; no more than two of these come from a split."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, _Values] = {}
        for b in batches:
            done = pc.is_null(b.column("part"))
            yield b.filter(done).select(["area", "row_key", "diff"])
            rest = b.filter(pc.invert(done))
            for area, key, part in zip(*(rest.column(c).to_pylist() for c in ("area", "row_key", "part"))):
                sums.setdefault((area, key), _Values(columns[area])).add_packed(part)
        for (area, key), acc in sums.items():
            diffs = acc.differences()
            yield _rows_out(area, [key] * len(diffs), diffs).select(["area", "row_key", "diff"])

    return found.repartition(shuffle_partitions(found.sparkSession), "area", "row_key").mapInArrow(combine, _OUT)


def diff_copies(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], area: str) -> DataFrame:
    """Rows on one side only and, of rows on both, each column that differs: (area, row_key, diff).

    ``diff`` is ``only_left``, ``only_right`` or a column name, one row for each. Null equals null
    only; null and empty text differ; text is compared byte by byte. Copies of a row and the order
    of rows don't count. A null key is compared like any other key and comes out as a null
    ``row_key``. Where a key has several different rows, each row of one side is compared with each of
    the other, and a column differs if it does in any pair. Empty tables give one-sided rows or none.
    Columns other than the named ones are never read.
    """
    return _combined(_ranged(left, right, key, columns, area), {area: list(columns)})


SYMBOL_FIELDS = (
    "file_id", "kind", "sub_kind", "name", "line", "start_line", "start_column", "end_line", "body_start_line", "body_end_line", "signature",
    "container_kind", "container_name", "container_qualified_name", "family_key", "visibility", "return_type", "name_folded",
)
HEADER_FIELDS = ("schema_version", "file_count", "symbol_count", "reference_count", "first_file_id", "last_file_id")


def diff_index_copies(symbols: DataFrame, symbols_right: DataFrame, headers: DataFrame) -> DataFrame:
    """All differences between two copies of an index: its symbols by id and its headers by name."""
    left = headers.where(F.lower("side") == "left")
    right = headers.where(F.lower("side") == "right")
    found = _ranged(symbols, symbols_right, "symbol_id", SYMBOL_FIELDS, "symbols").unionByName(_ranged(left, right, "db_name", HEADER_FIELDS, "header"))
    return _combined(found, {"symbols": SYMBOL_FIELDS, "header": HEADER_FIELDS})
