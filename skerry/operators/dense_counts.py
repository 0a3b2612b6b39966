"""Per-key sums with even work for all keys (problem 1).

A few keys hold most rows, so nothing here ever moves rows by key. Each input split
encodes its keys against its own dictionary and adds up into a dense array by
``numpy.bincount``; what leaves a split is, for each block of the key space, one array
of names and one array of sums, hence at most one entry for each key and split however
often the key occurs. The blocks are then summed in a distributed reduction, again
as arrays. The number of blocks follows the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import shuffle_partitions

BLOCKS_PER_PARTITION = 4
#: A split hands on its arrays and starts afresh beyond this many names, to bound its memory.
SLOTS_PER_SPLIT = 1_000_000

_BLOCK_SCHEMA = "block int, measure int, names array<string>, sums array<bigint>"


class _SplitSums:
    """Dense accumulators of one split, a slot for each (measure, key) seen there."""

    def __init__(self) -> None:
        self.slots: dict[tuple[int, str], int] = {}
        self.blocks: list[int] = []
        self.sums = np.zeros(1024, dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        measures = batch.column("measure").to_numpy(zero_copy_only=False)
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        weights = batch.column("weight").to_numpy(zero_copy_only=False)
        encoded = batch.column("name").dictionary_encode()
        names = encoded.dictionary.to_pylist()
        # one code for each (measure, name) of the batch
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + measures.astype(np.int64) * len(names)
        used, first, local = np.unique(codes, return_index=True, return_inverse=True)
        if np.all(weights == 1):
            sums = np.bincount(local, minlength=len(used)).astype(np.int64)
        else:  # bincount with weights would pass through doubles
            sums = np.zeros(len(used), dtype=np.int64)
            np.add.at(sums, local, weights)
        slots = np.empty(len(used), dtype=np.int64)
        for i, code in enumerate(used.tolist()):
            key = (code // len(names), names[code % len(names)])
            slot = self.slots.setdefault(key, len(self.blocks))
            if slot == len(self.blocks):
                self.blocks.append(int(blocks[first[i]]))
            slots[i] = slot
        if len(self.blocks) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros(max(len(self.sums), len(self.blocks)), dtype=np.int64)])
        self.sums[slots] += sums

    def flush(self) -> pa.RecordBatch | None:
        if not self.slots:
            return None
        out: dict[tuple[int, int], tuple[list[str], list[int]]] = {}
        for (measure, name), slot in self.slots.items():
            names, sums = out.setdefault((self.blocks[slot], measure), ([], []))
            names.append(name)
            sums.append(int(self.sums[slot]))
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in out], pa.int32()),
                pa.array([k[1] for k in out], pa.int32()),
                pa.array([v[0] for v in out.values()], pa.list_(pa.string())),
                pa.array([v[1] for v in out.values()], pa.list_(pa.int64())),
            ],
            names=["block", "measure", "names", "sums"],
        )


def _encode_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc = _SplitSums()
    for batch in batches:
        if batch.num_rows:
            acc.add(batch)
        if len(acc.slots) >= SLOTS_PER_SPLIT:
            yield acc.flush()
    if (last := acc.flush()) is not None:
        yield last


def _reduce_block(measures: int):
    def reduce(block: pa.Table) -> pa.Table:
        names = block.column("names").combine_chunks()
        lengths = np.asarray(names.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        encoded = names.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        sums = block.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        which = np.repeat(block.column("measure").to_numpy(), lengths)
        dense = np.zeros((measures, len(encoded.dictionary)), dtype=np.int64)
        np.add.at(dense, (which, codes), sums)
        return pa.table([encoded.dictionary.cast(pa.string()), *(pa.array(row) for row in dense)], names=["name", *(f"m{i}" for i in range(measures))])

    return reduce


def dense_counts(inputs: Sequence[tuple[DataFrame, Column, Column | None, str]], key: str = "name") -> DataFrame:
    """Sum several measures by one text key: ``(frame, key, weight or None to count, output name)``.

    Gives one row for each key that occurs in any frame, 0 where it is absent. Null keys are
    left out; null weights count 0; empty text is a key like any other; no row is dropped or
    sampled. Empty frames give no rows. Only the named expressions are read, so extra columns
    of any name do no harm. Sums are 64-bit integers.
    """
    spark = inputs[0][0].sparkSession
    blocks = BLOCKS_PER_PARTITION * shuffle_partitions(spark)
    rows = None
    for i, (df, name, weight, _) in enumerate(inputs):
        part = df.select(
            name.cast("string").alias("name"),
            (F.lit(1).cast("bigint") if weight is None else F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))).alias("weight"),
        ).where(F.col("name").isNotNull())
        part = part.select("name", "weight", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"), F.lit(i).alias("measure"))
        rows = part if rows is None else rows.unionByName(part)
    split = rows.mapInArrow(_encode_split, _BLOCK_SCHEMA)
    schema = "name string, " + ", ".join(f"m{i} bigint" for i in range(len(inputs)))
    summed = split.groupBy("block").applyInArrow(_reduce_block(len(inputs)), schema)
    return summed.select(F.col("name").alias(key), *(F.col(f"m{i}").alias(out) for i, (*_, out) in enumerate(inputs)))


def site_and_stored_counts(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """For each symbol name the number of its sites and the sum of its stored counts.

    A site is a distinct (file_id, symbol_name, line, column_number), nulls being values; stored
    counts are summed over the distinct rows of the eight-column table. Both ``distinct``s shuffle
    by the whole row after a map-side combine, so a name that holds a third of all rows is spread
    over all partitions.
    """
    sites = refs.select("file_id", "symbol_name", "line", "column_number").where(F.col("symbol_name").isNotNull()).distinct()
    kept = stored.select(
        "file_id", "lang", "raw_symbol_name", "symbol_name", "symbol_segment_count", "allow_leaf_fallback", "reference_count", "reference_score"
    ).where(F.col("symbol_name").isNotNull()).distinct()
    return dense_counts(
        [(sites, F.col("symbol_name"), None, "sites"), (kept, F.col("symbol_name"), F.col("reference_count"), "stored")],
        key="symbol_name",
    )


def count_mismatches(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Names whose stored counts don't add up to their number of sites."""
    return site_and_stored_counts(refs, stored).where(F.col("sites") != F.col("stored")).select("symbol_name")
