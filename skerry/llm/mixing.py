"""Mixing sources to target weights by Poisson replication (problem 8).

Each document draws how often it is used from a Poisson distribution, by inverting the
distribution at a number hashed from its id and a seed: the draw needs no state, is the
same on every run and executor, and never grows with the corpus. The count is capped at
the source's ``max_repeats``, and the mean before the cap is set so that the tokens that
this very seed draws, not only those expected, meet the source's target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokenizer import DEFAULT_VOCABULARY, token_counts
from skerry.runtime import cut_lineage, shuffle_partitions

SEED = 17
#: Cells into which the hashed numbers are counted to set the means.
CELLS = 4096
#: Sources up to which the plan of a mix is broadcast; with more, documents are exchanged by source.
BROADCAST_SOURCES = 10_000
#: Numbers are drawn in steps of this size, so no chance below it can come up.
_STEP = 2.0**-53


def hashed_unit(column: Column, seed: int) -> Column:
    """A number in [0, 1) for each value, from its hash."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def distribution(mean: float, cap: int | None) -> np.ndarray:
    """P(count <= k) for k below the cap: a number u draws as many repeats as entries it reaches.

    Without a cap the entries go on until none is left that a number below 1 could reach.
    """
    if math.isinf(mean):
        return np.zeros(cap)
    if mean <= 0:
        return np.ones(cap if cap is not None else 1)
    most = cap
    if cap is None:
        most = int(mean + 12 * math.sqrt(mean)) + 60
    k = np.arange(most, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) if most else k
    cdf = np.minimum(np.cumsum(np.exp(-mean + k * math.log(mean) - logs)), 1.0)
    if cap is None:
        cdf = np.append(cdf[cdf < 1 - _STEP], 1.0)
    return cdf


@dataclass
class _Source:
    name: str
    weight: float
    cap: int | None  # null: no cap
    cells: np.ndarray  # tokens by cell of the hashed number

    def __post_init__(self) -> None:
        self.tail = np.concatenate([np.cumsum(self.cells[::-1])[::-1], [0.0]])
        self.tokens = float(self.tail[0])

    def drawn(self, mean: float) -> float:
        """Tokens drawn with this mean, on these hashed numbers."""
        x = distribution(mean, self.cap) * CELLS
        low = np.minimum(x.astype(int), CELLS - 1)
        inside = np.where(x < CELLS, self.tail[low] + (self.tail[low + 1] - self.tail[low]) * (x - low), 0.0)
        return float(inside.sum())

    def mean_for(self, tokens: float) -> float:
        if self.cap is not None and tokens >= self.cap * self.tokens:
            return math.inf
        low, high = 0.0, 1.0
        while self.drawn(high) < tokens:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if self.drawn(middle) < tokens else (low, middle)
        return high


def _measured(documents: DataFrame, vocabulary: str, seed: int) -> DataFrame:
    sized = token_counts(documents, [F.col("doc_id"), F.col("source")], vocabulary)
    return cut_lineage(sized.where("source is not null and n_tokens > 0").withColumn("u", hashed_unit(F.col("doc_id"), seed)))


_PLAN = "source string, weight double, max_repeats int, available bigint, target double, mean double, thresholds array<double>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean and the thresholds of each source, from its sums by cell."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cells = np.zeros(CELLS)
            for c in r["cells"] or ():
                cells[c["cell"]] = c["n"]
            s = _Source(r["source"], r["weight"], r["cap"], cells)
            if s.tokens > 0 and s.cap != 0:
                target = s.weight / r["weights"] * r["total"]
                mean = s.mean_for(target)
                rows.append((s.name, s.weight / r["weights"], s.cap, int(s.tokens), target, mean, distribution(mean, s.cap).tolist()))
            else:
                rows.append((s.name, 0.0, s.cap, int(s.tokens), 0.0, 0.0, [2.0]))
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "weight", "max_repeats", "available", "target", "mean", "thresholds"])


def plan_mix(sized: DataFrame, mix: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """The draw of each source: (source, weight, max_repeats, available, target, mean, thresholds).

    ``sized`` has source, n_tokens and u. Weights are taken relative to the sum over sources that have
    documents; of several rows of a source the greatest weight and cap count, and a source whose
    ``max_repeats`` is null has no cap. ``total_tokens`` is the size of the mix; by default the greatest
    at which every source can still give its share within its cap, and where no source has a cap as
    many tokens as there are. Each source is planned by itself, from at most ``CELLS`` sums.
    """
    targets = mix.where("source is not null and weight > 0").groupBy("source").agg(
        F.max("weight").cast("double").alias("weight"), F.when(F.max(F.col("max_repeats").isNull()), F.lit(None)).otherwise(F.greatest(F.max("max_repeats"), F.lit(0))).cast("int").alias("cap")
    )
    cells = sized.groupBy("source", F.floor(F.col("u") * CELLS).cast("int").alias("cell")).agg(F.sum("n_tokens").alias("n"))
    by_source = cells.groupBy("source").agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").cast("double").alias("tokens"))
    rows = cut_lineage(targets.join(by_source, "source", "left"))
    usable = (F.col("tokens") > 0) & (F.col("cap").isNull() | (F.col("cap") > 0))
    most = F.when(usable, F.col("cap") * F.col("tokens") / F.col("weight"))
    whole = rows.agg(F.coalesce(F.sum(F.when(usable, F.col("weight"))), F.lit(1.0)).alias("weights"), F.min(most).alias("most"), F.coalesce(F.sum(F.when(usable, F.col("tokens"))), F.lit(0.0)).alias("all"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.col("most") * F.col("weights"), F.col("all"))
    sums = whole.select("weights", total.alias("total"))  # one row
    return cut_lineage(rows.join(F.broadcast(sums), how="inner").select("source", "weight", "cap", "cells", "weights", "total").mapInArrow(_solved, _PLAN))


def _drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source and u, and how often each is used; the plan has a row for each source of the mix and is counted before it is broadcast."""
    draws = plan.select("source", "thresholds")
    return rows.join(F.broadcast(draws) if plan.count() <= BROADCAST_SOURCES else draws, "source").withColumn("repeats", F.size(F.filter("thresholds", lambda t: t <= F.col("u")))).drop("thresholds")


def mix_shares(documents: DataFrame, mix: DataFrame, total_tokens: float | None = None, vocabulary: str = DEFAULT_VOCABULARY, seed: int = SEED) -> DataFrame:
    """What the mix reaches, one row for each source of the mix.

    (source, weight_share, max_repeats, documents, available_tokens, used_documents, drawn_tokens,
    share, most_repeats). Sources without documents have a weight share and a share of 0. Documents
    with a null source, a source outside the mix, or no tokens are not used.
    """
    sized = _measured(documents, vocabulary, seed)
    plan = plan_mix(sized, mix, total_tokens)
    by_source = _drawn(sized, plan).groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.when(F.col("repeats") > 0, 1).otherwise(0)).alias("used_documents"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    whole = by_source.agg(F.sum("drawn_tokens").alias("whole"))
    zero = F.lit(0).cast("bigint")
    return plan.join(by_source, "source", "left").join(F.broadcast(whole), how="inner").select(
        "source",
        F.col("weight").alias("weight_share"),
        "max_repeats",
        F.coalesce("documents", zero).alias("documents"),
        F.col("available").alias("available_tokens"),
        F.coalesce("used_documents", zero).alias("used_documents"),
        F.coalesce("drawn_tokens", zero).alias("drawn_tokens"),
        F.coalesce(F.col("drawn_tokens") / F.col("whole"), F.lit(0.0)).alias("share"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def mix_documents(documents: DataFrame, mix: DataFrame, total_tokens: float | None = None, vocabulary: str = DEFAULT_VOCABULARY, seed: int = SEED) -> DataFrame:
    """The mix itself, in a global random order: (doc_id, source, copy, text).

    A document comes ``copy`` = 0, 1, ... up to one less than its number of uses. The order is that of
    a hash of id, copy and seed, by range partitions sorted within; documents are only joined with the
    row of their source, and the draw depends on the id alone, so the text moves once.
    """
    plan = plan_mix(_measured(documents, vocabulary, seed), mix, total_tokens)
    rows = documents.select("doc_id", "source", "text").where("text is not null and text <> ''").withColumn("u", hashed_unit(F.col("doc_id"), seed))
    copies = _drawn(rows, plan).where("repeats > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy"), "text")
    order = F.xxhash64("doc_id", "copy", F.lit(seed))
    return copies.withColumn("skerry_order", order).repartitionByRange(shuffle_partitions(documents.sparkSession), "skerry_order").sortWithinPartitions("skerry_order").drop("skerry_order")
