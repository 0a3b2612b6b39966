"""What callers of an index hold on to: selectors of symbols, batches of queries, records of feedback."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.runtime import numbered_files, write_once

# selectors


class StaleSelector(ValueError):
    """A selector of another generation, or of a symbol that is no longer what it was."""


def _fingerprint() -> Column:
    """What a symbol is, apart from its id: path, kind, container, name and place."""
    told = F.to_json(F.struct("path", "kind", "container_qualified_name", "name", "line"), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(told, 256), 1, 16)


def selectors(symbols: DataFrame, files: DataFrame, generation: int) -> DataFrame:
    """(symbol_id, selector): texts that name a symbol of one generation of the index for certain, ``id:<id>@<generation>:<fingerprint>``."""
    rows = symbols.select("symbol_id", "file_id", "kind", "container_qualified_name", "name", "line").join(files.select("file_id", "path"), "file_id")
    return rows.select("symbol_id", F.concat(F.lit("id:"), F.col("symbol_id").cast("string"), F.lit(f"@{generation}:"), _fingerprint()).alias("selector"))


def selected(symbols: DataFrame, files: DataFrame, selector: str, generation: int) -> DataFrame:
    """The symbol that a selector names; ``StaleSelector`` if the index has moved on."""
    head, _, rest = selector.removeprefix("id:").partition("@")
    made, _, fingerprint = rest.partition(":")
    if not (selector.startswith("id:") and head.isdigit() and made.isdigit() and fingerprint):
        raise ValueError(f"no selector: {selector}")
    if int(made) != generation:
        raise StaleSelector(f"made for generation {made}, not {generation}")
    found = symbols.where(F.col("symbol_id") == int(head)).join(files.select("file_id", "path"), "file_id").where(_fingerprint() == fingerprint)
    if found.isEmpty():
        raise StaleSelector("the symbol has changed")
    return found


# batches


def batch(queries: Sequence[tuple[str, DataFrame]], most_rows: int | None = None) -> DataFrame:
    """(ordinal, query, row) of several read-only queries in one answer, rows as JSON, ``most_rows`` of each at most if given."""
    parts = []
    for k, (name, df) in enumerate(queries):
        rows = df if most_rows is None else df.orderBy(*df.columns).limit(most_rows)
        parts.append(rows.select(F.lit(k).alias("ordinal"), F.lit(name).alias("query"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# feedback

KINDS = ("missing_result", "wrong_result", "ranking", "other")


def suggest(spark: SparkSession, folder: str, record: dict) -> int:
    """Adds a record of feedback to a folder, one file each, and gives its number; nothing is ever overwritten."""
    if record.get("kind") not in KINDS or not str(record.get("text") or "").strip():
        raise ValueError("a record has a known kind and a text")
    while True:
        number = max(numbered_files(spark, folder), default=0) + 1
        try:
            write_once(spark, f"{folder.rstrip('/')}/{number:08d}.json", json.dumps(record, sort_keys=True))
            return number
        except FileExistsError:
            continue


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """(number, kind, text, query) of all records, in the order they came."""
    rows = [(n, r.get("kind"), r.get("text"), r.get("query")) for n, t in sorted(numbered_files(spark, folder).items()) for r in (json.loads(t),)]
    return spark.createDataFrame(rows, "number bigint, kind string, text string, query string")
