"""Queries p1, p2 and p5: the general data-pipeline operators on the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.copy_diff import HEADER_FIELDS, SYMBOL_FIELDS, diff_index_copies
from skerry.operators.dense_counts import count_mismatches, site_and_stored_counts
from skerry.operators.incremental import new_or_changed
from skerry.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return count_mismatches(table(spark, root, "refs"), table(spark, root, "hotspot_reference_counts"))


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return site_and_stored_counts(table(spark, root, "refs"), table(spark, root, "hotspot_reference_counts"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return new_or_changed(table(spark, root, "files"), table(spark, root, "file_scan"), table(spark, root, "index_runs"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return diff_index_copies(table(spark, root, "symbols"), table(spark, root, "symbols_right"), table(spark, root, "diff_headers"))


def p5_summary(spark: SparkSession, root: str) -> DataFrame:
    """How many keys differ in what, by area."""
    return p5_found(spark, root).groupBy("area", "diff").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p5_found": p5_found, "p5_summary": p5_summary}

_P1 = """
with stored as (
  select symbol_name, coalesce(sum(reference_count), 0) as stored from (
    select distinct file_id, lang, raw_symbol_name, symbol_name, symbol_segment_count, allow_leaf_fallback, reference_count, reference_score
    from hotspot_reference_counts where symbol_name is not null) group by symbol_name),
sites as (
  select symbol_name, count(*) as sites from (
    select distinct file_id, symbol_name, line, column_number from refs where symbol_name is not null) group by symbol_name),
both_counts as (
  select coalesce(a.symbol_name, b.symbol_name) as symbol_name, cast(coalesce(sites, 0) as bigint) as sites, cast(coalesce(stored, 0) as bigint) as stored
  from sites a full join stored b on a.symbol_name = b.symbol_name)
"""


def _one_side(left: str, right: str, area: str, key: str) -> list[str]:
    return [
        f"select distinct '{area}' as area, cast(l.{key} as varchar) as row_key, 'only_left' as diff from {left} l where not exists (select 1 from {right} r where r.{key} is not distinct from l.{key})",
        f"select distinct '{area}', cast(r.{key} as varchar), 'only_right' from {right} r where not exists (select 1 from {left} l where r.{key} is not distinct from l.{key})",
    ]


def _fields(left: str, right: str, area: str, key: str, fields: tuple[str, ...]) -> list[str]:
    return [
        f"select distinct '{area}', cast(l.{key} as varchar), '{c}' from {left} l join {right} r on r.{key} is not distinct from l.{key} where l.{c} is distinct from r.{c}"
        for c in fields
    ]


_P5 = " union all ".join(
    _one_side("symbols", "symbols_right", "symbols", "symbol_id")
    + _fields("symbols", "symbols_right", "symbols", "symbol_id", SYMBOL_FIELDS)
    + _one_side("hl", "hr", "header", "db_name")
    + _fields("hl", "hr", "header", "db_name", HEADER_FIELDS)
)
_HEADS = "with hl as (select * from diff_headers where lower(side) = 'left'), hr as (select * from diff_headers where lower(side) = 'right') "

SQL = {
    "p1_found": _P1 + "select symbol_name from both_counts where sites <> stored",
    "p1_counts": _P1 + "select symbol_name, sites, stored from both_counts",
    "p2_found": """
with owned as (
  select started_at as lo, lead(started_at) over (order by started_at, run_id) as hi, lower(status) as status from index_runs where started_at is not null),
kept as (
  select f.path, lower(f.checksum) as checksum, f.indexed_at as t from files f join owned o
  on f.indexed_at >= o.lo and (o.hi is null or f.indexed_at < o.hi) where o.status = 'ok'),
then_ as (select path, checksum from (select *, row_number() over (partition by path order by t desc, checksum desc nulls last) as k from kept) where k = 1),
now_ as (select path, checksum from (select path, lower(checksum) as checksum, row_number() over (partition by path order by scanned_at desc nulls last, lower(checksum) desc) as k
  from file_scan where checksum is not null) where k = 1)
select n.path from now_ n left join then_ t on t.path = n.path where n.path is not null and n.checksum is distinct from t.checksum""",
    "p5_found": _HEADS + _P5,
    "p5_summary": _HEADS + f"select area, diff, count(*) as n from ({_P5}) group by area, diff",
}
