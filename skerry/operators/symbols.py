"""Symbol lookup, ranking and outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.graph import definition_names, reference_sites
from skerry.operators.lines import lines_at
from skerry.operators.predicates import any_of, ascii_lower, name_matches, path_bucket, visibility_rank, weight
from skerry.schema import HOTSPOT_WEIGHTS

#: Kinds that hold other symbols and rank behind what they hold.
STRUCTURAL_KINDS = ("namespace", "import", "package", "module", "heading")


def matching(symbols: DataFrame, files: DataFrame, queries: Sequence[str], mode: str = "substring", kinds: Sequence[str] = (), lang: str | None = None) -> DataFrame:
    rows = symbols.where(any_of([name_matches(F.col("name"), q, mode) for q in queries]))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    found = rows.join(files.select("file_id", "path", "lang"), "file_id")
    return found if lang is None else found.where(F.col("lang") == lang)


def name_signals(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, name_folded, sites, tenths, definitions): how often a name is used and defined in a language."""
    sites = reference_sites(refs.where("symbol_name_folded is not null"), "symbol_name_folded").join(files.select("file_id", "lang"), "file_id")
    used = sites.groupBy("lang", F.col("symbol_name_folded").alias("name_folded")).agg(F.count("*").alias("sites"), F.sum(weight(F.col("logical_kind"), HOTSPOT_WEIGHTS)).alias("tenths"))
    return definition_names(symbols, files).select("lang", "name_folded", "definitions").join(used, ["lang", "name_folded"], "left").na.fill(0, ["sites", "tenths"])


def ranked_symbols(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with what ranks them: (symbol_id, path, name, kind, sites, hotness, complexity).

    Uses of a name that has several definitions are diluted by the square of their number; structural
    kinds count a tenth; complexity adds size, uses, hotness and visibility.
    """
    signals = name_signals(symbols, refs, files)
    rows = symbols.join(files.select("file_id", "path", "lang"), "file_id").join(signals, ["lang", "name_folded"], "left")
    sites = F.coalesce("sites", F.lit(0))
    dilution = F.when(F.col("definitions") > 1, F.col("definitions") * F.col("definitions")).otherwise(F.lit(1))
    hotness = F.coalesce(F.col("tenths"), F.lit(0)) / 10.0 / dilution * F.when(F.col("kind").isin(*STRUCTURAL_KINDS), 0.1).otherwise(1.0)
    size = F.greatest(F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1)), F.lit(1))
    rank = visibility_rank(F.col("visibility"))
    seen = F.when(rank == 0, 8.0).when(rank == 1, 4.0).otherwise(0.0)
    complexity = size * 16.0 + F.least(sites, F.lit(100)) * 0.75 + F.least(hotness, F.lit(150.0)) * 0.35 + seen
    return rows.select("symbol_id", "path", "name", "kind", "line", sites.cast("bigint").alias("sites"), F.round(hotness, 6).alias("hotness"), F.round(complexity, 6).alias("complexity"))


def sort_symbols(rows: DataFrame, mode: str, limit: int) -> DataFrame:
    order = {
        "hotspot": [F.desc("hotness")], "references": [F.desc("sites")], "size": [F.desc("complexity")], "complexity": [F.desc("complexity")], "path": ["path"], "name": [ascii_lower(F.col("name"))],
    }[mode]
    return rows.orderBy(*order, "path", "line", "symbol_id").limit(limit)


def exact_name_order(name: Column, query: str) -> Column:
    """0 same, 1 same but for case, 2 begins with, 3 begins with but for case, 4 holds, 5 else."""
    low, q = ascii_lower(name), query.lower()
    return F.when(name == query, 0).when(low == q, 1).when(name.startswith(query), 2).when(low.startswith(q), 3).when(F.contains(low, F.lit(q)), 4).otherwise(5)


def partial_families(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each family of declarations: its first member by path and line, and how many there are."""
    rows = symbols.where("family_key is not null").join(files.select("file_id", "path", "lang"), "file_id")
    return rows.groupBy("lang", "family_key").agg(F.min(F.struct("path", "line", "symbol_id")).alias("first"), F.count("*").alias("members"), F.countDistinct("path").alias("files")).select(
        "lang", "family_key", "members", "files", F.col("first.path").alias("path"), F.col("first.symbol_id").alias("symbol_id")
    )


def definitions(symbols: DataFrame, files: DataFrame, chunks: DataFrame, name: str, body_lines: int = 20) -> DataFrame:
    """Definitions of a name with up to ``body_lines`` lines of their text."""
    found = symbols.where(ascii_lower(F.col("name")) == name.lower()).where("start_line is not null")
    wanted = found.select("symbol_id", "file_id", F.explode(F.sequence(F.col("start_line"), F.least(F.coalesce("end_line", "start_line"), F.col("start_line") + body_lines - 1))).alias("line"))
    text = wanted.join(lines_at(chunks, wanted), ["file_id", "line"]).groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"))
    body = text.select("symbol_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("body"))
    return found.join(files.select("file_id", "path"), "file_id").join(body, "symbol_id", "left").select("path", "symbol_id", "name", "kind", "start_line", "end_line", "body")


def goto(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The best definition of a name: exact case first, then production code, visibility, path and line."""
    found = symbols.where(ascii_lower(F.col("name")) == name.lower()).join(files.select("file_id", "path"), "file_id")
    return found.orderBy(exact_name_order(F.col("name"), name), path_bucket(F.col("path")), visibility_rank(F.col("visibility")), "path", "line", "symbol_id").select("path", "symbol_id", "name", "kind", "line").limit(1)


def outlines(symbols: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """All symbols of each file in order, with their container path and, where the name has one definition, its uses."""
    signals = name_signals(symbols, refs, files).where("definitions = 1").select("lang", "name_folded", "sites")
    rows = symbols.join(files.select("file_id", "path", "lang"), "file_id").join(signals, ["lang", "name_folded"], "left")
    display = F.concat_ws(".", F.coalesce("container_qualified_name", "container_name"), "name")
    w = Window.partitionBy("file_id").orderBy(F.coalesce("start_line", "line"), "start_column", "symbol_id")
    return rows.select("path", F.row_number().over(w).alias("position"), "symbol_id", display.alias("display_name"), "kind", "line", F.col("sites").alias("uses"))


def nearby(symbols: DataFrame, file_id: int, line: int, limit: int) -> DataFrame:
    """Symbols around a line: those that cover it first, then by distance."""
    inside = F.lit(line).between(F.col("start_line"), F.col("end_line"))
    distance = F.when(inside, 0).otherwise(F.least(F.abs(F.coalesce("start_line", "line") - line), F.abs(F.coalesce("end_line", "line") - line)))
    rows = symbols.where(F.col("file_id") == file_id).select("symbol_id", "name", "kind", F.when(inside, 0).otherwise(1).alias("outside"), distance.alias("distance"))
    return rows.orderBy("outside", "distance", "symbol_id").limit(limit)


def inspect(symbols: DataFrame, files: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """(aspect, path, line, detail): a symbol's definitions, references, callers and callees in one list."""
    low = name.lower()
    where = files.select("file_id", "path")
    defs = symbols.where(F.col("name_folded") == low).select("file_id", F.lit("definition").alias("aspect"), "line", F.col("kind").alias("detail"))
    uses = refs.where(F.col("symbol_name_folded") == low)
    ours = refs.where(F.col("container_name_folded") == low)
    parts = [
        defs,
        uses.select("file_id", F.lit("reference").alias("aspect"), "line", F.col("reference_kind").alias("detail")),
        uses.where("container_name is not null").select("file_id", F.lit("caller").alias("aspect"), "line", F.col("container_name").alias("detail")),
        ours.where("symbol_name is not null").select("file_id", F.lit("callee").alias("aspect"), "line", F.col("symbol_name").alias("detail")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(where, "file_id").groupBy("aspect", "path", "line", "detail").agg(F.count("*").alias("n"))
