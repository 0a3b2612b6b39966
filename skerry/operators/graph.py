"""References and the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.predicates import ascii_lower, kind_predicate, logical_kind, weight
from skerry.runtime import cut_lineage
from skerry.schema import CALLER_WEIGHTS, IMPACT_KINDS, TOP_LEVEL

_SITE = ["file_id", "symbol_name", "line", "column_number"]


def reference_sites(refs: DataFrame, *columns: str) -> DataFrame:
    """References with one row for each site and logical kind: of several the least ref_id, with the named columns of its row."""
    kind = logical_kind(F.col("reference_kind"))
    rest = ["ref_id", *columns]
    rows = refs.groupBy(*_SITE, kind.alias("logical_kind")).agg(F.min(F.struct("ref_id", *(c for c in rest if c != "ref_id"))).alias("row"))
    return rows.select(*_SITE, "logical_kind", *(F.col(f"row.{c}").alias(c) for c in rest))


def references(refs: DataFrame, files: DataFrame, name: str, kind: str | None = None, lang: str | None = None) -> DataFrame:
    rows = refs.where(ascii_lower(F.col("symbol_name")) == name.lower())
    if kind is not None:
        rows = rows.where(kind_predicate(F.col("reference_kind"), kind))
    found = rows.join(files.select("file_id", "path", "lang"), "file_id")
    if lang is not None:
        found = found.where(F.col("lang") == lang)
    return found.select("path", "lang", "line", "column_number", "reference_kind", "container_name", "ref_id")


def preferred_kind(kinds: Column) -> Column:
    """Of mixed kinds the one to show."""
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("instantiate"), "instantiate").when(has("subscribe"), "subscribe").when(has("call"), "call").otherwise(F.array_min(kinds))


def _grouped(sites: DataFrame, keys: list[str]) -> DataFrame:
    first = F.min(F.struct("line", "column_number", "span_length")).alias("first")
    per_kind = sites.groupBy(*keys, "logical_kind").agg(
        F.count("*").alias("n"), F.sum(weight(F.col("logical_kind"), CALLER_WEIGHTS)).alias("tenths"), first,
        F.max(F.coalesce("is_self_reference", F.lit(False))).alias("self"), F.max(F.coalesce("is_mutual_recursion", F.lit(False))).alias("mutual"),
    )
    kinds = F.sort_array(F.collect_list("logical_kind")).alias("kinds")  # as many as there are kinds
    whole = per_kind.groupBy(*keys).agg(
        F.sum("n").alias("reference_count"), F.sum("tenths").alias("tenths"), F.min("first").alias("first"), kinds,
        F.sort_array(F.collect_list(F.concat_ws(":", "logical_kind", F.col("n").cast("string")))).alias("counts"), F.max("self").alias("is_self"), F.max("mutual").alias("is_mutual"),
    )
    return whole.select(
        *keys, "reference_count", (F.col("tenths") / 10).alias("weighted_score"), preferred_kind(F.col("kinds")).alias("reference_kind"), F.array_join("counts", ",").alias("kind_counts"),
        F.col("first.line").alias("first_line"), F.col("first.column_number").alias("first_column"), "is_self", "is_mutual",
    )


def call_sites(refs: DataFrame, kind: str | None = None) -> DataFrame:
    named = refs.where("symbol_name is not null").where(kind_predicate(F.col("reference_kind"), kind))
    return reference_sites(named, "container_kind", "container_name", "span_length", "is_self_reference", "is_mutual_recursion")


def callers(refs: DataFrame, files: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Who calls a symbol: sites by file, container and symbol, with counts, kinds, score and first place.

    A reference outside of any container belongs to a synthetic top-level caller. Without a name the
    callers of all symbols.
    """
    rows = refs if name is None else refs.where(ascii_lower(F.col("symbol_name")) == name.lower())
    sites = call_sites(rows, kind).withColumn("caller_kind", F.coalesce("container_kind", F.lit("function"))).withColumn("caller", F.coalesce("container_name", F.lit(TOP_LEVEL)))
    return _grouped(sites, ["file_id", "caller_kind", "caller", "symbol_name"]).join(files.select("file_id", "path", "lang"), "file_id").drop("file_id")


def callees(refs: DataFrame, files: DataFrame, container: str | None = None, kind: str | None = None) -> DataFrame:
    """What a container calls, by symbol and kind."""
    rows = refs.where("container_name is not null")
    if container is not None:
        rows = rows.where(ascii_lower(F.col("container_name")) == container.lower())
    sites = call_sites(rows, kind).withColumn("callee_kind", F.col("logical_kind"))
    return _grouped(sites, ["file_id", "container_kind", "container_name", "symbol_name", "callee_kind"]).join(files.select("file_id", "path", "lang"), "file_id").drop("file_id")


def ranked(rows: DataFrame, mode: str, limit: int, keys: list[str]) -> DataFrame:
    order = {"weighted": [F.desc("weighted_score"), F.desc("reference_count")], "count": [F.desc("reference_count")], "kind": [F.when(F.col("reference_kind") == "instantiate", 0).when(F.col("reference_kind") == "call", 1).when(F.col("reference_kind") == "generic_type_argument", 2).when(F.col("reference_kind") == "subscribe", 3).otherwise(4)]}[mode]
    return rows.orderBy(*order, *keys).limit(limit)


# resolution


def source_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, source_symbol_id): the innermost symbol that has the reference's container name and covers its line."""
    spans = symbols.where("start_line is not null and end_line is not null").select("file_id", F.col("name").alias("container_name"), "symbol_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    found = refs.where("container_name is not null").select("ref_id", "file_id", "container_name", "line").join(spans, ["file_id", "container_name"]).where("line between s and e")
    return found.groupBy("ref_id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), "symbol_id")).alias("best")).select("ref_id", F.col("best.symbol_id").alias("source_symbol_id"))


def definition_names(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, name_folded, definitions, files, least_id, family): what is known of each name."""
    rows = symbols.join(files.select("file_id", "lang"), "file_id").where("name_folded is not null")
    key = F.coalesce("family_key", F.concat(F.lit("sym:"), F.col("symbol_id").cast("string")))
    return rows.groupBy("lang", "name_folded").agg(
        F.count("*").alias("definitions"), F.countDistinct("file_id").alias("files"), F.min("symbol_id").alias("least_id"), F.min(key).alias("lo"), F.max(key).alias("hi")
    )


def unique_families(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, name_folded, family) of names all of whose definitions are of one family."""
    return definition_names(symbols, files).where("lo = hi").select("lang", "name_folded", F.col("lo").alias("family"))


def candidate_summary(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, scope_rank, candidate_count, target_symbol_id, state) of each named reference.

    Definitions of the same folded name and language are candidates: those in the same container of the
    same file (rank 1), then in the same file (2), in the same directory (3), anywhere (4); the best rank
    that has one decides. Names are summed up by container, file, directory and language before
    references meet them, so a name with many definitions and many references never pairs them.
    """
    where = files.select("file_id", "lang", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))").alias("dir"))
    defs = symbols.where("name_folded is not null").select("file_id", "symbol_id", "name_folded", ascii_lower(F.col("container_name")).alias("container")).join(where, "file_id")
    rows = refs.where("symbol_name_folded is not null").select("ref_id", "file_id", F.col("symbol_name_folded").alias("name_folded"), ascii_lower(F.col("container_name_folded")).alias("container")).join(where, "file_id")
    # a name that holds a third of all references meets one row of each sum
    scopes = (["file_id", "container", "lang", "name_folded"], ["file_id", "lang", "name_folded"], ["dir", "lang", "name_folded"], ["lang", "name_folded"])
    for k, keys in enumerate(scopes):
        sums = defs.groupBy(*keys).agg(F.count("*").alias(f"n_{k}"), F.min("symbol_id").alias(f"id_{k}"))
        rows = rows.join(sums, keys, "left")
    found = lambda name: [F.col(f"{name}_{k}") for k in range(len(scopes))]
    n = F.coalesce(*found("n"), F.lit(0).cast("bigint"))
    rank = F.coalesce(*(F.when(c.isNotNull(), k + 1) for k, c in enumerate(found("n"))))
    return rows.select(
        "ref_id", rank.alias("scope_rank"), n.alias("candidate_count"), F.when(n == 1, F.coalesce(*found("id"))).alias("target_symbol_id"),
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("state"),
    )


def self_references(refs: DataFrame) -> DataFrame:
    """(ref_id, is_self): the reference is to its own container."""
    ids = F.col("source_symbol_id") == F.col("target_symbol_id")
    names = F.col("symbol_name_folded") == F.col("container_name_folded")
    return refs.select("ref_id", F.coalesce(ids, names, F.lit(False)).alias("is_self"))


def mutual_recursion(refs: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of symbols each of which refers to the other, from resolved references."""
    edges = refs.where("source_symbol_id is not null and target_symbol_id is not null and source_symbol_id <> target_symbol_id").select(F.col("source_symbol_id").alias("s"), F.col("target_symbol_id").alias("t")).distinct()
    both = edges.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").select("a", "b")


# traversal


def call_edges(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, callee, caller): distinct edges between folded names, of the kinds that carry impact."""
    rows = refs.where(F.col("reference_kind").isin(*IMPACT_KINDS) & F.col("symbol_name_folded").isNotNull() & F.col("container_name_folded").isNotNull())
    return rows.join(files.select("file_id", "lang"), "file_id").where("lang is not null").select("lang", F.col("symbol_name_folded").alias("callee"), F.col("container_name_folded").alias("caller")).distinct()


def impact(refs: DataFrame, files: DataFrame, root: str, lang: str, max_depth: int = 5, max_rows: int | None = None) -> tuple[DataFrame, str]:
    """Transitive callers of a name, breadth first: (caller, depth), and why the walk ended.

    Each level joins the frontier with the edges and leaves out what has been seen; levels are written
    to the checkpoint folder. The root is never its own caller. It ends at an empty frontier
    (exhausted), after ``max_depth`` levels (depth) or beyond ``max_rows`` (budget).
    """
    edges = cut_lineage(call_edges(refs, files).where(F.col("lang") == lang).select("callee", "caller"))
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(root.lower(), 0)], "caller string, depth int")
    why, total = "depth", 1
    for depth in range(1, max_depth + 1):
        found = edges.join(frontier.select(F.col("caller").alias("callee")), "callee", "left_semi").select("caller").distinct()
        frontier = cut_lineage(found.join(seen, "caller", "left_anti").withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            why = "exhausted"
            break
        seen, total = seen.unionByName(frontier), total + size  # each part is written already
        if max_rows is not None and total > max_rows:
            why = "budget"
            break
    return seen.where("depth > 0"), why


def impact_paths(refs: DataFrame, files: DataFrame, root: str, lang: str, max_depth: int = 3, most: int = 10) -> DataFrame:
    """(caller, depth, path) of shortest call paths to the root, at most ``most`` for each caller.

    Only edges from one level to the next carry paths; of the paths to a caller the first ones in
    order are kept before the next level, which is all that the result can show.
    """
    levels, _ = impact(refs, files, root, lang, max_depth)
    levels = cut_lineage(levels)
    edges = call_edges(refs, files).where(F.col("lang") == lang).select("callee", "caller")
    at = edges.sparkSession.createDataFrame([(root.lower(), [root.lower()])], "node string, path array<string>")
    out = None
    for depth in range(1, max_depth + 1):
        here = levels.where(F.col("depth") == depth).select("caller")
        step = edges.join(at, edges.callee == at.node).join(here, "caller", "left_semi").where(~F.array_contains("path", F.col("caller")))
        kept = step.select("caller", F.concat("path", F.array("caller")).alias("path")).groupBy("caller").agg(F.slice(F.sort_array(F.collect_set("path")), 1, most).alias("paths"))
        at = cut_lineage(kept.select(F.col("caller").alias("node"), F.explode("paths").alias("path")))
        rows = at.select(F.col("node").alias("caller"), F.lit(depth).alias("depth"), F.array_join("path", " <- ").alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def call_hierarchy(refs: DataFrame, symbol_id: int, incoming: bool = True) -> DataFrame:
    mine, other = ("target_symbol_id", "source_symbol_id") if incoming else ("source_symbol_id", "target_symbol_id")
    rows = refs.where((F.col(mine) == symbol_id) & F.col(other).isNotNull())
    return rows.groupBy(F.col(other).alias("symbol_id")).agg(F.count("*").alias("sites"), F.min("line").alias("first_line"))
