"""File dependencies, cycles, hotspots, unused symbols and maps of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.graph import call_edges, definition_names, impact, reference_sites
from skerry.operators.predicates import ascii_lower, is_noise, logical_kind, weight
from skerry.runtime import cut_lineage, measured_side
from skerry.schema import HOTSPOT_WEIGHTS

#: Names that say little as hotspots.
GENERIC_NAMES = (
    "add", "append", "build", "call", "combine", "convert", "create", "execute", "get", "getstring", "getvalue", "getvalues", "handle", "invoke", "load", "parse", "process",
    "read", "resolve", "run", "set", "start", "stop", "tolist", "tostring", "tryparse", "update", "write",
)
#: A name that more files than this define in a language is ambiguous: counts and ranks are then taken from its two sides, not from pairs of files. Results don't depend on it.
AMBIGUOUS_FROM = 8
_CLASS_KINDS = ("class", "struct", "interface", "enum", "record")


def name_uses(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, lang, name_folded, symbol, sites): uses of each name by file, counted before any join."""
    sites = reference_sites(refs.where("symbol_name_folded is not null"), "symbol_name_folded")
    uses = sites.groupBy(F.col("file_id").alias("src"), F.col("symbol_name_folded").alias("name_folded")).agg(F.count("*").alias("sites"), F.min("symbol_name").alias("symbol"))
    return uses.join(files.select(F.col("file_id").alias("src"), "lang"), "src").where("lang is not null")


def definitions_by_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(dst, lang, name_folded): each file that defines a name, however many define it."""
    return symbols.where("name_folded is not null").join(files.select("file_id", "lang"), "file_id").where("lang is not null").select(F.col("file_id").alias("dst"), "lang", "name_folded").distinct()


def _few_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    few = definition_names(symbols, files).where(F.col("files") <= AMBIGUOUS_FROM).select("lang", "name_folded")
    return definitions_by_file(symbols, files).join(few, ["lang", "name_folded"], "left_semi")


def ambiguous_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, name_folded, files): the names that many files define."""
    return definition_names(symbols, files).where((F.col("files") > AMBIGUOUS_FROM) & F.col("lang").isNotNull()).select("lang", "name_folded", "files")


def ambiguous_sides(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, name_folded, side, path, sites) of these names: each file that uses one and each that defines it.

    Every use depends on every definition of the same name and language, so the two sides are the exact
    edges in compact form; only the pairs aren't written out.
    """
    names = ambiguous_targets(symbols, files).select("lang", "name_folded")
    where = files.select("file_id", "path")
    uses = name_uses(refs, files).join(names, ["lang", "name_folded"], "left_semi").join(where, F.col("src") == F.col("file_id"))
    defs = symbols.where("name_folded is not null").join(files.select("file_id", "lang", "path"), "file_id").join(names, ["lang", "name_folded"], "left_semi")
    return uses.groupBy("lang", "name_folded", F.lit("use").alias("side"), "path").agg(F.sum("sites").alias("sites")).unionByName(
        defs.select("lang", "name_folded", F.lit("definition").alias("side"), "path", F.lit(0).cast("bigint").alias("sites")).distinct()
    )


def file_dependencies(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, dst_path, reference_count, symbol_count, symbols): which file uses names that another defines.

    Uses are summed by file and name, and definitions by name and file, before they meet, so no edge is
    made twice for a name. The edges are the result, by common names too; who wants counts or ranks of
    them finds these without pairs in ``dependent_counts`` and ``ranked_dependencies``, and both sides
    of common names in ``ambiguous_sides``. ``symbols`` are the first 32 names.
    """
    edges = name_uses(refs, files).join(definitions_by_file(symbols, files), ["lang", "name_folded"]).where("src <> dst")
    totals = edges.groupBy("src", "dst").agg(F.sum("sites").alias("reference_count"), F.count("*").alias("symbol_count"), F.slice(F.sort_array(F.collect_set("symbol")), 1, 32).alias("symbols"))
    a = files.select(F.col("file_id").alias("src"), F.col("path").alias("src_path"))
    b = files.select(F.col("file_id").alias("dst"), F.col("path").alias("dst_path"))
    return totals.join(a, "src").join(b, "dst").select("src_path", "dst_path", "reference_count", "symbol_count", F.array_join("symbols", ",").alias("symbols"))


def dependency_evidence(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind, state, n) from resolved references only: exact identities, no names."""
    rows = refs.where("target_symbol_id is not null").select("file_id", "target_symbol_id", "reference_kind", "resolution_state")
    defs = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("file_id").alias("dst"))
    # many references to one symbol are summed first
    summed = rows.groupBy(F.col("file_id").alias("src"), "target_symbol_id", "reference_kind", "resolution_state").agg(F.count("*").alias("n"))
    edges = summed.join(defs, "target_symbol_id").where("src <> dst")
    return edges.groupBy("src", "dst", F.col("reference_kind").alias("kind"), F.col("resolution_state").alias("state")).agg(F.sum("n").alias("n"))


def dependencies_by_name(refs: DataFrame, symbols: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """(src, dst, n) of all edges by names that begin with ``prefix``; the pairs are the result, so all are written out."""
    uses = name_uses(refs, files).where(F.col("name_folded").startswith(prefix))
    defs = definitions_by_file(symbols, files).where(F.col("name_folded").startswith(prefix))
    return uses.join(defs, ["lang", "name_folded"]).where("src <> dst").groupBy("src", "dst").agg(F.sum("sites").alias("n"))


def _name_sets(symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dst, set_id) of each file that defines ambiguous names, and (set_id, lang, name_folded) of each different set of them."""
    hot = definitions_by_file(symbols, files).join(ambiguous_targets(symbols, files).select("lang", "name_folded"), ["lang", "name_folded"], "left_semi")
    by_file = hot.groupBy("dst", "lang").agg(F.sort_array(F.collect_set("name_folded")).alias("names"))
    by_file = cut_lineage(by_file.withColumn("set_id", F.sha2(F.to_json(F.struct("lang", "names")), 256)))
    sets = by_file.select("set_id", "lang", "names").distinct().select("set_id", "lang", F.explode("names").alias("name_folded"))
    return by_file.select("dst", "set_id"), sets


def dependent_counts(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(dst, dependents): how many other files use a name that a file defines, ambiguous names included.

    Files that define the same set of ambiguous names share its users, which are found once for each
    set; only pairs by other names are written out, and those that a set has already are left out.
    """
    uses = cut_lineage(name_uses(refs, files).select("src", "lang", "name_folded"))
    member, sets = _name_sets(symbols, files)
    shared = cut_lineage(uses.join(sets, ["lang", "name_folded"]).select("set_id", "src").distinct())
    few = uses.join(_few_targets(symbols, files), ["lang", "name_folded"]).where("src <> dst").select("src", "dst").distinct()
    few = few.join(member, "dst", "left").join(shared, ["set_id", "src"], "left_anti").groupBy("dst").agg(F.count("*").alias("n"))
    users = member.join(shared.groupBy("set_id").agg(F.count("*").alias("n")), "set_id").select("dst", "n")
    itself = member.withColumn("src", F.col("dst")).join(shared, ["set_id", "src"], "left_semi").select("dst", F.lit(-1).cast("bigint").alias("n"))
    return few.unionByName(users).unionByName(itself).groupBy("dst").agg(F.sum("n").alias("dependents")).where("dependents > 0")


def ranked_dependencies(refs: DataFrame, symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Edges by a score that counts noise names a tenth: sum of sites times mean penalty.

    What ambiguous names give an edge depends on the user and the name set of the defining file, so it
    is summed by these. Edges that have other names too are scored one by one; of the rest, which
    score alike within a user and a set, only those of the best ``limit`` users and sets are written out.
    """
    uses = cut_lineage(name_uses(refs, files).withColumn("tenths", F.when(is_noise(F.col("symbol")), 1).otherwise(10).cast("bigint")))
    total = (F.sum("sites").alias("sites"), F.sum("tenths").alias("tenths"), F.count("*").alias("n"))
    member, sets = _name_sets(symbols, files)
    shared = cut_lineage(uses.join(sets, ["lang", "name_folded"]).groupBy("src", "set_id").agg(*total))
    few = cut_lineage(uses.join(_few_targets(symbols, files), ["lang", "name_folded"]).where("src <> dst").groupBy("src", "dst").agg(*total).join(member, "dst", "left"))
    more = shared.select("src", "set_id", F.col("sites").alias("sites_"), F.col("tenths").alias("tenths_"), F.col("n").alias("n_"))
    both = few.join(more, ["src", "set_id"], "left").select("src", "dst", *((F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("sites", "tenths", "n")))
    # pairs of a user and a set that are edges by ambiguous names alone
    size = member.groupBy("set_id").agg(F.count("*").alias("size"))
    taken = few.where("set_id is not null").select("src", "dst", "set_id").unionByName(member.select(F.col("dst").alias("src"), "dst", "set_id"))
    left = shared.join(size, "set_id").join(taken.groupBy("src", "set_id").agg(F.count("*").alias("gone")), ["src", "set_id"], "left").where("size > coalesce(gone, 0)")
    score = F.round(F.col("sites") * F.col("tenths") / (F.col("n") * 10), 4)
    bound = left.select(score.alias("score")).orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("bound"))
    best = left.withColumn("score", score).join(F.broadcast(bound), F.col("score") >= F.col("bound"))
    first = best.orderBy(F.desc("score"), "src").limit(limit).agg(F.min(F.struct("score", (-F.col("src")).alias("back"))).alias("last"))
    best = best.join(F.broadcast(first), F.struct("score", (-F.col("src")).alias("back")) >= F.col("last"))
    alone = best.select("src", "set_id", "sites", "score").join(member, "set_id").join(taken.select("src", "dst"), ["src", "dst"], "left_anti")
    scored = both.select("src", "dst", F.col("sites").alias("reference_count"), score.alias("score")).unionByName(alone.select("src", "dst", F.col("sites").alias("reference_count"), "score"))
    return scored.orderBy(F.desc("score"), "src", "dst").limit(limit)


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on cycles of ``edges`` (src, dst): strongly connected components.

    Nodes without a way in or out are peeled off until none is left. Then, round by round, each node
    takes the greatest label that reaches it forwards; the nodes that can reach their label's owner
    backwards, within the label, form its component, and the rest goes on. Every step is a join and an
    aggregation; rounds are written to the checkpoint folder, and there are as many as the longest chain
    of the graph needs. Nothing is collected but counts. A component is named by its greatest node.
    """
    rest = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = rest.where("src = dst").select("src").distinct()
    rest = cut_lineage(rest.where("src <> dst"))
    found = None

    while True:
        size = rest.count()
        while size:  # peel
            kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            rest = cut_lineage(kept)
            left = rest.count()
            if left == size:
                break
            size = left
        if not size:
            break
        label = cut_lineage(rest.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
        while True:  # the greatest label that reaches a node
            moved = rest.join(label, rest.src == label.node).groupBy("dst").agg(F.max("label").alias("new"))
            after = cut_lineage(label.join(moved, label.node == moved.dst, "left").select("node", F.greatest("label", F.coalesce("new", "label")).alias("label"), (F.col("new") > F.col("label")).alias("changed")))
            changed = after.where("changed").count()
            label = after.select("node", "label")
            if not changed:
                break
        inside = cut_lineage(
            rest.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("label"))
        )
        member = cut_lineage(label.where("node = label"))
        front = member
        while True:  # backwards from each owner, within its label
            back = inside.join(front.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            front = cut_lineage(back.join(member, ["node", "label"], "left_anti"))
            if not front.count():
                break
            member = cut_lineage(member.unionByName(front))
        found = member if found is None else cut_lineage(found.unionByName(member))
        rest = cut_lineage(rest.join(member.select(F.col("node").alias("src")), "src", "left_anti").join(member.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    sizes = None
    if found is not None:
        big = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        sizes = found.join(big, "label", "left_semi").select("node", F.col("label").alias("component"))
    alone = loops.select(F.col("src").alias("node"), F.col("src").alias("component"))
    if sizes is None:
        return alone
    return sizes.unionByName(alone.join(sizes.select("node"), "node", "left_anti"))


def ranked_cycles(edges: DataFrame, limit: int, after: int = 0) -> DataFrame:
    """(rank, component, nodes, edges) of cycles, those with most nodes and then most edges within first; a page of ``limit`` after rank ``after``."""
    on = cut_lineage(cycles(edges))
    pair = edges.select("src", "dst").distinct()
    inside = pair.join(on.select(F.col("node").alias("src"), "component"), "src").join(on.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    counts = on.groupBy("component").agg(F.count("*").alias("nodes")).join(inside.groupBy("component").agg(F.count("*").alias("edges")), "component")
    first = counts.orderBy(F.desc("nodes"), F.desc("edges"), "component").limit(after + limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nodes"), F.desc("edges"), "component"))).where(F.col("rank") > after)


def impact_cycles(refs: DataFrame, files: DataFrame, root: str, lang: str, max_depth: int = 5) -> DataFrame:
    """(node, component): the names on cycles among the root and its callers up to ``max_depth`` levels."""
    walked = impact(refs, files, root, lang, max_depth)[0].select(F.col("caller").alias("node"))
    nodes = cut_lineage(walked.unionByName(refs.sparkSession.createDataFrame([(root.lower(),)], "node string")).distinct())
    edges = call_edges(refs, files).where(F.col("lang") == lang).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return cycles(inside)


# hotspots


def hotspot_counts(refs: DataFrame, files: DataFrame) -> DataFrame:
    """The stored aggregate: (file_id, lang, symbol_name, reference_count, score) after sites are told apart."""
    sites = reference_sites(refs.where("symbol_name is not null"))
    name = F.substring_index("symbol_name", "#", 1)
    counts = sites.groupBy("file_id", name.alias("symbol_name")).agg(F.count("*").alias("reference_count"), F.sum(weight(F.col("logical_kind"), HOTSPOT_WEIGHTS)).alias("tenths"))
    return counts.join(files.select("file_id", "lang"), "file_id").select("file_id", "lang", "symbol_name", "reference_count", (F.col("tenths") / 10).alias("score"))


def generic_penalty(name: Column) -> Column:
    return F.when(F.lower(name).isin(*GENERIC_NAMES), 0.35).otherwise(1.0)


def symbol_hotspots(symbols: DataFrame, refs: DataFrame, files: DataFrame, limit: int, defined: DataFrame | None = None) -> DataFrame:
    """The most used symbols: a name that one definition has, among ``defined`` or the symbols themselves, takes all its uses, any other only those in its own file."""
    counts = hotspot_counts(refs, files).withColumn("folded", F.lower("symbol_name"))
    by_lang = counts.groupBy("lang", F.col("folded").alias("name_folded")).agg(F.sum("reference_count").alias("all_count"), F.sum("score").alias("all_score"))
    by_file = counts.groupBy("file_id", F.col("folded").alias("name_folded")).agg(F.sum("reference_count").alias("own_count"), F.sum("score").alias("own_score"))
    known = definition_names(symbols if defined is None else defined, files).select("lang", "name_folded", "definitions")
    rows = symbols.join(files.select("file_id", "path", "lang"), "file_id").join(known, ["lang", "name_folded"]).join(by_lang, ["lang", "name_folded"], "left").join(by_file, ["file_id", "name_folded"], "left")
    alone = F.col("definitions") == 1
    count = F.coalesce(F.when(alone, F.col("all_count")).otherwise(F.col("own_count")), F.lit(0).cast("bigint"))
    score = F.coalesce(F.when(alone, F.col("all_score")).otherwise(F.col("own_score")), F.lit(0.0))
    found = rows.select("path", "symbol_id", "name", "kind", count.alias("reference_count"), F.round(score * generic_penalty(F.col("name")), 4).alias("score"))
    return found.where("reference_count > 0").orderBy(F.desc("score"), F.desc("reference_count"), "path", "symbol_id").limit(limit)


def file_hotspots(refs: DataFrame, files: DataFrame) -> DataFrame:
    return hotspot_counts(refs, files).groupBy("file_id").agg(F.sum("reference_count").alias("reference_count"), F.round(F.sum("score"), 4).alias("score")).join(files.select("file_id", "path"), "file_id").select("path", "reference_count", "score")


def name_hotspots(symbols: DataFrame, files: DataFrame, sample: int = 20) -> DataFrame:
    """(name, kind, sites, paths): names by the number of places that define them, with the first paths.

    Paths are numbered before they are gathered, so a name that is defined everywhere gathers no more
    than the sample.
    """
    rows = symbols.where("name is not null").join(files.select("file_id", "path"), "file_id")
    counts = rows.groupBy("name", "kind").agg(F.count("*").alias("sites"))
    w = Window.partitionBy("name", "kind").orderBy("path")
    first = rows.select("name", "kind", "path").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)
    paths = first.groupBy("name", "kind").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return counts.join(paths, ["name", "kind"]).select("name", "kind", "sites", F.array_join("paths", ",").alias("paths"))


def identity_hotspots(refs: DataFrame, symbols: DataFrame, files: DataFrame, lang: str = "csharp") -> DataFrame:
    """(target_key, name, kind, reference_count, score) of what references of one language mean for certain.

    A resolved reference means its symbol; an ambiguous one means its candidates' declaration, if all
    definitions of its name are one family with one name and kind. Parts of a family count as one. Sites
    count once for each logical kind, with the greatest weight.
    """
    key = F.coalesce("family_key", F.concat(F.lit("sym:"), F.col("symbol_id").cast("string")))
    ours = files.where(F.col("lang") == lang).select("file_id")
    targets = symbols.join(ours, "file_id", "left_semi").select("symbol_id", "name_folded", "name", "kind", key.alias("key"))
    one = F.struct("key", "name", "kind")
    agreed = targets.where("name_folded is not null").groupBy("name_folded").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <=> hi").select(F.col("name_folded").alias("symbol_name_folded"), "lo.*")
    sites = refs.join(ours, "file_id", "left_semi").select("file_id", "line", "column_number", logical_kind(F.col("reference_kind")).alias("logical"), "resolution_state", "target_symbol_id", "symbol_name_folded")
    exact = sites.where("target_symbol_id is not null").join(targets.select(F.col("symbol_id").alias("target_symbol_id"), "key", "name", "kind"), "target_symbol_id")
    group = sites.where("target_symbol_id is null and resolution_state in ('ambiguous', 'resolved_group')").join(agreed, "symbol_name_folded")
    columns = ["key", "name", "kind", "file_id", "line", "column_number", "logical"]
    found = exact.select(*columns).unionByName(group.select(*columns)).distinct()
    return found.groupBy(F.col("key").alias("target_key"), "name", "kind").agg(F.count("*").alias("reference_count"), (F.sum(weight(F.col("logical"), HOTSPOT_WEIGHTS)) / 10).alias("score"))


#: A frontier has so many candidates for each result, and no fewer and no more than these.
FRONTIER_EACH, FRONTIER_LEAST, FRONTIER_MOST = 64, 512, 4096


def frontier_hotspots(symbols: DataFrame, refs: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """``symbol_hotspots`` among the names of the strongest counts only: a quick answer to a small ``limit`` that may miss what ``symbol_hotspots`` finds."""
    most = max(FRONTIER_LEAST, min(FRONTIER_MOST, limit * FRONTIER_EACH))
    first = hotspot_counts(refs, files).orderBy(F.desc("score"), F.desc("reference_count"), "lang", "symbol_name", "file_id").limit(most)
    names = first.select("lang", F.lower("symbol_name").alias("name_folded")).distinct()
    found = symbols.join(files.select("file_id", "lang"), "file_id").join(F.broadcast(names), ["lang", "name_folded"], "left_semi").select(*symbols.columns)
    return symbol_hotspots(found, refs, files, limit, symbols)


# unused symbols


def unused_symbols(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols that nothing refers to, by id, or by name from any other symbol: (symbol_id, path, name, kind, bucket, confidence).

    Imports, namespaces and headings aren't judged.
    """
    by_id = refs.where("target_symbol_id is not null").select(F.col("target_symbol_id").alias("symbol_id")).distinct()
    used = refs.where("symbol_name_folded is not null and (container_name_folded is null or container_name_folded <> symbol_name_folded)")
    by_name = used.join(files.select("file_id", "lang"), "file_id").select("lang", F.col("symbol_name_folded").alias("name_folded")).distinct()
    rows = symbols.where("kind is null or kind not in ('import', 'namespace', 'heading')").join(files.select("file_id", "path", "lang"), "file_id")
    left = rows.join(by_id, "symbol_id", "left_anti").join(by_name, ["lang", "name_folded"], "left_anti")
    seen = F.lower("visibility")
    suspect = F.coalesce(F.col("signature").rlike("(?i)@|\\[[A-Z]|attribute|decorator"), F.lit(False)) | F.col("path").rlike("(?i)(config|settings|migrations?|handlers?|controllers?)[/.]")
    bucket = (
        F.when(suspect, "reflection_or_config_suspect").when(seen.isin("private", "fileprivate"), "likely_unused_private").when(seen.isin("internal", "protected", "private protected", "protected internal"), "maybe_unused_nonpublic").otherwise("public_or_exported_no_refs")
    )
    rows = left.select("symbol_id", "path", "name", "kind", bucket.alias("bucket"))
    return rows.withColumn("confidence", F.when(F.col("bucket") == "likely_unused_private", "medium").otherwise("low"))


def partial_siblings(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, file_id) of the other files that declare a part of the C# type that a symbol is a member of."""
    rows = symbols.join(files.where("lang = 'csharp'").select("file_id"), "file_id", "left_semi")
    parts = rows.where(F.col("kind").isin(*_CLASS_KINDS) & F.col("signature").rlike(r"\bpartial\b")).select(F.coalesce(F.concat("container_qualified_name", F.lit("."), "name"), "name").alias("type"), F.col("file_id").alias("part")).distinct()
    members = rows.where("container_qualified_name is not null").select("symbol_id", "file_id", F.col("container_qualified_name").alias("type"))
    return members.join(parts, "type").where("part <> file_id").select("symbol_id", F.col("part").alias("file_id")).distinct()


def named_in_text(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(symbol_id) of those of ``wanted`` (symbol_id, file_id, name, line) whose name stands as a word in the file, on another line.

    Names are gathered by file and meet its chunks there; a null line excludes none.
    """
    by_file = measured_side(wanted.groupBy("file_id").agg(F.collect_set("name").alias("names")))
    held = chunks.where("content is not null").select("file_id", "start_line", "content").join(by_file, "file_id")
    lines = held.select("file_id", "names", "start_line", F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    words = lines.select("file_id", (F.col("start_line") + F.col("k")).alias("at"), F.explode(F.array_intersect("names", F.split("text", "[^A-Za-z0-9_]+"))).alias("name")).distinct()
    return wanted.join(words, ["file_id", "name"]).where("not (line <=> at)").select("symbol_id").distinct()


def unused_beyond_text(symbols: DataFrame, refs: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``unused_symbols`` without the private ones that the text of their own file names elsewhere, or that of another part of their type."""
    unused = cut_lineage(unused_symbols(symbols, refs, files))
    private = symbols.join(unused.where("bucket = 'likely_unused_private'").select("symbol_id"), "symbol_id", "left_semi").where("name is not null").select("symbol_id", "file_id", "name", "line")
    parts = partial_siblings(symbols, files).join(private.drop("file_id", "line"), "symbol_id").select("symbol_id", "file_id", "name", F.lit(None).cast("int").alias("line"))
    return unused.join(named_in_text(private.unionByName(parts), chunks), "symbol_id", "left_anti")


# maps


def enriched_files(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Files with the numbers of their symbols and reference sites and a score."""
    n_symbols = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))
    n_refs = refs.groupBy("file_id").agg(F.count("*").alias("refs"))
    rows = files.join(n_symbols, "file_id", "left").join(n_refs, "file_id", "left").na.fill(0, ["symbols", "refs"])
    return rows.withColumn("score", F.coalesce("lines", F.lit(0)).cast("bigint") + 5 * F.col("symbols") + 2 * F.col("refs"))


def module_key(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` directories of a path, the repository alone for files right in it."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.least(F.size(F.split(path, "/")) - 1, F.lit(depth)), F.lit(1)))
    return F.array_join(dirs, "/")


def modules(rows: DataFrame, depth: int = 2) -> DataFrame:
    return rows.groupBy(module_key(F.col("path"), depth).alias("module")).agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.sum("symbols").alias("symbols"), F.sum("refs").alias("refs"))


def top_files(rows: DataFrame, by: str, limit: int) -> DataFrame:
    return rows.select("path", "lines", "size", "symbols", "refs", "score").orderBy(F.desc_nulls_last(by), "path").limit(limit)


#: Names and paths at which programs start.
ENTRY_NAMES = ("main", "run", "start", "app", "program", "cli", "serve", "execute")
ENTRY_PATHS = r"(^|/)(main|program|app|index|cli|server|__main__)\.[a-z]+$"


def entry_points(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, score, confidence) of likely entry points."""
    rows = symbols.where("name is not null").join(files.select("file_id", "path"), "file_id")
    low = ascii_lower(F.col("name"))
    hint = F.when(low.isin(*ENTRY_NAMES), 4).otherwise(0)
    where = F.when(F.lower("path").rlike(ENTRY_PATHS), 3).otherwise(0)
    kind = F.when(F.col("kind").isin("function", "class", "method"), 1).otherwise(0)
    depth = F.when(F.size(F.split("path", "/")) <= 3, 1).otherwise(0)
    scored = rows.select("path", "symbol_id", "name", "kind", (hint + where + kind + depth).alias("score"), (hint + where).alias("hints")).where("hints > 0")
    base = F.when(F.col("hints") >= 7, 0.85).when(F.col("hints") >= 4, 0.65).otherwise(0.5)
    return scored.select("path", "symbol_id", "name", "score", F.round(F.least(base + 0.02 * F.col("score"), F.lit(1.0)), 3).alias("confidence"))


def status(files: DataFrame, symbols: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(measure, value) of an index: counts in one row each."""
    counts = [("files", files), ("symbols", symbols), ("references", refs), ("chunks", chunks)]
    rows = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
        rows = one if rows is None else rows.unionByName(one)
    more = files.agg(F.countDistinct("lang").alias("languages"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.sum(F.when(F.col("generated"), 1).otherwise(0)).cast("bigint").alias("generated"))
    return rows.unionByName(more.select(F.expr("stack(3, 'languages', languages, 'bytes', bytes, 'generated', generated) as (measure, value)")))


def freshness(files: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, state) of the index against the last scan: missing, added or changed."""
    now = scan.where("path is not null").groupBy("path").agg(F.max(F.struct("scanned_at", F.lower("checksum").alias("checksum"))).alias("s"))
    was = files.select("path", F.lower("checksum").alias("checksum")).withColumn("indexed", F.lit(True))
    both = now.select("path", F.col("s.checksum").alias("now")).withColumn("scanned", F.lit(True)).join(was, "path", "full")
    state = F.when(F.col("scanned").isNull(), "missing").when(F.col("indexed").isNull(), "added").when(~F.col("now").eqNullSafe(F.col("checksum")), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def listed_files(rows: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """A page of files by path; ``after`` is the last path of the page before."""
    page = rows if after is None else rows.where(F.col("path") > after)
    return page.orderBy("path").limit(limit)
