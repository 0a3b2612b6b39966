"""Edges that only some languages have: attributes, imports, links, derived types and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import base_names, import_targets, resolve_links
from skerry.operators.lines import matching_lines
from skerry.operators.structure import _CLASS_KINDS
from skerry.runtime import cut_lineage

_ATTRIBUTE = r"^\s*(?:\[(?:\w+:\s*)?([A-Z]\w*)|@([A-Z]\w*))"


def metadata_edges(symbols: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, name) from an attribute or annotation to the class that it names.

    ``[Foo]`` may also mean a class FooAttribute, which then takes the edge alone. A name that several
    files define in a language gives no edge.
    """
    found = matching_lines(chunks, lambda t: t.rlike(_ATTRIBUTE)).select("file_id", F.coalesce(F.nullif(F.regexp_extract("text", _ATTRIBUTE, 1), F.lit("")), F.regexp_extract("text", _ATTRIBUTE, 2)).alias("name"))
    uses = found.distinct().join(files.select("file_id", "lang"), "file_id").withColumnRenamed("file_id", "src")
    defs = symbols.where(F.col("kind").isin(*_CLASS_KINDS)).join(files.select("file_id", "lang"), "file_id")
    single = defs.groupBy("lang", F.col("name").alias("target")).agg(F.min("file_id").alias("dst"), F.max("file_id").alias("hi")).where("dst = hi").drop("hi")
    forms = uses.withColumn("target", F.explode(F.array(F.concat("name", F.lit("Attribute")), F.col("name")))).withColumn("rank", F.length("name") - F.length("target"))
    hits = forms.join(single, ["lang", "target"])
    best = hits.groupBy("src", "name").agg(F.min(F.struct("rank", "dst")).alias("best"))
    return best.select("src", F.col("best.dst").alias("dst"), "name").where("src <> dst")


_IMPORT = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"


def import_edges(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, module, target) of Python imports, and the indexed path they lead to, null for outside modules."""
    rows = texts.where("lang = 'python'").select("path", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(_IMPORT))
    module = F.coalesce(F.nullif(F.regexp_extract("line", _IMPORT, 1), F.lit("")), F.regexp_extract("line", _IMPORT, 2))
    named = rows.select("path", module.alias("module")).distinct().withColumn("stem", import_targets("module", "path"))
    known = files.where("lang = 'python' and path is not null").select(F.regexp_replace("path", r"(/__init__)?\.py$", "").alias("stem"), F.col("path").alias("target"))
    return named.join(known, "stem", "left").select(F.col("path").alias("src_path"), "module", "target")


_LINK = r"\[[^\]]*\]\(([^)\s]+)"


def link_edges(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, target, n) of links between indexed documents."""
    rows = texts.where("lang = 'markdown'").select("path", F.explode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(1))).alias("link"))
    found = rows.groupBy("path", "link").agg(F.count("*").alias("n")).withColumn("target", resolve_links("path", "link"))
    return found.join(files.where("path is not null").select(F.col("path").alias("target")), "target", "left_semi").groupBy(F.col("path").alias("src_path"), "target").agg(F.sum("n").alias("n"))


def dispatch_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, type, base, depth): each type with all types it derives from, and in how many steps.

    Each step joins the bases found last with declared bases and is written; it ends when none is new.
    """
    rows = symbols.where(F.col("kind").isin(*_CLASS_KINDS) & F.col("signature").isNotNull()).join(files.select("file_id", "lang"), "file_id")
    direct = cut_lineage(rows.select("lang", F.col("name").alias("type"), F.explode(base_names(F.col("signature"))).alias("base")).where("type <> base").distinct())
    found = direct.withColumn("depth", F.lit(1))
    step, depth = direct, 1
    while not step.isEmpty():
        depth += 1
        more = step.select("lang", "type", F.col("base").alias("via")).join(direct.select("lang", F.col("type").alias("via"), "base"), ["lang", "via"]).select("lang", "type", "base").distinct()
        step = cut_lineage(more.join(found, ["lang", "type", "base"], "left_anti").where("type <> base"))
        found = found.unionByName(step.withColumn("depth", F.lit(depth)))
    return found
