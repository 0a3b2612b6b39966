"""Writing indexes and results: exports, reports and graphs, as rows of text that Spark writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.runtime import numbered_files, shuffle_partitions, write_once

#: Kinds of tags files.
CTAGS_KINDS = {"class": "c", "struct": "s", "interface": "i", "enum": "g", "function": "f", "method": "m", "property": "p", "namespace": "n", "variable": "v", "heading": "h"}


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of an index as a new version, which one file then publishes.

    Readers follow the last published version, so they see all of its tables or all of the one before;
    what a failed run leaves behind is never read. Of two runs at once the later one to publish wins a
    higher number. Rows of one file lie together, so reading a file touches few row groups.
    """
    spark = next(iter(tables.values())).sparkSession
    data = f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = df.repartition(shuffle_partitions(spark), "file_id").sortWithinPartitions("file_id") if "file_id" in df.columns else df
        rows.write.parquet(f"{data}/{name}")
    body = json.dumps({"data": data, "tables": sorted(tables)})
    while True:
        number = max(numbered_files(spark, f"{path.rstrip('/')}/published"), default=-1) + 1
        try:
            return write_once(spark, f"{path.rstrip('/')}/published/{number:08d}.json", body)
        except FileExistsError:
            continue


def published(spark: SparkSession, path: str) -> dict:
    """The last published version of an index: where its data are, and its tables."""
    found = numbered_files(spark, f"{path.rstrip('/')}/published")
    if not found:
        raise ValueError(f"no index has been published in {path}")
    return json.loads(found[max(found)])


def ctags(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, address, kind, line) of symbols of known kinds, as a tags file has them."""
    kinds = F.create_map(*(F.lit(x) for kv in CTAGS_KINDS.items() for x in kv))
    rows = symbols.where("name is not null and line is not null").join(files.select("file_id", "path"), "file_id").withColumn("k", F.try_element_at(kinds, "kind"))
    return rows.where("k is not null and not contains(name, '\t')").select("name", "path", F.concat(F.col("line").cast("string"), F.lit(';"')).alias("address"), F.col("k").alias("kind"), "line")


def ctags_skipped(symbols: DataFrame) -> DataFrame:
    """(reason, n) of symbols that a tags file leaves out, each reason with a row."""
    reason = F.when(F.col("name").isNull(), "no_name").when(F.col("line").isNull(), "no_line").when(~F.coalesce(F.col("kind").isin(*CTAGS_KINDS), F.lit(False)), "kind").when(F.contains("name", F.lit("\t")), "bad_name")
    reasons = ("no_name", "no_line", "kind", "bad_name")
    counts = symbols.select(reason.alias("reason")).agg(*(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in reasons))
    return counts.select(F.expr(f"stack({len(reasons)}, {', '.join(f"'{r}', {r}" for r in reasons)}) as (reason, n)"))


def redacted(path: Column, depth: int = 1) -> Column:
    """A path whose directories below ``depth`` are hashed, each on its own, so that the tree keeps its shape."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.when((i < depth) | (i == F.size(parts) - 1), p).otherwise(F.substring(F.sha2(p, 256), 1, 12))), "/")


# locations


def _json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def quickfix(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"), F.col("text")).alias("value"))


def lsp_locations(rows: DataFrame) -> DataFrame:
    """Locations with positions from 0."""
    start = F.struct((F.col("line") - 1).alias("line"), (F.col("column") - 1).alias("character"))
    end = F.struct((F.col("line") - 1).alias("line"), (F.col("column") - 1 + F.col("length")).alias("character"))
    return rows.select(_json(F.struct(F.concat(F.lit("file:///"), "path").alias("uri"), F.struct(start.alias("start"), end.alias("end")).alias("range"))).alias("value"))


def sarif_results(rows: DataFrame, rule: str) -> DataFrame:
    """One SARIF result for each row, to be put into a run's ``results``."""
    where = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")).alias("physicalLocation"))
    return rows.select(_json(F.struct(F.lit(rule).alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("text").alias("text")).alias("message"), F.array(where).alias("locations"))).alias("value"))


def delimited(rows: DataFrame, fields: Sequence[str], sep: str = ",") -> DataFrame:
    """Rows as lines of delimited text; a field with a delimiter, a quote or a line end is quoted, null is empty."""

    def one(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        odd = F.contains(text, F.lit(sep)) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
        return F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return rows.select(F.concat_ws(sep, *(one(c) for c in fields)).alias("value"))


def grouped_by_path(rows: DataFrame, most: int) -> DataFrame:
    """(path, matches, value): the lines of each path as one text, ``most`` of them at most, and how many there are in all."""
    w = Window.partitionBy("path").orderBy("line", "column", "text")
    counts = rows.groupBy("path").agg(F.count("*").alias("matches"))
    first = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    texts = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(F.col("line").cast("string"), F.lit(": "), "text").alias("t")))).alias("rows"))
    return counts.join(texts, "path").select("path", "matches", F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("value"))


def ndjson(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows as JSON with the named fields only."""
    unknown = [f for f in fields if f not in rows.columns]
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    return rows.select(_json(F.struct(*fields)).alias("value"))


def within_bytes(rows: DataFrame, most: int, order: Sequence[str], blocks: int = 1024) -> DataFrame:
    """The first rows, in order, whose JSON fits into ``most`` bytes together.

    No row beyond ``most`` / 2 places can be among them, as each takes two bytes at least, so only that
    many leave the sort.
    """
    text = rows.withColumn("skerry_bytes", F.octet_length(_json(F.struct(*rows.columns))) + 1)
    first = text.orderBy(*order).limit(max(1, most // 2))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("skerry_sum", F.sum("skerry_bytes").over(w)).where(F.col("skerry_sum") <= most).drop("skerry_bytes", "skerry_sum")


# graphs


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def dot_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, n) as lines of a DOT graph's body."""
    return edges.select(F.concat(_quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [weight="), F.col("n").cast("string"), F.lit("];")).alias("value"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="n">'), F.col("n").cast("string"), F.lit("</data></edge>")).alias("value"))


def graph_json(edges: DataFrame) -> DataFrame:
    return edges.select(_json(F.struct("src", "dst", "n")).alias("value"))


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "src", "dst", F.col("n").cast("string")).alias("value"))


def write_lines(rows: DataFrame, path: str, head: str = "", tail: str = "") -> None:
    """Rows of text as files of a folder, with what comes before and after in files that sort around them."""
    rows.write.mode("overwrite").text(path)
    for name, text in ((f"{path}.head", head), (f"{path}.tail", tail)):
        if text:
            rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(name)
