"""Issues of file contents: what is odd about a text before anything is extracted from it."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.lines import matching_lines
from skerry.operators.predicates import any_of, path_matches

MAX_LINE = 64 * 1024
MAX_TOKEN = 512


#: The category of each kind of issue; what isn't here is of the category other.
CATEGORIES = {
    "replacement_char": "decoding_risk", "bom": "byte_order_mark", "null_byte": "raw_bytes", "mixed_line_endings": "line_endings", "mixed_line_endings_three_way": "line_endings",
    "cr_only_line_endings": "line_endings", "line_too_long": "content_limit", "fts_token_too_long": "content_limit", "conflict_markers": "content_structure",
}


def category(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), kind), F.lit("other"))


def content_issues(chunks: DataFrame) -> DataFrame:
    """(file_id, kind, line) of issues that show in a line: replacement characters, marks, nulls, long lines and tokens, conflict markers, pointers to large files."""
    tests = lambda t: {
        "replacement_char": F.contains(t, F.lit("\ufffd")),
        "bom": t.startswith("\ufeff"),
        "null_byte": F.contains(t, F.lit("\u0000")),
        "line_too_long": F.length(t) > MAX_LINE,
        "fts_token_too_long": t.rlike(f"[A-Za-z0-9_]{{{MAX_TOKEN + 1},}}"),
        "conflict_markers": t.rlike("^(<<<<<<< |>>>>>>> |=======$)"),
        "lfs_pointer_skipped": t.startswith("version https://git-lfs"),
    }
    lines = matching_lines(chunks, lambda t: functools.reduce(Column.__or__, tests(t).values()))
    found = F.array_compact(F.array(*(F.when(test, F.lit(kind)) for kind, test in tests(F.col("text")).items())))
    return lines.select("file_id", F.explode(found).alias("kind"), "line").where("line = 1 or kind not in ('bom', 'lfs_pointer_skipped')")


def text_issues(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, n) of issues of a whole text as it was read: kinds of line ends and how many there are, marks, nulls and odd characters."""
    t = F.col("text")
    count = lambda mark: F.size(F.split(t, mark, -1)) - 1
    crlf = count("\r\n")
    rows = documents.where("text is not null").select("doc_id", crlf.alias("crlf"), (count("\r") - crlf).alias("cr"), (count("\n") - crlf).alias("lf"), count("\ufffd").alias("odd"), count("\\x00").alias("nulls"), t.startswith("\ufeff").alias("bom"))
    some = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    ends, n_ends = some("crlf") + some("cr") + some("lf"), F.col("crlf") + F.col("cr") + F.col("lf")
    issue = lambda test, kind, n: F.when(test, F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n")))
    kinds = F.array_compact(F.array(
        issue(ends == 2, "mixed_line_endings", n_ends), issue(ends == 3, "mixed_line_endings_three_way", n_ends), issue((ends == 1) & (F.col("cr") > 0), "cr_only_line_endings", F.col("cr")),
        issue(F.col("odd") > 0, "replacement_char", F.col("odd")), issue(F.col("nulls") > 0, "null_byte", F.col("nulls")), issue(F.col("bom"), "bom", F.lit(1)),
    ))
    return rows.select("doc_id", F.explode(kinds).alias("i")).select("doc_id", F.col("i.kind").alias("kind"), F.col("i.n").alias("n"))


def suppressed_extraction(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file_id, kind, line) of files whose paths fit a pattern for generated code; their symbols and references aren't extracted."""
    return files.where(any_of([path_matches(F.col("path"), p if "/" in p else f"*/{p}") for p in patterns])).select("file_id", F.lit("generated_code_extraction_skipped").alias("kind"), F.lit(0).alias("line"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("issues"), F.countDistinct("file_id").alias("files"))
