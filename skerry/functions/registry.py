"""The scalar functions under the names by which SQL can call them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skerry.functions import names

#: Functions that run in Python on Arrow batches. All others of ``names`` are expressions of built-in functions and need no name of their own.
ARROW = {"resolve_links": names.resolve_links, "import_targets": names.import_targets, "unicode_fold": names._unicode_fold}

#: Functions of one text as SQL expressions of built-in functions, with ``x`` for the argument.
EXPRESSIONS = {
    "ascii_fold": "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "name_fold": "if(x rlike '^[\\\\x00-\\\\x7f]*$', lower(x), unicode_fold(x))",
    "name_leaf": "try_element_at(transform(regexp_extract_all(x, '\\\\[[^\\\\]]*\\\\]|\"[^\"]*\"|`[^`]*`|[^.\\\\s\\\\[\\\\]\"`]+', 0), p -> regexp_replace(p, '^[\\\\[\"`]|[\\\\]\"`]$', '')), -1)",
    "heading_slug": "regexp_replace(regexp_replace(lower(trim(x)), '[^\\\\p{L}\\\\p{N}\\\\s_-]', ''), '\\\\s', '-')",
    "plain_name": "regexp_replace(x, '(^|\\\\.)@', '$1')",
    "path_leaf": "substring_index(x, '/', -1)",
    "path_dir": "substring(x, 1, length(x) - length(substring_index(x, '/', -1)))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and gives their names; expressions stay expressions, so plans of SQL keep them in generated code."""
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    for name, body in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {body}")
    return sorted([*ARROW, *EXPRESSIONS])
