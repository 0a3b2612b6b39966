"""Names: folding, qualified names, links and import targets."""

from __future__ import annotations

import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _unicode_fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def fold_name(name: Column) -> Column:
    """NFKC and full case folding; for names of ASCII only, nearly all, it is lower case."""
    return F.when(name.rlike("^[\\x00-\\x7f]*$"), F.lower(name)).otherwise(_unicode_fold(name))


def name_parts(name: Column) -> Column:
    """The segments of a qualified SQL name without their quotes: [a].[b], "a"."b", `a`.`b`."""
    found = F.regexp_extract_all(name, F.lit(r"\[[^\]]*\]|\"[^\"]*\"|`[^`]*`|[^.\s\[\]\"`]+"), F.lit(0))
    return F.transform(found, lambda p: F.regexp_replace(p, r"^[\[\"`]|[\]\"`]$", ""))


def normalized_name(name: Column) -> Column:
    return F.array_join(name_parts(name), ".")


def leaf_name(name: Column) -> Column:
    return F.try_element_at(name_parts(name), F.lit(-1))


def segment_count(name: Column) -> Column:
    return F.size(name_parts(name))


def without_verbatim(name: Column) -> Column:
    """A C# name without the signs that keep a keyword from being one."""
    return F.regexp_replace(name, r"(^|\.)@", "$1")


def exact_source_name(name: Column) -> Column:
    """A name as it is compared in source text: Kotlin's backquotes and C#'s verbatim signs are left out."""
    return F.regexp_replace(without_verbatim(name), "`", "")


def context_has_name(context: Column, name: Column) -> Column:
    """Whether a line holds a name, with no letter, digit or underscore around it."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.contains(context, name) & F.regexp_like(context, quoted)


def line_at(content: Column, start_line: Column, line: Column) -> Column:
    """A line of a chunk by its number in the file, null outside."""
    at = line - start_line
    return F.when(at >= 0, F.get(F.split(content, "\n", -1), at))


def argument_count(text: Column) -> Column:
    """Arguments of the first call in a text, by commas outside of nested brackets and strings; null without a call."""
    inner = F.regexp_extract(text, r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, "\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'", "s"), r"\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\{[^}]*\}|<[^<>]*>", "")
    return F.when(~F.contains(text, F.lit("(")), F.lit(None).cast("int")).when(F.trim(inner) == "", 0).otherwise(F.size(F.split(bare, ",", -1)))


def type_arity(signature: Column) -> Column:
    """Type parameters right after the first name of a declaration; brackets within them may nest."""
    listed = F.regexp_extract(signature, r"(?s)\b(?:class|struct|interface|record)\s+\w+\s*<(.*)", 1)
    marks = F.split(F.regexp_replace(F.regexp_replace(listed, "[=-]>", ""), r"[^<>()\[\]{},]", ""), "")
    walked = F.aggregate(
        marks,
        F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n")),
        lambda a, c: F.struct(
            (a["depth"] + F.when(a["depth"] == 0, 0).when(c.isin("<", "(", "[", "{"), 1).when(c.isin(">", ")", "]", "}"), -1).otherwise(0)).alias("depth"),
            (a["n"] + F.when((a["depth"] == 1) & (c == ","), 1).otherwise(0)).alias("n"),
        ),
        lambda a: a["n"],
    )
    return F.when(signature.isNotNull(), F.when(listed.rlike(r"^\s*>") | (listed == ""), 0).otherwise(walked))


def base_names(signature: Column) -> Column:
    """What a type declares to derive from."""
    part = F.regexp_extract(signature, r"(?:\bextends\s+|\bimplements\s+|\)?\s*:\s*|class\s+\w+\()([\w.<>, ]+)", 1)
    listed = F.regexp_replace(F.regexp_replace(F.regexp_replace(part, "<[^<>]*>", ""), r"\s+where\s.*$", ""), r"\s+(?:implements|extends)\s+", ",")
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")


def heading_slug(title: Column) -> Column:
    """The fragment of a heading: lower case, spaces to hyphens, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def resolve_link(source: str | None, link: str | None) -> str | None:
    """The path a relative link leads to, without its fragment; null for outside links."""
    if not source or link is None or re.match(r"^[a-z][a-z0-9+.-]*:|^//", link, re.I):
        return None
    target = link.split("#")[0].split("?")[0]
    if not target:
        return source
    base = "" if target.startswith("/") else posixpath.dirname(source)
    path = posixpath.normpath(posixpath.join(base, target.lstrip("/")))
    return None if path.startswith("..") else path


@pandas_udf(StringType())
def resolve_links(source: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([resolve_link(a, b) for a, b in zip(source, link)], dtype=object)


def import_target(module: str | None, source: str | None) -> str | None:
    """The path prefix a Python import names: dots lead up from the source's package."""
    if not module or source is None:
        return None
    dots = len(module) - len(module.lstrip("."))
    rest = module[dots:].replace(".", "/")
    if not dots:
        return rest
    base = posixpath.dirname(source)
    for _ in range(dots - 1):
        base = posixpath.dirname(base)
    return posixpath.join(base, rest) if rest else base


@pandas_udf(StringType())
def import_targets(module: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([import_target(a, b) for a, b in zip(module, source)], dtype=object)
