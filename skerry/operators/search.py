"""Full-text search over chunks: postings, ranking, query syntax, guards and match origins."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators.lines import literal_lines, matching_lines
from skerry.operators.predicates import ascii_lower, path_bucket, visibility_rank
from skerry.runtime import cut_lineage, numbered, spread

K1, B = 1.2, 0.75
MAX_QUERY = 1000
#: Characters of the longest token that has a posting.
MAX_TOKEN = 512


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks once each, whole; this exchanges contents, so it is for results that are contents."""
    return chunks.where("content is not null").select("chunk_id", "file_id", "start_line", "content").distinct()


def _once(rows: DataFrame) -> DataFrame:
    """What was found of chunks, with one row for each different chunk, the contents themselves staying where they are."""
    return rows.distinct()


def _keys() -> list[Column]:
    """What tells chunks apart; contents by two hashes."""
    return [F.col("chunk_id"), F.col("file_id"), F.col("start_line"), F.xxhash64("content").alias("skerry_a"), F.hash("content").alias("skerry_b")]


def lengths(chunks: DataFrame, *more: Column) -> DataFrame:
    """(chunk_id, file_id, start_line, length in tokens, ...) of each different chunk."""
    return _term_counts(chunks, [], more=more).drop("skerry_a", "skerry_b")


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, term, tf, first, length): how often and first where each term occurs in a chunk.

    Terms are counted within each chunk before anything is exchanged, so copies of a chunk give equal rows.
    """
    rows = chunks.where("content is not null").select(F.monotonically_increasing_id().alias("skerry_row"), *_keys(), tokens(F.col("content")).alias("words"))
    terms = rows.select(*rows.columns[:-1], F.size("words").alias("length"), F.posexplode("words").alias("at", "term"))
    counted = terms.groupBy("skerry_row", "chunk_id", "file_id", "start_line", "skerry_a", "skerry_b", "length", "term").agg(F.count("*").alias("tf"), F.min("at").alias("first"))
    return _once(counted.drop("skerry_row")).drop("start_line", "skerry_a", "skerry_b")


def query_terms(query: str) -> list[str]:
    if len(query) > MAX_QUERY:
        raise ValueError(f"a query of more than {MAX_QUERY} characters")
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def search_all(chunks: DataFrame, query: str, prefix: bool = False) -> DataFrame:
    """(chunk_id, file_id, bm25) of chunks that hold every term of the query, or a word that starts with it.

    Without a stored index: contents become the counts of these terms and their length in the scan, and
    only these are exchanged, to leave copies of chunks out. See ``index.SearchIndex`` for a stored one.
    """
    terms = query_terms(query)
    counts = _term_counts(chunks, terms, prefix)
    return _scored(counts, len(terms)).select("chunk_id", "file_id", "bm25")


def _term_counts(chunks: DataFrame, terms: Sequence[str], prefix: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """Of each different chunk its length, how often it has each term, and ``more``."""
    contents = spread(chunks.where("content is not null").select("chunk_id", "file_id", "start_line", "content"))
    rows = contents.select(*_keys(), *more, tokens(F.col("content")).alias("words"))
    same = (lambda q: lambda w: w.startswith(q)) if prefix else (lambda q: lambda w: w == q)
    return _once(rows.select(*rows.columns[:-1], F.size("words").alias("length"), *(F.size(F.filter("words", same(t))).alias(f"tf{i}") for i, t in enumerate(terms))))


def _scored(counts: DataFrame, n_terms: int) -> DataFrame:
    """The chunks that have all terms, with their score; a query without terms finds none."""
    if not n_terms:
        return counts.withColumn("bm25", F.lit(0.0)).where(F.lit(False))
    stats = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(n_terms)))
    score, held = F.lit(0.0), F.lit(True)
    for i in range(n_terms):
        tf = F.col(f"tf{i}")
        score = score + bm25(tf, F.col(f"df{i}"), F.col("length"), F.col("n"), F.col("mean"))
        held = held & (tf > 0)
    # one row of statistics, whatever the size of the index
    return counts.join(F.broadcast(stats), how="inner").where(held).withColumn("bm25", F.round(score, 6))


def bm25(tf: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search_ranked(chunks: DataFrame, files: DataFrame, symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Ranked hits: (rank, path, chunk_id, symbol_bucket, prefix_bucket, text_match, bucket, bm25).

    First come chunks with a symbol of exactly this name, then files with one, then the rest; next
    prefixes of names, then whether the query occurs as it stands, the kind of path, and BM25. What is
    asked of a content is asked in the scan, so no content leaves it.
    """
    low = query.strip().lower()
    terms = query_terms(query)
    asked = [F.contains(F.lower("content"), F.lit(low)).alias("text_match"), (F.col("start_line") + F.size(F.split("content", "\n", -1)) - 1).alias("end_line")]
    hits = _scored(_term_counts(chunks, terms, more=asked), len(terms)).select("chunk_id", "file_id", "start_line", "end_line", "text_match", "bm25")
    return ranked_hits(hits, files, symbols, query, limit)


def ranked_hits(hits: DataFrame, files: DataFrame, symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """The first ``limit`` of hits (chunk_id, file_id, start_line, end_line, text_match, bm25), see ``search_ranked``."""
    low = query.strip().lower()
    named = symbols.where(ascii_lower(F.col("name")).startswith(low)).select("file_id", (ascii_lower(F.col("name")) == low).alias("exact"), F.coalesce("start_line", "line").alias("at"))
    by_file = named.groupBy("file_id").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("at")))).alias("exact_at"), F.sort_array(F.collect_set("at")).alias("at"), F.max("exact").alias("exact"))
    inside = lambda c: F.exists(c, lambda n: n.between(F.col("start_line"), F.col("end_line")))
    rows = hits.join(by_file, "file_id", "left").join(files.select("file_id", "path"), "file_id").select(
        "path", "chunk_id",
        F.when(inside("exact_at"), 0).when(F.col("exact"), 1).otherwise(2).alias("symbol_bucket"),
        F.when(inside("at"), 0).when(F.col("exact").isNotNull(), 1).otherwise(2).alias("prefix_bucket"),
        F.when(F.col("text_match"), 0).otherwise(1).alias("text_match"), path_bucket(F.col("path")).alias("bucket"), "bm25",
    )
    order = ["symbol_bucket", "prefix_bucket", "text_match", "bucket", F.desc("bm25"), "path", "chunk_id"]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def found_chunks(chunks: DataFrame, found: Column, *more: Column) -> DataFrame:
    """(chunk_id, file_id, ...) of the different chunks that ``found`` holds for; contents stay in the scan."""
    rows = _once(chunks.where(F.col("content").isNotNull() & found).select(*_keys(), *more))
    return rows.drop("start_line", "skerry_a", "skerry_b")


def phrase_first(chunks: DataFrame, query: str) -> DataFrame:
    """(chunk_id, file_id, rank) of chunks that hold all words of a query; those that hold it as it stands come first, with rank 0."""
    words = [F.contains(F.lower("content"), F.lit(t)) for t in query_terms(query)]
    return found_chunks(chunks, functools.reduce(Column.__and__, words, F.lit(bool(words))), F.when(F.contains("content", F.lit(query)), 0).otherwise(1).alias("rank"))


def long_token_hits(chunks: DataFrame, query: str, longest: int = MAX_TOKEN) -> DataFrame:
    """(chunk_id, file_id) of chunks that hold the query, whatever its case, in files with a token too long to be indexed.

    Such tokens have no posting, so only a look at the contents finds what lies in them.
    """
    if not query.isascii():
        raise ValueError("only ASCII can be sought in long tokens")
    odd = found_chunks(chunks, F.col("content").rlike(f"[A-Za-z0-9_]{{{longest + 1}}}")).select("file_id").distinct()
    return found_chunks(chunks, F.contains(F.lower("content"), F.lit(query.lower()))).join(odd, "file_id", "left_semi").select("chunk_id", "file_id")


def exact_substring(chunks: DataFrame, query: str) -> DataFrame:
    return found_chunks(chunks, F.contains("content", F.lit(query)))


def token_boundary(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks where the query occurs with no letter, digit or underscore of ASCII right before or after it."""
    quoted = "\\Q" + query + "\\E"
    found = F.contains("content", F.lit(query)) & F.col("content").rlike(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")
    return found_chunks(chunks, found)


# the syntax of raw queries


@dataclass(frozen=True)
class _Node:
    kind: str  # phrase, and, or, not, near
    parts: tuple = ()
    words: tuple[str, ...] = ()
    prefix: bool = False
    distance: int = 10


#: Phrases that a raw query may have.
MOST_PHRASES = 64


class QuerySyntaxError(ValueError):
    """The raw query can't be read."""


class _RawQuery:
    """``"a phrase"``, ``word``, ``pre*``, AND, OR, NOT, brackets, ``NEAR(a b, 5)``, ``content:word``; words side by side mean AND."""

    def __init__(self, text: str) -> None:
        self.tokens = re.findall(r'"(?:[^"]|"")*"|[()]|,|[^\s()",]+', text)
        if text.count('"') % 2:
            raise QuerySyntaxError("unclosed quote")
        self.i = self.phrases = 0

    def peek(self) -> str | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def read(self) -> _Node:
        node = self.either()
        if self.peek() is not None:
            raise QuerySyntaxError(f"unexpected {self.peek()}")
        return node

    def either(self) -> _Node:
        parts = [self.both()]
        while self.peek() == "OR":
            self.i += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else _Node("or", tuple(parts))

    def both(self) -> _Node:
        node = self.primary()
        while (t := self.peek()) not in (None, "OR", ")", ","):
            if t == "NOT":
                self.i += 1
                node = _Node("not", (node, self.primary()))
            else:
                if t == "AND":
                    self.i += 1
                node = _Node("and", (node, self.primary()))
        return node

    def primary(self) -> _Node:
        t = self.peek()
        if t is None or t in ("AND", "OR", "NOT", ")", ","):
            raise QuerySyntaxError(f"term expected, not {t}")
        self.i += 1
        if t == "(":
            node = self.either()
            if self.peek() != ")":
                raise QuerySyntaxError(") expected")
            self.i += 1
            return node
        if t == "NEAR" and self.peek() == "(":
            self.i += 1
            parts, distance = [], 10
            while self.peek() not in (")", ",", None):
                parts.append(self.primary())
            if self.peek() == ",":
                self.i += 1
                distance = int(self.tokens[self.i])
                self.i += 1
            if self.peek() != ")" or any(p.kind != "phrase" for p in parts):
                raise QuerySyntaxError("bad NEAR")
            self.i += 1
            return _Node("near", tuple(parts), distance=distance)
        column = re.match(r"([A-Za-z_]\w*)\s*:(?!:)", t)
        if column:
            if column.group(1).lower() != "content":
                raise QuerySyntaxError(f"no such column: {column.group(1)}")
            t = t[column.end() :]
            if not t:  # what is asked of the column follows
                return self.primary()
        prefix = t.endswith("*")
        words = query_terms_in_order(t.strip('"*'))
        self.phrases += 1
        if self.phrases > MOST_PHRASES:
            raise QuerySyntaxError(f"more than {MOST_PHRASES} phrases")
        if not words:
            raise QuerySyntaxError(f"no word in {t}")
        return _Node("phrase", words=tuple(words), prefix=prefix)


def query_terms_in_order(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def _starts(node: _Node, words: Column) -> Column:
    """The places, from 0, at which a phrase begins."""
    n = len(node.words)

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(node.words):
            at = F.get(words, i + k)
            out = out & F.coalesce(at.startswith(w) if node.prefix and k == n - 1 else at == w, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), here)


def _holds(node: _Node, words: Column) -> Column:
    if node.kind == "phrase":
        if len(node.words) == 1 and not node.prefix:
            return F.array_contains(words, node.words[0])
        return F.size(_starts(node, words)) > 0
    if node.kind == "and":
        return _holds(node.parts[0], words) & _holds(node.parts[1], words)
    if node.kind == "or":
        out = _holds(node.parts[0], words)
        for p in node.parts[1:]:
            out = out | _holds(p, words)
        return out
    if node.kind == "not":
        return _holds(node.parts[0], words) & ~_holds(node.parts[1], words)
    first, *rest = node.parts

    def near(i: Column) -> Column:
        out = F.lit(True)
        for p in rest:
            gap_after = lambda j, p=p: (j - i - len(first.words)) <= node.distance
            gap_before = lambda j, p=p: (i - j - len(p.words)) <= node.distance
            out = out & F.exists(_starts(p, words), lambda j: ((j >= i) & gap_after(j)) | ((j < i) & gap_before(j)))
        return out

    return F.exists(_starts(first, words), near)


def raw_search(chunks: DataFrame, query: str) -> DataFrame:
    """(chunk_id, file_id) for a raw query; a query that can't be read raises ``QuerySyntaxError``."""
    node = _RawQuery(query).read()
    # the words are bound to a lambda's variable, so that they are split once and not for each place they are looked at
    found = F.get(F.transform(F.array(tokens(F.col("content"))), lambda words: _holds(node, words)), 0)
    return found_chunks(chunks, found)


#: Words that begin statements.
_KEYWORDS = ("class", "def", "function", "func", "public", "private", "static", "return", "import", "using", "namespace", "new", "await", "async")
#: Operators that stand alone.
_OPERATORS = ("=>", "->", "::", "==", "!=", "&&", "||")


def advised(queries: DataFrame) -> DataFrame:
    """(query, exact): whether a query looks like code, so that an exact substring search may serve better.

    That is with two or more marks of code, an operator that stands alone, or a keyword and then a name.
    """
    marks = F.length(F.regexp_replace("query", r"[^(){}\[\];=<>.:&|!+\-*/%]", ""))
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    stands = F.arrays_overlap(words, F.array(*(F.lit(o) for o in _OPERATORS)))
    phrase = (F.size(words) > 1) & F.get(words, 0).isin(*_KEYWORDS) & F.get(words, 1).rlike(r"^[A-Za-z_]\w*$")
    return queries.select("query", F.when(F.col("query").isNotNull(), (marks >= 2) | stands | F.coalesce(phrase, F.lit(False))).alias("exact"))


def suggests_exact(spark: SparkSession, query: str) -> bool:
    return advised(spark.createDataFrame([(query,)], "query string")).first().exact


# hits on lines


def line_hits(chunks: DataFrame, query: str) -> DataFrame:
    """(file_id, line, text) of lines that hold the query, without regard to case."""
    return literal_lines(chunks, query).select("file_id", "line", "text")


class GuardBudgetError(ValueError):
    """More candidates than a guard may look at."""


def within_budget(hits: DataFrame, most: int = 200) -> DataFrame:
    """``hits``, if they are at most ``most``; a guard on more is refused with ``GuardBudgetError``."""
    if hits.limit(most + 1).count() > most:
        raise GuardBudgetError(f"more than {most} candidates")
    return hits


def guarded(hits: DataFrame, chunks: DataFrame, guard: str, window: int, side: str = "before", require: bool = True) -> DataFrame:
    """Hits that have, or have not, a guard within a window of lines on one side or on the same line.

    The guard's lines are turned into the lines they reach, so the test is an equi-join on file and line.
    """
    marks = line_hits(chunks, guard).select("file_id", F.col("line").alias("at"))
    lo, hi = {"before": (1, window), "after": (-window, -1), "same": (0, 0)}[side]
    reach = marks.select("file_id", F.explode(F.sequence(F.col("at") + lo, F.col("at") + hi)).alias("line")).distinct()
    return hits.join(reach, ["file_id", "line"], "left_semi" if require else "left_anti")


def guarded_whole(hits: DataFrame, chunks: DataFrame, guard: str, window: int, budget: int = 200, side: str = "before", require: bool = True) -> DataFrame:
    """(file_id, line) of all ``guarded`` hits, however many candidates there are.

    The candidates are written and counted. Up to ``budget`` of them, guards are sought in their files
    only, which are broadcast; beyond it in all chunks, with the same result. A caller that wants such a
    guard refused asks ``within_budget``.
    """
    kept = cut_lineage(hits.select("file_id", "line"))
    if kept.count() <= budget:
        chunks = chunks.join(F.broadcast(kept.select("file_id").distinct()), "file_id", "left_semi")
    return guarded(kept, chunks, guard, window, side, require)


def guarded_in_symbol(hits: DataFrame, chunks: DataFrame, guard: str, symbols: DataFrame, side: str = "before", require: bool = True) -> DataFrame:
    """Hits that have, or have not, a guard before or after them in the same innermost symbol.

    Of a symbol's guards the first and the last line tell, so hits and guards are never paired. A hit
    outside of all symbols has no guard.
    """
    marks = enclosing_symbols(line_hits(chunks, guard).select("file_id", "line"), symbols).where("symbol_id is not null")
    ends = marks.groupBy("file_id", "symbol_id").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    rows = enclosing_symbols(hits.select("file_id", "line"), symbols).join(ends, ["file_id", "symbol_id"], "left")
    there = F.coalesce(F.col("first") < F.col("line") if side == "before" else F.col("last") > F.col("line"), F.lit(False))
    return rows.where(there if require else ~there).select("file_id", "line")


def enclosing_symbols(hits: DataFrame, symbols: DataFrame, bucket: int = 64) -> DataFrame:
    """Hits with the innermost symbol that covers their line: (*, symbol_id, symbol_name, symbol_kind, symbol_line), null where there is none.

    Covering is an equi-join on file and on stretches of ``bucket`` lines, with the exact range as a
    residue, so a file with many symbols and hits doesn't pair them all.
    """
    spans = symbols.where("start_line is not null and end_line is not null and end_line >= start_line").select(
        "file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("n"), F.col("kind").alias("k"), "symbol_id"
    )
    reach = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))
    keyed = hits.select("file_id", "line").distinct().withColumn("stretch", F.floor(F.col("line") / bucket))
    found = keyed.join(reach, ["file_id", "stretch"]).where("line between s and e")
    inner = found.groupBy("file_id", "line").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), (-F.col("s")).alias("x"), "symbol_id", "n", "k")).alias("best"))
    return hits.join(inner, ["file_id", "line"], "left").select(*[hits[c] for c in hits.columns], F.col("best.symbol_id").alias("symbol_id"), F.col("best.n").alias("symbol_name"), F.col("best.k").alias("symbol_kind"), (-F.col("best.x")).alias("symbol_line"))


def structured_order(symbols: DataFrame) -> DataFrame:
    """(file_id, name, kind_order, visibility_order): how kinds and visibility rank a symbol hit."""
    kind = F.when(F.col("kind").isin("class", "struct", "interface", "enum", "record"), 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "property", 2).when(F.col("kind") == "heading", 4).otherwise(3)
    return symbols.groupBy("file_id", "name").agg(F.min(kind).alias("kind_order"), F.min(visibility_rank(F.col("visibility"))).alias("visibility_order"))


def origin_of(lang: Column, text: Column, column: Column) -> Column:
    """Whether a match lies in code, a comment or a string, from the text of its line before it.

    The part before the match is stripped of complete strings; a comment sign left over means a
    comment, a quote left over an open string.
    """
    before = F.substring(text, F.lit(1), column - 1)
    bare = F.regexp_replace(before, "\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'|`[^`]*`", "")
    slash = lang.isin("javascript", "typescript", "java", "csharp", "go", "c", "cpp", "rust", "kotlin", "swift")
    comment = (slash & (bare.rlike("//|/\\*(?!.*\\*/)") | F.ltrim(text).rlike("^(/\\*|\\*)"))) | (lang.isin("python", "shell", "ruby", "yaml") & F.contains(bare, F.lit("#")))
    return F.when(lang.isNull(), "unknown").when(comment, "comment").when(bare.rlike("[\"'`]"), "string_literal").otherwise("code")


def result_kinds(hits: DataFrame, query: str, column: str = "column") -> DataFrame:
    """``hits`` (file_id, line, text, lang, symbol_line and the column of a match) with ``kinds``: what a match is, sorted.

    Always its origin; identifier if that is code, declaration on the line where its innermost symbol
    begins, call_site if elsewhere in code the name that ends the query is followed by a bracket.
    """
    probe = re.search(r"[A-Za-z_@][A-Za-z0-9_@]*(?:\.[A-Za-z_@][A-Za-z0-9_@]*)*$", query.strip())
    name = probe.group().removeprefix("@") if probe else ""
    rows = hits.withColumn("origin", origin_of(F.col("lang"), F.col("text"), F.col(column)))
    code, declared = F.col("origin") == "code", F.coalesce(F.col("symbol_line") == F.col("line"), F.lit(False))
    called = code & ~declared & F.contains("text", F.lit(name + "(")) if name else F.lit(False)
    kinds = F.array(F.col("origin"), F.when(code, "identifier"), F.when(declared, "declaration"), F.when(called, "call_site"))
    return rows.withColumn("kinds", F.sort_array(F.array_compact(kinds))).drop("origin")


def counted(hits: DataFrame, by: str) -> DataFrame:
    """(key, hits, files) of hits (file_id, path, lang, ..) by path, directory, extension, language, repository, or the symbol around them.

    By symbol, hits need symbol_kind and symbol_name; those outside of all symbols count under a null key.
    """
    keys = {
        "path": F.col("path"), "directory": F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)"), "extension": F.when(F.contains(F.substring_index("path", "/", -1), F.lit(".")), F.lower(F.substring_index("path", ".", -1))),
        "language": F.col("lang"), "repository": F.substring_index("path", "/", 1),
    }
    key = F.when(F.col("symbol_name").isNotNull(), F.concat_ws(" ", "symbol_kind", "symbol_name")) if by == "symbol" else keys[by]
    return hits.groupBy(key.alias("key")).agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"))


def focused(line: Column, last: Column, lines: int = 8, focus: str = "center") -> tuple[Column, Column]:
    """First and last line of a snippet of ``lines`` lines around a match, clamped to the file; the match lies at its start, center or end."""
    before = {"start": 0, "center": (lines - 1) // 2, "end": lines - 1}[focus]
    start = F.greatest(F.least(line - before, last - lines + 1), F.lit(1))
    return start, F.least(start + lines - 1, last)


def first_per_file(hits: DataFrame, per_file: int, total: int | None = None) -> DataFrame:
    """The first hits of each file by line and column, then at most ``total`` by path order."""
    w = Window.partitionBy("path").orderBy("line", "column")
    rows = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_file).drop("k")
    return rows if total is None else rows.orderBy("path", "line", "column").limit(total)


#: Start and factor of the 64-bit FNV-1a hash, and the seed of samples.
FNV_START = 14695981039346656037
FNV_FACTOR = 1099511628211
SAMPLE_SEED = 0


def fnv1a(*columns: pd.Series, seed: int = SAMPLE_SEED) -> pd.Series:
    """FNV-1a of the UTF-16 units of texts, each followed by 0xff, as a signed number whose order is that of the unsigned one."""
    n = len(columns[0])
    h = np.full(n, FNV_START ^ seed, dtype=np.uint64)
    factor = np.uint64(FNV_FACTOR)
    with np.errstate(over="ignore"):
        for texts in columns:
            units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
            sizes = np.array([len(u) for u in units])
            for k in range(sizes.max(initial=0)):
                on = np.flatnonzero(sizes > k)
                h[on] = (h[on] ^ np.array([units[i][k] for i in on], dtype=np.uint64)) * factor
            h = (h ^ np.uint64(0xFF)) * factor
    return pd.Series((h ^ np.uint64(1 << 63)).view(np.int64))


def sample_hits(hits: DataFrame, size: int, order: Sequence[str], fields: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """``size`` hits, the same on every run: those with the least hashes of ``fields`` and of their place in ``order``, from 0.

    As many hits as there are up to ``size`` come whole; of a sample of one it is the first.
    """
    if size == 1:
        return hits.orderBy(*order).limit(1)
    placed = numbered(hits, order, "skerry_place")
    key = F.pandas_udf(lambda *c: fnv1a(*c, seed=seed), "bigint")
    keyed = placed.withColumn("skerry_key", key(*(F.col(c).cast("string") for c in fields), F.col("skerry_place").cast("string")))
    return keyed.orderBy("skerry_key", "skerry_place").limit(size).drop("skerry_key", "skerry_place")


def named_queries(chunks: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_name, file_id, line) of several queries in one pass over the contents."""
    holds = lambda c: {n: F.contains(F.lower(c), F.lit(q.lower())) for n, q in queries.items()}
    some = lambda c: functools.reduce(Column.__or__, holds(c).values())
    lines = matching_lines(chunks, some, some)
    return lines.select("file_id", "line", F.explode(F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in holds(F.col("text")).items())))).alias("query_name"))


#: Built-in sets of queries for audits.
RECIPES: dict[str, Sequence[str]] = {
    "unfinished": ("todo", "fixme", "notimplemented"),
    "logging": ("console.log", "logger.info", "log.printf", "log.info"),
    "dynamic": ("eval(", "exec(", "reflection"),
}


def audit(chunks: DataFrame, recipes: dict[str, Sequence[str]] = RECIPES) -> DataFrame:
    """(recipe, query, findings, files) of all recipes in one pass over the lines."""
    flat = {f"{r}\t{q}": q for r, qs in recipes.items() for q in qs}
    hits = named_queries(chunks, flat)
    return hits.groupBy("query_name").agg(F.count("*").alias("findings"), F.countDistinct("file_id").alias("files")).select(
        F.split("query_name", "\t")[0].alias("recipe"), F.split("query_name", "\t")[1].alias("query"), "findings", "files"
    )


def compare_audits(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, state): which findings are new, gone or kept against a baseline."""
    a = before.select(*key).distinct().withColumn("was", F.lit(True))
    b = after.select(*key).distinct().withColumn("now", F.lit(True))
    return a.join(b, list(key), "full").select(*key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("kept").alias("state"))
