"""X queries: full-text search, its ranking, guards and facets."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from skerry.operators import lines, predicates, search
from skerry.operators.index import SearchIndex
from skerry.plans import sqltext as q
from skerry.runtime import checkpoint_dir, table
from skerry.schema import Index

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_WORDS = q.CHUNKS + f",\nw as (select chunk_id, file_id, start_line, content, {_TOKENS} as words from c)"


@query("X00_postings", q.with_(_WORDS) + "select term, count(*) as chunks, cast(sum(tf) as bigint) as tf from (select chunk_id, file_id, term, count(*) as tf from (select chunk_id, file_id, unnest(words) as term from w) group by all) group by term")
def _(ix):
    return search.postings(ix.chunks).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


def _bm25(terms: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(words, lambda t: t = '{t}')) as tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    held = " and ".join(f"tf{i} > 0" for i in range(len(terms)))
    return q.with_(_WORDS, f"t as (select chunk_id, file_id, len(words) as length, {counts} from w)", f"st as (select count(*) as n, avg(length) as mean, {dfs} from t)") + f"select chunk_id, file_id, round({score}, 6) as bm25 from t, st where {held}"


@query("X01_search", _bm25(["return", "key"]))
def _(ix):
    return search.search_all(ix.chunks, "return key")


_RANKED = _bm25(["rank"]).replace("select chunk_id, file_id, round(", "select chunk_id, file_id, round(", 1)


@query(
    "X02_ranked",
    _bm25(["rank"]).rsplit("select chunk_id, file_id, round(", 1)[0].rstrip() + ",\nh as (select chunk_id, file_id, round(" + _bm25(["rank"]).rsplit("select chunk_id, file_id, round(", 1)[1] + "),\n" + q.FILES + ",\n" + q.SYMBOLS + f""",
  n as (select file_id, {q.folded('name')} as n, coalesce(start_line, line) as at_line from s),
  g as (select h.*, w.start_line, w.start_line + len(string_split(content, chr(10))) - 1 as end_line, content, path from h join w using (chunk_id) join f on f.file_id = h.file_id),
  b as (select path, chunk_id,
    case when exists (select 1 from n where n.file_id = g.file_id and n.n = 'rank' and at_line between g.start_line and g.end_line) then 0 when exists (select 1 from n where n.file_id = g.file_id and n.n = 'rank') then 1 else 2 end as symbol_bucket,
    case when exists (select 1 from n where n.file_id = g.file_id and starts_with(n.n, 'rank') and at_line between g.start_line and g.end_line) then 0 when exists (select 1 from n where n.file_id = g.file_id and starts_with(n.n, 'rank')) then 1 else 2 end as prefix_bucket,
    case when contains(lower(content), 'rank') then 0 else 1 end as text_match, {q.bucket()} as bucket, bm25 from g)
  select *, cast(row_number() over (order by symbol_bucket, prefix_bucket, text_match, bucket, bm25 desc, path, chunk_id) as int) as rank from b order by rank limit 50""",
)
def _(ix):
    return search.search_ranked(ix.chunks, ix.files, ix.symbols, "rank", 50)


@query("X03_raw_query", q.with_(_WORDS) + "select chunk_id, file_id from w where (list_contains(words, 'return') or list_contains(words, 'raise')) and not list_contains(words, 'class') and len(list_filter(words, lambda t: starts_with(t, 'rank'))) > 0")
def _(ix):
    return search.raw_search(ix.chunks, "(return OR raise) AND rank* NOT class")


@query("X03_phrase_near", q.with_(_WORDS) + """select chunk_id, file_id from w where len(list_filter(range(1, len(words)), lambda i: words[i] = 'return' and words[i + 1] = 'key')) > 0
  or len(list_filter(range(1, len(words) + 1), lambda i: words[i] = 'rank' and list_contains(list_slice(words, greatest(1, i - 4), i + 4), 'log'))) > 0""")
def _(ix):
    return search.raw_search(ix.chunks, '"return key" OR NEAR(rank log, 3)')


@query("X03_columns", q.with_(_WORDS) + "select chunk_id, file_id from w where list_contains(words, 'return') and len(list_filter(words, lambda t: starts_with(t, 'rank'))) > 0")
def _(ix):
    return search.raw_search(ix.chunks, "content:return AND content: rank*")


@query("X04_exact", q.with_(q.CHUNKS) + "select chunk_id, file_id from c where contains(content, 'return key')")
def _(ix):
    return search.exact_substring(ix.chunks, "return key")


@query("X05_token_boundary", q.with_(q.CHUNKS) + "select chunk_id, file_id from c where regexp_matches(content, '(^|[^A-Za-z0-9_])log([^A-Za-z0-9_]|$)')")
def _(ix):
    return search.token_boundary(ix.chunks, "log")


@query("X06_prefix", q.with_(_WORDS) + "select chunk_id, file_id from w where len(list_filter(words, lambda t: starts_with(t, 'ledg'))) > 0")
def _(ix):
    return search.search_all(ix.chunks, "ledg", prefix=True).drop("bm25")


@query("X07_long_tokens", q.with_(q.CHUNKS) + "select chunk_id, file_id from c where contains(lower(content), '3f') and file_id in (select file_id from c where regexp_matches(content, '[A-Za-z0-9_]{513}'))")
def _(ix):
    return search.long_token_hits(ix.chunks, "3F")


_LN = q.with_(q.CHUNKS, q.LINES, q.FILES, q.SYMBOLS)


@query("X08_line_hits", _LN + "select path, line, text from ln join f using (file_id) where contains(lower(text), 'log.info')")
def _(ix):
    return search.line_hits(ix.chunks, "Log.Info").join(ix.files, "file_id").select("path", "line", "text")


@query("X09_advice", q.with_(q.REFS) + """, c as (select distinct trim(context) as query from r where context is not null), m as (select query, length(regexp_replace(query, '[^(){}\\[\\];=<>.:&|!+\\-*/%]', '', 'g')) as marks, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') as words from c)
  select query, marks >= 2 or list_has_any(words, ['=>', '->', '::', '==', '!=', '&&', '||']) or (len(words) > 1 and words[1] in ('class', 'def', 'function', 'func', 'public', 'private', 'static', 'return', 'import', 'using', 'namespace', 'new', 'await', 'async') and regexp_full_match(words[2], '[A-Za-z_]\\w*')) as exact from m""")
def _(ix):
    return search.advised(ix.raw_refs.where("context is not null").select(F.trim("context").alias("query")).distinct())


@query("X10_phrase_first", q.with_(q.CHUNKS) + "select chunk_id, file_id, case when contains(content, 'return key;') then 0 else 1 end as rank from c where contains(lower(content), 'return') and contains(lower(content), 'key')")
def _(ix):
    return search.phrase_first(ix.chunks, "return key;")


def _guard(lo: int, hi: int, need: str) -> str:
    return _LN + f"select h.file_id, h.line from ln h where contains(lower(h.text), 'return') and {need} exists (select 1 from ln g where g.file_id = h.file_id and contains(lower(g.text), 'if') and h.line between g.line + {lo} and g.line + {hi})"


for _name, _side, _window, _lo, _hi, _need in (("X12_require_before", "before", 3, 1, 3, True), ("X12_reject_after", "after", 5, -5, -1, False), ("X12_same_line", "same", 0, 0, 0, False)):

    @query(_name, _guard(_lo, _hi, "" if _need else "not"))
    def _(ix, side=_side, window=_window, need=_need):
        return search.guarded(search.line_hits(ix.chunks, "return"), ix.chunks, "if", window, side, need).select("file_id", "line")


_INNER = """, e as (select file_id, line, symbol_id, symbol_line from (select h.file_id, h.line, s.symbol_id, s.start_line as symbol_line, row_number() over (partition by h.file_id, h.line order by s.end_line - s.start_line, -s.start_line, symbol_id) as k
    from h join s on s.file_id = h.file_id and s.end_line >= s.start_line and h.line between s.start_line and s.end_line) where k = 1)"""
_SAME = _LN + ", h as (select file_id, line, contains(lower(text), 'return') as hit, contains(lower(text), 'if') as guard from ln where contains(lower(text), 'return') or contains(lower(text), 'if'))" + _INNER


@query("X12_same_symbol", _SAME + " select h.file_id, h.line from h join e using (file_id, line) where hit and exists (select 1 from h g join e x using (file_id, line) where g.guard and g.file_id = h.file_id and x.symbol_id = e.symbol_id and g.line < h.line)")
def _(ix):
    return search.guarded_in_symbol(search.line_hits(ix.chunks, "return"), ix.chunks, "if", ix.symbols)


@query("X12_not_in_symbol", _SAME + " select h.file_id, h.line from h left join e using (file_id, line) where hit and not exists (select 1 from h g join e x using (file_id, line) where g.guard and g.file_id = h.file_id and x.symbol_id = e.symbol_id and g.line > h.line)")
def _(ix):
    return search.guarded_in_symbol(search.line_hits(ix.chunks, "return"), ix.chunks, "if", ix.symbols, "after", False)


@query("X14_budget", _guard(1, 8, "").replace("'return'", "'ledger'"))
def _(ix):
    return search.guarded_whole(search.line_hits(ix.chunks, "ledger"), ix.chunks, "if", 8, 100_000)


_BARE = r"""regexp_replace(left(text, col - 1), '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`[^`]*`', '', 'g')"""
_ORIGIN = r"""case when lang is null then 'unknown' when lang in ('javascript', 'typescript', 'java', 'csharp', 'go', 'c', 'cpp', 'rust', 'kotlin', 'swift') and (contains(bare, '//') or contains(bare, '/*') or regexp_matches(ltrim(text), '^(/\*|\*)'))
  or lang in ('python', 'shell', 'ruby', 'yaml') and contains(bare, '#') then 'comment' when regexp_matches(bare, '["''`]') then 'string_literal' else 'code' end"""


@query("X15_origins", _LN + f", h as (select path, line, text, lang, instr(lower(text), 'ledger') as col from ln join f using (file_id) where contains(lower(text), 'ledger')), b as (select *, {_BARE} as bare from h) select path, line, {_ORIGIN} as origin from b")
def _(ix):
    hits = search.line_hits(ix.chunks, "ledger").join(ix.files.select("file_id", "path", "lang"), "file_id")
    return hits.select("path", "line", search.origin_of(F.col("lang"), F.col("text"), F.instr(F.lower("text"), "ledger")).alias("origin"))


@query("X16_code_only", _LN + f", h as (select path, line, text, lang, unnest(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, 6)) = 'ledger')) as col from ln join f using (file_id) where lang = 'python' and contains(lower(text), 'ledger')), b as (select *, {_BARE} as bare from h) select distinct path, line from b where {_ORIGIN} = 'code'")
def _(ix):
    hits = search.line_hits(ix.chunks, "ledger").join(ix.files.where("lang = 'python'").select("file_id", "path", "lang"), "file_id")
    places = hits.withColumn("at", F.explode(lines.positions(F.lower("text"), "ledger")))
    return places.where(search.origin_of(F.col("lang"), F.col("text"), F.col("at")) == "code").select("path", "line").distinct()


@query("X17_kinds", _LN + ", h as (select distinct file_id, line, instr(text, 'Ledger') as col, text from ln where contains(text, 'Ledger'))" + _INNER + """
  , g as (select h.file_id, path, h.line, text, symbol_line, left(text, col - 1) as pre from h join f using (file_id) left join e using (file_id, line) where lang = 'go'),
  o as (select *, regexp_replace(pre, '"(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*''|`[^`]*`', '', 'g') as bare from g),
  k as (select *, case when contains(bare, '//') or regexp_matches(bare, '/\\*') or regexp_matches(ltrim(text), '^(/\\*|\\*)') then 'comment' when regexp_matches(bare, '["''`]') then 'string_literal' else 'code' end as origin from o)
  select path, line, array_to_string(list_sort(list_filter([origin, case when origin = 'code' then 'identifier' end, case when symbol_line = line then 'declaration' end, case when origin = 'code' and symbol_line is distinct from line and contains(text, 'Ledger(') then 'call_site' end], lambda x: x is not null)), ',') as kinds from k""")
def _(ix):
    hits = lines.literal_lines(ix.chunks, "Ledger", exact=True).select("file_id", "line", "text", F.instr("text", "Ledger").alias("column"))
    rows = search.enclosing_symbols(hits, ix.symbols).join(ix.files.where("lang = 'go'").select("file_id", "path", "lang"), "file_id")
    return search.result_kinds(rows, "Ledger").select("path", "line", F.array_join("kinds", ",").alias("kinds"))


@query("X18_likely_tests", q.with_(q.FILES) + f"select file_id, path from f where regexp_matches(lower(path), '{predicates.LIKELY_TEST}')")
def _(ix):
    return ix.files.where(predicates.is_likely_test_path(F.col("path"))).select("file_id", "path")


@query("X19_snippets", _LN + """select h.file_id, h.line, string_agg(n.text, chr(10) order by n.line) as snippet from (select file_id, line from ln where contains(lower(text), 'log.info')) h
  join ln n on n.file_id = h.file_id and n.line between h.line - 3 and h.line + 4 group by all""")
def _(ix):
    hits = search.line_hits(ix.chunks, "log.info").select("file_id", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return lines.excerpts(ix.chunks, hits, 3, 4).select("file_id", F.col("start_line").alias("line"), F.col("excerpt").alias("snippet"))


@query("X21_count_by_file", _LN + "select path, count(*) as n from ln join f using (file_id) where contains(lower(text), 'return') group by path order by n desc, path limit 100")
def _(ix):
    hits = search.line_hits(ix.chunks, "return").join(ix.files, "file_id")
    return hits.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(100)


_FOUND = _LN + ", h as (select f.file_id, path, lang, line from ln join f using (file_id) where contains(lower(text), 'ledger'))"
_BY = {"path": "path", "directory": "left(path, length(path) - length(split_part(path, '/', -1)) - 1)", "extension": "case when contains(split_part(path, '/', -1), '.') then lower(split_part(path, '.', -1)) end", "language": "lang", "repository": "split_part(path, '/', 1)"}


@query("X21_counted", _FOUND + " union all ".join(f" select '{m}' as mode, {e} as key, count(*) as hits, count(distinct file_id) as files from h group by {e}" for m, e in _BY.items()))
def _(ix):
    hits = search.line_hits(ix.chunks, "ledger").join(ix.files.select("file_id", "path", "lang"), "file_id")
    parts = [search.counted(hits, m).select(F.lit(m).alias("mode"), "key", "hits", "files") for m in _BY]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("X21_by_symbol", _LN + ", h as (select distinct file_id, line from ln where contains(lower(text), 'ledger'))" + _INNER + """ select case when s.name is not null then concat_ws(' ', s.kind, s.name) end as key, count(*) as hits, count(distinct h.file_id) as files
  from h left join e using (file_id, line) left join (select distinct symbol_id, name, kind from s) s using (symbol_id) group by 1""")
def _(ix):
    return search.counted(search.enclosing_symbols(search.line_hits(ix.chunks, "ledger").select("file_id", "line"), ix.symbols), "symbol")


@query("X19_focus", _LN + ", z as (select file_id, max(line) as last from ln group by file_id), h as (select file_id, line, last from ln join z using (file_id) where contains(lower(text), 'log.info'))" + " union all ".join(
    f" select file_id, line, '{m}' as focus, greatest(least(line - {b}, last - 7), 1) as start_line, least(greatest(least(line - {b}, last - 7), 1) + 7, last) as end_line from h" for m, b in (("start", 0), ("center", 3), ("end", 7))
))
def _(ix):
    last = ix.chunks.where("content is not null").groupBy("file_id").agg(F.max(F.col("start_line") + F.size(F.split("content", "\n", -1)) - 1).alias("last"))
    hits = search.line_hits(ix.chunks, "log.info").select("file_id", "line").join(last, "file_id")
    modes = []
    for m in ("start", "center", "end"):
        start, end = search.focused(F.col("line"), F.col("last"), 8, m)
        modes.append(hits.select("file_id", "line", F.lit(m).alias("focus"), start.alias("start_line"), end.alias("end_line")))
    return functools.reduce(lambda a, b: a.unionByName(b), modes)


@query("X22_first_per_file", _LN + "select path, line from (select path, line, row_number() over (partition by path order by line) as k from ln join f using (file_id) where contains(lower(text), 'return')) where k <= 2")
def _(ix):
    hits = search.line_hits(ix.chunks, "return").join(ix.files, "file_id").withColumn("column", F.lit(1))
    return search.first_per_file(hits, 2).select("path", "line")


_UNITS = lambda c: f"list_concat(list_transform(string_split({c}, ''), lambda x: unicode(x)::uhugeint), [255::uhugeint])"  # noqa: E731 - paths and numbers are ASCII


@query("X22_sample", _LN + f""", h as (select path, line, row_number() over (order by path, line) - 1 as place from ln join f using (file_id) where contains(lower(text), 'return')),
  k as (select path, line, place, list_reduce(list_concat([14695981039346656037::uhugeint], {_UNITS('path')}, {_UNITS('line::varchar')}, {_UNITS('place::varchar')}), lambda a, c: xor(a, c) * 1099511628211::uhugeint % 18446744073709551616::uhugeint) as key from h)
  select path, line from k order by key, place limit 50""")
def _(ix):
    hits = search.line_hits(ix.chunks, "return").join(ix.files.select("file_id", "path"), "file_id").select("path", "line")
    return search.sample_hits(hits, 50, ["path", "line"], ["path", "line"])


_NAMED = {"logs": "log", "returns": "return", "loops": "while"}


@query("X23_named", _LN + " union all ".join(f"select '{n}' as query_name, file_id, line from ln where contains(lower(text), '{t}')" for n, t in _NAMED.items()))
def _(ix):
    return search.named_queries(ix.chunks, _NAMED).select("query_name", "file_id", "line")


@query("X24_audit", _LN + "select recipe, query, count(*) as findings, count(distinct file_id) as files from (" + " union all ".join(f"select '{r}' as recipe, '{t}' as query, file_id from ln where contains(lower(text), '{t}')" for r, ts in search.RECIPES.items() for t in ts) + ") group by all")
def _(ix):
    return search.audit(ix.chunks)


@query("X24_baseline", "with a as (select distinct symbol_id from symbols), b as (select distinct symbol_id from symbols_right) select coalesce(a.symbol_id, b.symbol_id) as symbol_id, case when a.symbol_id is null then 'new' when b.symbol_id is null then 'gone' else 'kept' end as state from a full join b on a.symbol_id = b.symbol_id")
def _(ix):
    return search.compare_audits(ix.symbols, table(ix.spark, ix.root, "symbols_right", "symbol_id"), ["symbol_id"])


@query("X26_enclosing", _LN + """, h as (select distinct file_id, line from ln where contains(lower(text), 'ledger')),
  e as (select h.file_id, h.line, s.name, s.kind, row_number() over (partition by h.file_id, h.line order by s.end_line - s.start_line, -s.start_line, symbol_id) as k from h join s on s.file_id = h.file_id and s.end_line >= s.start_line and h.line between s.start_line and s.end_line)
  select h.file_id, h.line, e.name as symbol_name, e.kind as symbol_kind from h left join e on e.file_id = h.file_id and e.line = h.line and e.k = 1""")
def _(ix):
    hits = search.line_hits(ix.chunks, "ledger").select("file_id", "line").distinct()
    return search.enclosing_symbols(hits, ix.symbols).select("file_id", "line", "symbol_name", "symbol_kind")


def _stored(ix) -> SearchIndex:
    return SearchIndex(ix.spark, f"{checkpoint_dir(ix.spark)}/skerry-index-{uuid.uuid4().hex}")


@query("K02_stored_search", SQL["X01_search"])
def _(ix):
    return _stored(ix).write_postings(ix.chunks).search("return key")


@query("K02_stored_ranked", SQL["X02_ranked"])
def _(ix):
    return _stored(ix).write_postings(ix.chunks).ranked("rank", ix.chunks, ix.files, ix.symbols, 50)


@query("K02_stored_prefix", SQL["X06_prefix"])
def _(ix):
    return _stored(ix).write_postings(ix.chunks).search("ledg", prefix=True).drop("bm25")


@query("L04_indexed_find", _LN + "select path, line, text from ln join f using (file_id) where contains(lower(text), 'log.info')")
def _(ix):
    return _stored(ix).write_trigrams(ix.chunks).literal_lines(ix.chunks, "Log.Info").join(ix.files, "file_id").select("path", "line", "text")
