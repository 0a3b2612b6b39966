"""F, L, S queries: predicates, lines, chunks and workspace rules on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import issues, lines, predicates
from skerry.plans import sqltext as q
from skerry.runtime import table
from skerry.schema import Index
from skerry.sources import workspace
from skerry.sources.languages import language_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def docs(ix: Index) -> DataFrame:
    return table(ix.spark, ix.root, "documents", "doc_id", "text", "lang", "source", "repo", "created_at").withColumnRenamed("doc_id", "file_id")


_P = q.folded("path")


@query("F01_path_glob", q.with_(q.FILES) + f"select file_id, path from f where {_P} like '%/src/%.py' escape '\\'")
def _(ix):
    return ix.files.where(predicates.path_matches(F.col("path"), "*/src/*.py")).select("file_id", "path")


@query("F02_path_subtree", q.with_(q.FILES) + f"select file_id, path from f where {_P} = 'tern-tools/src' or {_P} like 'tern-tools/src/%'")
def _(ix):
    return ix.files.where(predicates.path_matches(F.col("path"), "./Tern-Tools/src/")).select("file_id", "path")


@query("F03_paths_any_none", q.with_(q.FILES) + f"select file_id, path from f where ({_P} like 'tern-%' or {_P} like 'basalt-%') and not ({_P} like '%/tests/%')")
def _(ix):
    return ix.files.where(predicates.paths_filter(F.col("path"), ["tern-*", "basalt-*"], ["*/tests/*"])).select("file_id", "path")


@query("F04_paths_also", q.with_(q.FILES) + f"select file_id, path from f where {_P} like 'tern-%' and ({_P} like '%.py' or {_P} like '%.go')")
def _(ix):
    return ix.files.where(predicates.paths_filter(F.col("path"), ["tern-*"], also=["*.py", "*.go"])).select("file_id", "path")


@query("F05_exclude_tests", q.with_(q.FILES) + f"select file_id, path from f where path is not null and not {q.is_test()}")
def _(ix):
    return ix.files.where(~predicates.is_test_path(F.col("path"))).select("file_id", "path")


@query("F06_path_buckets", q.with_(q.FILES) + f"select {q.bucket()} as bucket, count(*) as files from f group by 1")
def _(ix):
    return ix.files.groupBy(predicates.path_bucket(F.col("path")).alias("bucket")).agg(F.count("*").alias("files"))


@query("F07_exclude_generated", q.with_(q.FILES) + "select lang, count(*) as files from f where not coalesce(generated, false) group by lang")
def _(ix):
    return ix.files.where(~F.coalesce("generated", F.lit(False))).groupBy("lang").agg(F.count("*").alias("files"))


@query("F08_language", q.with_(q.FILES) + "select file_id, path from f where lang = 'csharp'")
def _(ix):
    return ix.files.where(F.col("lang") == predicates.language("C#")).select("file_id", "path")


@query("F09_since", q.with_(q.FILES) + "select file_id, path from f where modified >= timestamptz '2025-04-01 00:00:00+00'")
def _(ix):
    return ix.files.where(F.col("modified") >= F.lit("2025-04-01 00:00:00").cast("timestamp")).select("file_id", "path")


@query("F10_kind_visibility", q.with_(q.SYMBOLS) + f"select symbol_id, name, {q.visibility()} as rank from s where kind in ('class', 'method') and {q.visibility()} <= 1")
def _(ix):
    rank = predicates.visibility_rank(F.col("visibility"))
    return ix.symbols.where(F.col("kind").isin("class", "method") & (rank <= 1)).select("symbol_id", "name", rank.alias("rank"))


@query("F11_path_partition", q.with_(q.FILES) + "select file_id, path from f where path in (select path from f where path is not null order by md5(path) limit 40)")
def _(ix):
    part = [r.path for r in ix.files.where("path is not null").orderBy(F.md5("path")).select("path").limit(40).collect()]  # the parts of an audit are lists that a user gives
    return ix.files.where(predicates.in_partition(F.col("path"), part)).select("file_id", "path")


_N = q.folded("name")
_MODES = {
    "exact": "name = 'ScoreWideGraphOrder'", "folded": f"{_N} = 'scorewidegraphorder'", "prefix": f"{_N} like 'score%'", "leaf": f"{q.folded("split_part(name, '.', -1)")} = 'scorewidegraphorder'", "substring": f"contains({_N}, 'graph')",
}


@query("F12_name_modes", q.with_(q.SYMBOLS) + " union all ".join(f"select '{m}' as mode, count(*) as symbols from s where {w} having count(*) > 0" for m, w in _MODES.items()))
def _(ix):
    wanted = {"exact": "ScoreWideGraphOrder", "folded": "scoreWideGraphOrder", "prefix": "Score", "leaf": "ScoreWideGraphOrder", "substring": "Graph"}
    hits = F.array_compact(F.array(*(F.when(predicates.name_matches(F.col("name"), w, m), F.lit(m)) for m, w in wanted.items())))
    return ix.symbols.select(F.explode(hits).alias("mode")).groupBy("mode").agg(F.count("*").alias("symbols"))


@query("F13_query_forms", """select distinct lower(lang) as lang, raw_symbol_name as name, case lower(lang) when 'rust' then replace(trim(raw_symbol_name), '::', '.') when 'csharp' then regexp_replace(trim(raw_symbol_name), '(^|\\.)@', '\\1', 'g')
  when 'javascript' then regexp_replace(trim(raw_symbol_name), '^(module\\.)?exports\\.', '') when 'sql' then regexp_replace(trim(raw_symbol_name), '[\\[\\]"`]', '', 'g') else trim(raw_symbol_name) end as stored from hotspot_reference_counts where raw_symbol_name is not null""")
def _(ix):
    rows = table(ix.spark, ix.root, "hotspot_reference_counts", "lang", "raw_symbol_name").where("raw_symbol_name is not null").select(F.lower("lang").alias("lang"), F.col("raw_symbol_name").alias("name")).distinct()
    return rows.select("lang", "name", predicates.normalised_names(F.col("name"), F.col("lang")).alias("stored"))


@query("F14_reference_kinds", q.with_(q.REFS) + f"select count(*) filter (where {q.CALLABLE}) as callable, count(*) filter (where {q.CALLABLE} or reference_kind = 'member_read') as with_reads, count(*) filter (where reference_kind in ('subscribe', 'unsubscribe', 'razor_event_binding')) as events from r")
def _(ix):
    k = F.col("reference_kind")
    n = lambda c: F.count(F.when(c, 1))
    return ix.refs.agg(n(predicates.kind_predicate(k)).alias("callable"), n(predicates.kind_predicate(k, member_reads=True)).alias("with_reads"), n(predicates.kind_predicate(k, "subscribe")).alias("events"))


@query("F15_graph_languages", q.with_(q.FILES) + f"select lang, count(*) as files from f where lang in {q.in_list(predicates.GRAPH_LANGUAGES)} group by lang")
def _(ix):
    return ix.files.where(F.col("lang").isin(*predicates.GRAPH_LANGUAGES)).groupBy("lang").agg(F.count("*").alias("files"))


@query("F16_evidence", q.with_(q.REFS) + "select resolution_state, reference_kind, count(*) as n from r where resolution_state in ('resolved', 'ambiguous') and reference_kind in ('call', 'instantiate') group by all")
def _(ix):
    return ix.refs.where(predicates.evidence(F.col("resolution_state"), F.col("reference_kind"), ["resolved", "ambiguous"], ["call", "instantiate"])).groupBy("resolution_state", "reference_kind").agg(F.count("*").alias("n"))


@query("F17_noise", q.with_(q.REFS) + f"select symbol_name, count(*) as n from r where lower(symbol_name) in {q.in_list(n.lower() for n in q.NOISE)} group by symbol_name")
def _(ix):
    return ix.refs.where(predicates.is_noise(F.col("symbol_name"))).groupBy("symbol_name").agg(F.count("*").alias("n"))


_LN = q.with_(q.CHUNKS, q.LINES, q.FILES)


@query("L10_lines", q.with_(q.CHUNKS, q.LINES) + "select file_id, count(*) as lines, sum(length(text)) as chars, max(line) as last from ln group by file_id")
def _(ix):
    return lines.file_lines(ix.chunks).groupBy("file_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.max("line").alias("last"))


SQL["L10_lines"] = SQL["L10_lines"].replace("sum(length(text)) as", "cast(sum(length(text)) as bigint) as")


@query("L01_find", _LN + f"""select path, {q.bucket()} as bucket, line, col as "column", text from (
  select file_id, line, text, unnest(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, 5)) = 'graph')) as col from ln where contains(lower(text), 'graph')) join f using (file_id)""")
def _(ix):
    return lines.find_literal(ix.chunks, ix.files, "Graph")


@query("L01_find_overlapping", _LN + f"""select path, {q.bucket()} as bucket, line, col as "column", text from (
  select file_id, line, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'oo')) as col from ln where contains(text, 'oo')) join f using (file_id)""")
def _(ix):
    return lines.find_literal(ix.chunks, ix.files, "oo", exact=True)


_RX = "[A-Z][a-z]+Graph[A-Z][a-z]+"


@query("L02_regex", _LN + f"select path, line, cast(k - 1 as int) as ordinal, m[k] as match from (select file_id, line, m, unnest(range(1, len(m) + 1)) as k from (select file_id, line, regexp_extract_all(text, '{_RX}') as m from ln)) join f using (file_id)")
def _(ix):
    return lines.find_regex(ix.chunks, ix.files, _RX)


@query("L03_windows", q.with_(q.CHUNKS, q.LINES) + """, w as (select file_id, line, text, lead(text) over v as b, lead(line) over v as l2, lead(line, 2) over v as l3 from ln window v as (partition by file_id order by line))
  select file_id, line, cast(length(text) as int) as "column", line + 2 as end_line, '{' || chr(10) || b || chr(10) as match from w where ends_with(text, '{') and l2 = line + 1 and l3 = line + 2 and regexp_matches(b, '^[ \\t]*return ')""")
def _(ix):
    return lines.find_windows(lines.file_lines(ix.chunks), r"\{\n[ \t]*return [^\n]*\n")


@query("L05_context", _LN + "select h.file_id, h.line as hit_line, ln.line, ln.text from (select file_id, line from ln where contains(lower(text), 'licensed under') or contains(lower(text), 'budgetprobe')) h join ln on ln.file_id = h.file_id and ln.line between h.line - 2 and h.line + 2")
def _(ix):
    held = lambda c: F.contains(F.lower(c), F.lit("licensed under")) | F.contains(F.lower(c), F.lit("budgetprobe"))
    return lines.with_context(ix.chunks, lines.matching_lines(ix.chunks, held, held).select("file_id", "line"), 2, 2)


@query("L06_resume", _LN + "select path, line from ln join f using (file_id) where contains(lower(text), 'graph') and (path, line) > ('juniper', 0) order by path, line limit 100")
def _(ix):
    ln = lines.literal_lines(ix.chunks, "graph").join(ix.files, "file_id").select("path", "line")
    return ln.where((F.col("path") > "juniper") | (F.col("path") == "juniper") & (F.col("line") > 0)).orderBy("path", "line").limit(100)


@query("L07_count", _LN + "select count(*) as lines, count(distinct file_id) as files from ln where contains(lower(text), 'graph')")
def _(ix):
    return lines.literal_lines(ix.chunks, "graph").agg(F.count("*").alias("lines"), F.countDistinct("file_id").alias("files"))


@query("L08_excerpts", q.with_(q.CHUNKS, q.LINES, q.SYMBOLS) + """select file_id, start_line, end_line, string_agg(text, chr(10) order by line) as excerpt from (
  select distinct s.file_id, s.start_line, s.end_line, ln.line, ln.text from s join ln on ln.file_id = s.file_id and ln.line between greatest(s.start_line - 1, 1) and s.end_line + 1 where s.kind = 'class') group by all""")
def _(ix):
    spans = ix.symbols.where("kind = 'class'").select("file_id", "start_line", "end_line").distinct()
    return lines.excerpts(ix.chunks, spans, 1, 1)


@query("L09_file_read", q.with_(q.CHUNKS, q.LINES) + "select file_id, string_agg(text, chr(10) order by line) as text from ln where line <= 10000 group by file_id")
def _(ix):
    return lines.file_texts(ix.chunks, 10000)


@query("X20_clamp", _LN + "select path, line, case when length(text) <= 40 then text else substr(text, greatest(1, least(spot - cast(floor((40 - 5) / 2.0) as int), length(text) - 39)), 40) end as shown from (select *, instr(lower(text), 'graph') as spot from ln where contains(lower(text), 'graph')) join f using (file_id)")
def _(ix):
    ln = lines.literal_lines(ix.chunks, "graph").withColumn("at", F.instr(F.lower("text"), "graph"))
    return ln.join(ix.files, "file_id").select("path", "line", lines.clamp_line(F.col("text"), 40, F.col("at"), F.lit(5)).alias("shown"))


# sources


_EXCLUDED = """.git .svn .hg node_modules .pnpm-store .yarn .turbo .parcel-cache .svelte-kit .nx __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox .nox .eggs htmlcov venv .venv env dist build .build
  out .cache testresults bin obj target .gradle .next .nuxt .cmake cmakefiles bazel-bin bazel-out bazel-testlogs buck-out .pants.d .bloop .metals .idea .vscode coverage vendor .terraform .cargo .pub-cache
  .dart_tool .swiftpm deriveddata .stack-work .bundle _build""".split()


@query("S02_exclusions", q.with_(q.FILES) + f"select file_id, path from f where path is not null and len(list_intersect(list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1), {_EXCLUDED})) = 0 and not regexp_matches(lower(path), '(^|/)(\\._[^/]*|\\.ds_store|thumbs\\.db)$')")
def _(ix):
    return ix.files.where(~workspace.is_excluded(F.col("path"))).select("file_id", "path")


@query("S03_ignore_rules", q.with_(q.FILES) + "select file_id, path from f where path is not null and not (path like '%.md' or path like '%/tests/%')")
def _(ix):
    return workspace.not_ignored(ix.files.where("path is not null").select("file_id", "path"), workspace.IgnoreRules(["*.md", "tests/"]))


@query("S05_size_cap", q.with_(q.FILES) + "select file_id, size, case when size > 20000 then 'too_large' end as skipped from f")
def _(ix):
    return ix.files.select("file_id", "size", workspace.size_state(F.col("size"), 20000).alias("skipped"))


@query("S06_languages", q.with_(q.FILES) + """select case when name in ('package.json', 'go.mod') then 'dependency_manifest' when name in ('package-lock.json', 'go.sum') then 'dependency_lock' when regexp_matches(name, '^dockerfile([._-].*)?$') then 'dockerfile' when regexp_matches(name, '^makefile([._-].*)?$') then 'makefile'
  else case ext when 'py' then 'python' when 'js' then 'javascript' when 'cs' then 'csharp' when 'java' then 'java' when 'go' then 'go' when 'json' then 'json' when 'md' then 'markdown' when 'ts' then 'typescript' when 'css' then 'css' when 'yml' then 'yaml' when 'yaml' then 'yaml' when 'toml' then 'toml' when 'sh' then 'shell' when 'html' then 'html' when 'mjs' then 'javascript' when 'sql' then 'sql' end end as lang, count(*) as files
  from (select lower(split_part(path, '/', -1)) as name, lower(split_part(path, '.', -1)) as ext from f where path is not null) group by 1 having lang is not null""")
def _(ix):
    return ix.files.select(language_of(F.col("path")).alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("files"))


@query("S08_normalise", "select doc_id as file_id, sha256(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '(?m)^[\\x{feff}\\x{200b}\\x{200c}\\x{200d}\\x{2060}]+', '', 'g')) as checksum from documents where text is not null")
def _(ix):
    return docs(ix).where("text is not null").select("file_id", F.sha2(workspace.normalised(F.col("text")), 256).alias("checksum"))


@query("S09_skips", "select doc_id as file_id, case when contains(text, chr(0)) then 'binary' when starts_with(text, 'version https://git-lfs') then 'lfs_pointer' end as skipped from documents where text is not null")
def _(ix):
    return docs(ix).where("text is not null").select("file_id", workspace.content_state(F.col("text")).alias("skipped"))


@query("S10_generated", q.with_(q.FILES) + """, h as (select file_id, bool_or(list_bool_or(list_transform(list_slice(string_split(lower(left(content, 16384)), chr(10)), 1, 20), lambda x: contains(x, '<auto-generated') or contains(x, '@generated') or contains(x, 'generated by') and contains(x, 'do not edit')))) as says from chunks where start_line = 1 and content is not null group by file_id)
  select f.file_id, path from f left join h using (file_id) where coalesce(says, false) or regexp_matches(lower(path), '(\\.designer\\.cs|\\.generated\\.cs|\\.g\\.cs|\\.g\\.dart|\\.gen\\.go|\\.generated\\.ts|_pb\\.go|_pb2\\.py)$')""")
def _(ix):
    heads = ix.chunks.where("start_line = 1 and content is not null").groupBy("file_id").agg(F.max(workspace.has_generated_head(F.col("content"))).alias("says"))
    rows = ix.files.join(heads, "file_id", "left")
    return rows.where(F.coalesce("says", F.lit(False)) | workspace.has_generated_name(F.col("path"))).select("file_id", "path")


@query("S11_chunks", """with t as (select doc_id as file_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) as l from documents where text is not null and text <> ''),
  k as (select file_id, l, unnest(range(0, greatest(len(l) - 11, 0) + 1, 70)) as s from t where not list_bool_or(list_transform(l, lambda x: length(x) > 65536)))
  select file_id, cast(s // 70 as int) as chunk_index, cast(s + 1 as int) as start_line, cast(least(s + 80, len(l)) as int) as end_line, array_to_string(list_slice(l, s + 1, s + 80), chr(10)) as content from k""")
def _(ix):
    return workspace.chunk_texts(docs(ix))


SQL["S11_chunks"] = SQL["S11_chunks"].replace("regexp_replace(text, '\\n\\z', '')", "case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end")


@query("S12_changed", q.with_(q.FILES) + """, n as (select distinct path, checksum from file_scan where path is not null)
  select n.path, n.checksum from n left join f on f.path = n.path where n.checksum is distinct from f.checksum""")
def _(ix):
    scan = table(ix.spark, ix.root, "file_scan", "path", "checksum").where("path is not null").distinct()
    return workspace.changed_since(scan, ix.files)


@query("S13_vanished", q.with_(q.FILES) + "select file_id, path from f where path is not null and not exists (select 1 from file_scan x where x.path = f.path)")
def _(ix):
    return workspace.vanished(ix.files.where("path is not null"), table(ix.spark, ix.root, "file_scan", "path").where("path is not null")).select("file_id", "path")


@query("S16_members", q.with_(q.SYMBOLS) + ", t as (select distinct " + ", ".join(["symbol_id", "name", "kind"]) + " from symbols_right) select workspace, kind, count(*) as n from (select 'left' as workspace, kind from s union all select 'right', kind from t) group by all")
def _(ix):
    right = table(ix.spark, ix.root, "symbols_right", "symbol_id", "name", "kind").distinct()
    return workspace.union_members({"left": ix.symbols.select("symbol_id", "name", "kind"), "right": right}).groupBy("workspace", "kind").agg(F.count("*").alias("n"))


# issues


_ISSUES = {
    "replacement_char": "contains(text, chr(65533))", "bom": "line = 1 and starts_with(text, chr(65279))", "null_byte": "contains(text, chr(0))", "line_too_long": "length(text) > 65536",
    "fts_token_too_long": "regexp_matches(text, '[A-Za-z0-9_]{513}')", "conflict_markers": "regexp_matches(text, '^(<<<<<<< |>>>>>>> |=======$)')", "lfs_pointer_skipped": "line = 1 and starts_with(text, 'version https://git-lfs')",
}


@query("A32_issues", q.with_(q.CHUNKS, q.LINES) + " union all ".join(f"select file_id, '{k}' as kind, line from ln where {w}" for k, w in _ISSUES.items()))
def _(ix):
    return issues.content_issues(ix.chunks)


@query("A31_issue_counts", q.with_(q.CHUNKS, q.LINES) + "select kind, case when kind in ('line_too_long', 'fts_token_too_long') then 'content_limit' when kind = 'conflict_markers' then 'content_structure' when kind = 'replacement_char' then 'decoding_risk' when kind = 'bom' then 'byte_order_mark' when kind = 'null_byte' then 'raw_bytes' else 'other' end as category, count(*) as issues, count(distinct file_id) as files from (" + " union all ".join(f"select file_id, '{k}' as kind from ln where {w}" for k, w in _ISSUES.items()) + ") group by kind")
def _(ix):
    return issues.issue_counts(issues.content_issues(ix.chunks)).select("kind", issues.category(F.col("kind")).alias("category"), "issues", "files")


@query("A32_text_issues", """with t as (select doc_id, text, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as crlf, length(text) - length(replace(text, chr(13), '')) as crs, length(text) - length(replace(text, chr(10), '')) as lfs from documents where text is not null),
  u as (select *, crs - crlf as cr, lfs - crlf as lf from t), e as (select *, (crlf > 0)::int + (cr > 0)::int + (lf > 0)::int as ends from u)
  select doc_id, case when ends = 3 then 'mixed_line_endings_three_way' else 'mixed_line_endings' end as kind, cast(crlf + cr + lf as int) as n from e where ends > 1 union all select doc_id, 'cr_only_line_endings', cast(cr as int) from e where ends = 1 and cr > 0
  union all select doc_id, 'replacement_char', cast(length(text) - length(replace(text, chr(65533), '')) as int) from e where contains(text, chr(65533)) union all select doc_id, 'null_byte', cast(length(text) - length(replace(text, chr(0), '')) as int) from e where contains(text, chr(0)) union all select doc_id, 'bom', 1 from e where starts_with(text, chr(65279))""")
def _(ix):
    return issues.text_issues(table(ix.spark, ix.root, "documents", "doc_id", "text"))


@query("A32_suppressed", q.with_(q.FILES) + f"select file_id, 'generated_code_extraction_skipped' as kind, 0 as line from f where {_P} like '%/%.min.js' or {_P} like '%/gen/%'")
def _(ix):
    return issues.suppressed_extraction(ix.files, ["*.min.js", "*/gen/*"])
