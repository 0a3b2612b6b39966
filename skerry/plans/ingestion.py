"""N, E, W queries and the rest of A and G: scalar functions, extractors, watching, language edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import names
from skerry.operators import edges, graph, lines
from skerry.operators.incremental import new_or_changed
from skerry.plans import sqltext as q
from skerry.plans import training_data
from skerry.runtime import table
from skerry.schema import IMPACT_KINDS, Index
from skerry.sources import extractors, projects
from skerry.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _hot(ix: Index) -> DataFrame:
    return table(ix.spark, ix.root, "hotspot_reference_counts", "raw_symbol_name").where("raw_symbol_name is not null").distinct()


_RAW = "with h as (select distinct raw_symbol_name as n from hotspot_reference_counts where raw_symbol_name is not null)\n"


@query("N01_name_fold", q.with_(q.SYMBOLS) + "select distinct name, lower(name) as folded from s where name is not null")
def _(ix):
    return ix.symbols.where("name is not null").select("name").distinct().select("name", names.fold_name(F.col("name")).alias("folded"))


@query("N02_leaf_name", _RAW + "select n as name, split_part(n, '.', -1) as leaf, lower(split_part(n, '.', -1)) as leaf_folded from h")
def _(ix):
    leaf = names.leaf_name(F.col("raw_symbol_name"))
    return _hot(ix).select(F.col("raw_symbol_name").alias("name"), leaf.alias("leaf"), F.lower(leaf).alias("leaf_folded"))


@query("N03_segments", _RAW + "select n as name, cast(len(string_split(n, '.')) as int) as segments, n as normalized from h")
def _(ix):
    n = F.col("raw_symbol_name")
    return _hot(ix).select(n.alias("name"), names.segment_count(n).alias("segments"), names.normalized_name(n).alias("normalized"))


@query("N04_line_at", q.with_(q.CHUNKS) + "select chunk_id, string_split(content, chr(10))[3] as text from c where len(string_split(content, chr(10))) >= 3")
def _(ix):
    from skerry.operators.search import distinct_chunks

    rows = distinct_chunks(ix.chunks).select("chunk_id", names.line_at(F.col("content"), F.col("start_line"), F.col("start_line") + 2).alias("text"))
    return rows.where("text is not null")


@query("N05_heading_slugs", q.with_(q.SYMBOLS) + "select distinct name, regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') as slug from s where kind = 'heading' and name is not null")
def _(ix):
    return ix.symbols.where("kind = 'heading' and name is not null").select("name", names.heading_slug(F.col("name")).alias("slug")).distinct()


@query("N06_context_has_name", q.with_(q.REFS) + "select ref_id from r where context is not null and symbol_name is not null and regexp_matches(context, '(^|[^A-Za-z0-9_])' || symbol_name || '([^A-Za-z0-9_]|$)')")
def _(ix):
    rows = ix.refs.where("context is not null and symbol_name is not null")
    return rows.where(names.context_has_name(F.col("context"), F.col("symbol_name"))).select("ref_id")


_INNER = r"""regexp_extract(context, '\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1)"""
_BARE = rf"""regexp_replace(regexp_replace({_INNER}, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', 's', 'g'), '\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\{{[^}}]*\}}|<[^<>]*>', '', 'g')"""


@query("N07_argument_counts", q.with_(q.REFS) + f"select ref_id, cast(case when not contains(context, '(') then null when trim({_INNER}) = '' then 0 else len(string_split({_BARE}, ',')) end as int) as arguments from r where context is not null")
def _(ix):
    return ix.refs.where("context is not null").select("ref_id", names.argument_count(F.col("context")).alias("arguments"))


_LISTED = r"regexp_extract(signature, '(?s)\b(?:class|struct|interface|record)\s+\w+\s*<(.*)', 1)"


@query("N08_type_arity", q.with_(q.SYMBOLS) + f"""select symbol_id, cast(case when {_LISTED} = '' or regexp_matches({_LISTED}, '^\\s*>') then 0 else length(own) - length(replace(own, ',', '')) + 1 end as int) as arity
  from (select *, split_part(regexp_replace(regexp_replace({_LISTED}, '[=-]>', '', 'g'), '<[^<>]*>|\\([^()]*\\)', '', 'g'), '>', 1) as own from s) where kind in ('class', 'struct') and signature is not null""")
def _(ix):
    rows = ix.symbols.where("kind in ('class', 'struct') and signature is not null")
    return rows.select("symbol_id", names.type_arity(F.col("signature")).alias("arity"))


@query("N09_verbatim", _RAW + "select n as name, regexp_replace(n, '(^|\\.)@', '\\1', 'g') as plain from h")
def _(ix):
    return _hot(ix).select(F.col("raw_symbol_name").alias("name"), names.without_verbatim(F.col("raw_symbol_name")).alias("plain"))


def _paths(ix: Index) -> DataFrame:
    return ix.files.where("path is not null").select(F.col("path").alias("source"), F.substring_index("path", "/", -1).alias("leaf")).distinct()


_PARTS = q.with_(q.FILES) + ", p as (select distinct path as source, split_part(path, '/', -1) as leaf, string_split(path, '/') as parts from f where path is not null), b as (select *, list_slice(parts, 1, len(parts) - 1) as dir, list_slice(parts, 1, len(parts) - 2) as up from p)\n"
_JOIN = lambda dirs, tail: f"array_to_string(list_concat({dirs}, {tail}), '/')"


@query("N10_links", _PARTS + " union all ".join(
    f"select source, {link} as link, {path} as path from b"
    for link, path in (
        ("'../' || leaf || '#x'", _JOIN("up", "[leaf]")), ("'c/./' || leaf", _JOIN("dir", "['c', leaf]")), ("'#' || leaf", "source"), ("'/' || leaf || '?q'", "leaf"), ("'https://x.y/' || leaf", "null"), ("'../../../../../../../../' || leaf", "null"),
    )
))
def _(ix):
    leaf = F.col("leaf")
    forms = F.array(F.concat(F.lit("../"), leaf, F.lit("#x")), F.concat(F.lit("c/./"), leaf), F.concat(F.lit("#"), leaf), F.concat(F.lit("/"), leaf, F.lit("?q")), F.concat(F.lit("https://x.y/"), leaf), F.concat(F.lit("../../../../../../../../"), leaf))
    return _paths(ix).select("source", F.explode(forms).alias("link")).select("source", "link", names.resolve_links("source", "link").alias("path"))


@query("N11_imports", _PARTS + " union all ".join(f"select source, '{m}' as module, {path} as path from b" for m, path in ((".edge", _JOIN("dir", "['edge']")), ("..x.y", _JOIN("up", "['x', 'y']")), ("os.path", "'os/path'"), (".", "array_to_string(dir, '/')"))))
def _(ix):
    modules = F.array(*(F.lit(m) for m in (".edge", "..x.y", "os.path", ".")))
    return _paths(ix).select("source", F.explode(modules).alias("module")).select("source", "module", names.import_targets("module", "source").alias("path"))


# extractors on the texts of the files


def _texts(ix: Index) -> DataFrame:
    """(file_id, path, lang, text): one row for each file, its chunks put together."""
    return lines.file_texts(ix.chunks).join(ix.files.select("file_id", "path", "lang"), "file_id").select("file_id", "path", "lang", "text")


@query("E01_symbols")
def _(ix):
    return extractors.extract_symbols(_texts(ix)).select("file_id", "kind", "name", "line", "end_line", "container_name")


@query("E02_go_types", q.with_(q.CHUNKS, q.LINES, q.FILES) + "select file_id, regexp_extract(text, '^type\\s+(\\w+)\\s+struct', 1) as name, line from ln join f using (file_id) where lang = 'go' and regexp_matches(text, '^type\\s+\\w+\\s+struct\\b')")
def _(ix):
    rows = extractors.extract_symbols(_texts(ix).where("lang = 'go'"))
    return rows.where("kind = 'struct'").select("file_id", "name", "line")


@query("E03_python_functions", q.with_(q.CHUNKS, q.LINES, q.FILES) + "select file_id, regexp_extract(text, '^\\s*(async\\s+)?def\\s+(\\w+)', 2) as name, line from ln join f using (file_id) where lang = 'python' and regexp_matches(text, '^\\s*(async\\s+)?def\\s+\\w+')")
def _(ix):
    rows = extractors.extract_symbols(_texts(ix).where("lang = 'python'"))
    return rows.where("kind in ('function', 'method') and signature like '%def %'").select("file_id", "name", "line")


@query("E04_headings", q.with_(q.CHUNKS, q.LINES, q.FILES) + "select file_id, regexp_extract(text, '^#{1,6}\\s+(.+?)\\s*#*$', 1) as name, line from ln join f using (file_id) where lang = 'markdown' and regexp_matches(text, '^#{1,6}\\s+.+')")
def _(ix):
    return extractors.extract_symbols(_texts(ix).where("lang = 'markdown'")).select("file_id", "name", "line")


@query("E05_references")
def _(ix):
    texts = _texts(ix)
    rows = extractors.extract_references(texts, extractors.extract_symbols(texts))
    return rows.select("file_id", "symbol_name", "reference_kind", "line", "column_number", "container_name", "resolution_state")


# edges of single languages


@query("A02_metadata_edges")
def _(ix):
    return edges.metadata_edges(ix.symbols, ix.files, ix.chunks)


_IMPORT = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"


@query("A03_import_edges", q.with_(q.CHUNKS, q.LINES, q.FILES) + f""", i as (select distinct path, coalesce(nullif(regexp_extract(text, '{_IMPORT}', 1), ''), regexp_extract(text, '{_IMPORT}', 2)) as module from ln join f using (file_id) where lang = 'python' and regexp_matches(text, '{_IMPORT}')),
  d as (select *, length(module) - length(ltrim(module, '.')) as dots, ltrim(module, '.') as rest, string_split(path, '/') as parts from i),
  k as (select path, module, case when dots = 0 then replace(module, '.', '/') else array_to_string(list_concat(list_slice(parts, 1, len(parts) - dots), case when rest = '' then [] else string_split(rest, '.') end), '/') end as stem from d),
  t as (select path as target, regexp_replace(path, '(/__init__)?\\.py$', '') as stem from f where lang = 'python' and path is not null)
  select path as src_path, module, target from k left join t using (stem)""")
def _(ix):
    return edges.import_edges(_texts(ix), ix.files)


@query("A04_link_edges")
def _(ix):
    return edges.link_edges(_texts(ix), ix.files)


@query("A11_complete", q.with_(q.FILES, q.CHUNKS) + "select count(*) filter (where not exists (select 1 from c where c.file_id = f.file_id)) = 0 as complete, count(*) as files from f")
def _(ix):
    held = ix.chunks.where("content is not null").select("file_id").distinct().withColumn("held", F.lit(True))
    return ix.files.join(held, "file_id", "left").agg((F.count(F.when(F.col("held").isNull(), 1)) == 0).alias("complete"), F.count("*").alias("files"))


@query("A36_omissions", q.with_(q.CHUNKS, q.LINES) + "select count(distinct file_id) as files, max(length(text)) as longest from ln where length(text) > 4000")
def _(ix):
    ln = lines.matching_lines(ix.chunks, lambda t: F.length(t) > 4000)
    return ln.agg(F.countDistinct("file_id").alias("files"), F.max(F.length("text")).alias("longest"))


@query("G12_dispatch")
def _(ix):
    return edges.dispatch_targets(ix.symbols, ix.files)


@query("S14_manifest_rows")
def _(ix):
    return projects.manifest_packages(_texts(ix))


# watching


def _file_events(ix: Index) -> DataFrame:
    e = table(ix.spark, ix.root, "events", "user_id", "event_type", "ts")
    return e.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("path"), F.lit("changed").alias("kind"), F.lit(None).cast("string").alias("old_path"), "ts")


@query("W02_bursts", """with e as (select 'm' || user_id as path, ts, lag(ts) over (partition by user_id order by ts) as was from events),
  g as (select path, ts, sum(case when was is null or ts >= was + interval 2 hours then 1 else 0 end) over (partition by path order by ts rows unbounded preceding) as k from e)
  select path, min(ts) as first, max(ts) as last, count(*) as events from g group by path, k""")
def _(ix):
    return watch.settled(_file_events(ix), quiet="2 hours")


@query("W04_renames", "select 'm' || user_id as path from events where event_type <> (select max(event_type) from events) union select 'o' || user_id % 97 from events where event_type = (select min(event_type) from events) union select '*' from events where event_type = (select max(event_type) from events)")
def _(ix):
    e = table(ix.spark, ix.root, "events", "user_id", "event_type", "ts")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))  # one row
    kind = F.when(F.col("event_type") == F.col("lo"), "renamed").when(F.col("event_type") == F.col("hi"), "overflow").otherwise("changed")
    made = e.join(F.broadcast(ends), how="inner").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.concat(F.lit("o"), (F.col("user_id") % 97).cast("string")).alias("old_path"), "ts")
    return watch.batches(watch.touched(made))


@query("W05_dirty_scope", q.with_(q.FILES, q.SYMBOLS, q.REFS, f"changed as (select file_id from f where path in (select path from ({training_data.SQL['p2_found']})))") + """, n as (select distinct name_folded from s where file_id in (select file_id from changed))
  select distinct file_id from (select file_id from r where symbol_name_folded in (select name_folded from n) union all select file_id from changed)""")
def _(ix):
    paths = new_or_changed(*(table(ix.spark, ix.root, t) for t in ("files", "file_scan", "index_runs")))
    return watch.dirty_scope(ix.raw_refs, ix.symbols, ix.files.join(paths, "path", "left_semi"))


@query("G17_budget", q.with_(q.FILES, q.REFS).replace("with ", "with recursive ", 1) + f""", e as (select distinct symbol_name_folded as callee, container_name_folded as caller from r join f using (file_id) where lang = 'python' and reference_kind in {q.in_list(IMPACT_KINDS)} and symbol_name_folded is not null and container_name_folded is not null),
  w as (select 'get' as caller, 0 as depth union select e.caller, w.depth + 1 from w join e on e.callee = w.caller where w.depth < 5), v as (select caller, min(depth) as depth from w where caller <> 'get' group by caller),
  n as (select depth, count(*) as callers from v group by depth), a as (select *, sum(callers) over (order by depth) + 1 as total from n), x as (select *, coalesce(max(total) over (order by depth rows between unbounded preceding and 1 preceding), 0) as before from a)
  select depth, callers, case when exists (select 1 from a where total > 10000) then 'budget' when (select count(*) from a) < 5 then 'exhausted' else 'depth' end as ended from x where before <= 10000""")
def _(ix):
    rows, why = graph.impact(ix.raw_refs, ix.files, "Get", "python", 5, max_rows=10_000)
    return rows.groupBy("depth").agg(F.count("*").alias("callers")).withColumn("ended", F.lit(why))


