"""Y, G and A queries: symbols, references, calls, dependencies, hotspots, maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import graph, predicates, service, structure, symbols
from skerry.plans import sqltext as q
from skerry.runtime import table
from skerry.schema import CALLER_WEIGHTS, HOTSPOT_WEIGHTS, IMPACT_KINDS, Index
from skerry.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_SF = q.with_(q.FILES, q.SYMBOLS)
_ALL = [q.FILES, q.SYMBOLS, q.REFS]
_N = q.folded("name")
SIG = f"""used as (select f.lang, lower(x.name) as name_folded, count(*) as sites, sum({q.weight('x.kind', HOTSPOT_WEIGHTS)}) as tenths from (
    select file_id, symbol_name, symbol_name_folded as name, line, column_number, {q.LOGICAL} as kind from r where symbol_name_folded is not null group by all) x join f on f.file_id = x.file_id group by all)"""


@query("Y01_symbols", _SF + f"select symbol_id, path, name, kind from s join f on f.file_id = s.file_id where (contains({_N}, 'graph') or contains({_N}, 'ledger')) and kind in ('method', 'function') and f.lang = 'python'")
def _(ix):
    return symbols.matching(ix.symbols, ix.files, ["Graph", "Ledger"], kinds=["method", "function"], lang="python").select("symbol_id", "path", "name", "kind")


_Y02 = q.with_(*_ALL, q.DEFS, SIG) + f""", k as (select symbol_id, path, name, kind, line, coalesce(sites, 0) as sites, definitions, coalesce(tenths, 0) / 10.0 / (case when definitions > 1 then definitions * definitions else 1 end) * (case when kind in {q.in_list(symbols.STRUCTURAL_KINDS)} then 0.1 else 1.0 end) as hot,
  greatest(coalesce(end_line - start_line + 1, 1), 1) as size, {q.visibility()} as vis from s join f on f.file_id = s.file_id left join d on d.lang = f.lang and d.name_folded = s.name_folded left join used u on u.lang = f.lang and u.name_folded = s.name_folded and d.definitions is not null)
  select symbol_id, path, name, kind, line, cast(sites as bigint) as sites, round(cast(hot as double), 6) as hotness, round(cast(size * 16.0 + least(sites, 100) * 0.75 + least(cast(hot as double), 150.0) * 0.35 + (case vis when 0 then 8.0 when 1 then 4.0 else 0.0 end) as double), 6) as complexity from k"""


@query("Y02_ranked", _Y02)
def _(ix):
    return symbols.ranked_symbols(ix.symbols, ix.raw_refs, ix.files)


@query("Y03_sorted", f"select * from ({_Y02}) order by complexity desc, path, line, symbol_id limit 50")
def _(ix):
    return symbols.sort_symbols(symbols.ranked_symbols(ix.symbols, ix.raw_refs, ix.files), "complexity", 50)


@query("Y03_name_order", q.with_(q.SYMBOLS) + f"select symbol_id, case when name = 'Get' then 0 when {_N} = 'get' then 1 when starts_with(name, 'Get') then 2 when starts_with({_N}, 'get') then 3 when contains({_N}, 'get') then 4 else 5 end as ord from s where name is not null")
def _(ix):
    return ix.symbols.where("name is not null").select("symbol_id", symbols.exact_name_order(F.col("name"), "Get").alias("ord"))


@query("Y04_counts", _SF + f"select count(*) as symbols, count(distinct path) as files from s join f on f.file_id = s.file_id where contains({_N}, 'graph')")
def _(ix):
    return symbols.matching(ix.symbols, ix.files, ["graph"]).agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files"))


@query("Y05_families", _SF + "select lang, family_key, count(*) as members, count(distinct path) as files, min(path) as path from s join f on f.file_id = s.file_id where family_key is not null group by lang, family_key")
def _(ix):
    return symbols.partial_families(ix.symbols, ix.files).drop("symbol_id")


@query("Y06_kinds", q.with_(q.SYMBOLS) + "select kind, count(*) as n from s group by kind")
def _(ix):
    return ix.symbols.groupBy("kind").agg(F.count("*").alias("n"))


@query("Y07_definitions", q.with_(q.FILES, q.SYMBOLS, q.CHUNKS, q.LINES) + f"""select path, symbol_id, name, kind, start_line, end_line, (select string_agg(text, chr(10) order by line) from ln where ln.file_id = s.file_id and line between s.start_line and least(coalesce(s.end_line, s.start_line), s.start_line + 19)) as body
  from s join f on f.file_id = s.file_id where {_N} = 'scorewidegraphorder' and start_line is not null""")
def _(ix):
    return symbols.definitions(ix.symbols, ix.files, ix.chunks, "ScoreWideGraphOrder")


@query("Y08_goto", _SF + f"select path, symbol_id, name, kind, line from s join f on f.file_id = s.file_id where {_N} = 'scorewidegraphorder' order by case when name = 'ScoreWideGraphOrder' then 0 else 1 end, {q.bucket()}, {q.visibility()}, path, line, symbol_id limit 1")
def _(ix):
    return symbols.goto(ix.symbols, ix.files, "ScoreWideGraphOrder")


@query("Y09_outlines", q.with_(*_ALL, q.DEFS, SIG) + """select path, cast(row_number() over (partition by s.file_id order by coalesce(start_line, line) nulls first, start_column nulls first, symbol_id) as int) as position, symbol_id, concat_ws('.', coalesce(container_qualified_name, container_name), name) as display_name, kind, line, cast(case when d.definitions = 1 then coalesce(u.sites, 0) end as bigint) as uses
  from s join f on f.file_id = s.file_id left join d on d.lang = f.lang and d.name_folded = s.name_folded left join used u on u.lang = f.lang and u.name_folded = s.name_folded""")
def _(ix):
    return symbols.outlines(ix.symbols, ix.files, ix.raw_refs)


@query("Y10_nearby", q.with_(q.SYMBOLS) + """select symbol_id, name, kind, case when 40 between start_line and end_line then 0 else 1 end as outside, case when 40 between start_line and end_line then 0 else least(abs(coalesce(start_line, line) - 40), abs(coalesce(end_line, line) - 40)) end as distance
  from s where file_id = 5 order by outside, distance, symbol_id limit 10""")
def _(ix):
    return symbols.nearby(ix.symbols, 5, 40, 10)


@query("Y11_inspect", q.with_(*_ALL) + """, a as (select file_id, 'definition' as aspect, line, kind as detail from s where name_folded = 'get' union all select file_id, 'reference', line, reference_kind from r where symbol_name_folded = 'get'
  union all select file_id, 'caller', line, container_name from r where symbol_name_folded = 'get' and container_name is not null union all select file_id, 'callee', line, symbol_name from r where container_name_folded = 'get' and symbol_name is not null)
  select aspect, path, line, detail, count(*) as n from a join f using (file_id) group by all""")
def _(ix):
    return symbols.inspect(ix.symbols, ix.files, ix.refs, "Get")


@query("Y12_file_line", q.with_(q.SYMBOLS) + "select symbol_id, name, kind from s where file_id = 5 and 60 between start_line and end_line")
def _(ix):
    return ix.symbols.where("file_id = 5 and 60 between start_line and end_line").select("symbol_id", "name", "kind")


@query("Y14_range", q.with_(q.SYMBOLS) + "select file_id, count(*) as n from s where start_line between 10 and 60 group by file_id")
def _(ix):
    return ix.symbols.where("start_line between 10 and 60").groupBy("file_id").agg(F.count("*").alias("n"))


# references and calls


@query("G01_references", q.with_(q.FILES, q.REFS) + f"select path, lang, line, column_number, reference_kind, container_name, ref_id from r join f using (file_id) where {q.folded('symbol_name')} = 'push'")
def _(ix):
    return graph.references(ix.refs, ix.files, "push")


@query("G05_sites", q.with_(q.REFS, q.SITES) + "select kind, count(*) as sites, count(distinct symbol_name) as names from sites group by kind")
def _(ix):
    return graph.reference_sites(ix.raw_refs.where("symbol_name is not null")).groupBy(F.col("logical_kind").alias("kind")).agg(F.count("*").alias("sites"), F.countDistinct("symbol_name").alias("names"))


def _grouped(keys: list[str], container: str) -> str:
    k = ", ".join(keys)
    return q.with_(q.FILES, q.REFS) + f"""
  , st as (select file_id, symbol_name, line, column_number, {q.LOGICAL} as kind, min(ref_id) as ref_id from r where symbol_name is not null and {q.CALLABLE} group by all),
  x as (select st.file_id, st.symbol_name, st.line, st.column_number, st.kind, r.span_length, {container}, coalesce(r.is_self_reference, false) as slf, coalesce(r.is_mutual_recursion, false) as mut from st join r on r.ref_id = st.ref_id and r.file_id = st.file_id and r.line = st.line and r.column_number = st.column_number),
  g as (select file_id, {k}, count(*) as reference_count, cast(sum({q.weight('kind', CALLER_WEIGHTS)}) as double) / 10 as weighted_score,
    case when bool_or(kind = 'instantiate') then 'instantiate' when bool_or(kind = 'subscribe') then 'subscribe' when bool_or(kind = 'call') then 'call' else min(kind) end as reference_kind,
    min(line) as first_line, arg_min(column_number, line * 100000 + column_number) as first_column, bool_or(slf) as is_self, bool_or(mut) as is_mutual from x group by file_id, {k}),
  kc as (select file_id, {k}, string_agg(kind || ':' || n, ',' order by kind || ':' || n) as kind_counts from (select file_id, {k}, kind, count(*) as n from x group by all) group by file_id, {k})
  select g.* exclude (file_id), kc.kind_counts, f.path, f.lang from g join kc on kc.file_id = g.file_id and {" and ".join(f"kc.{c} = g.{c}" for c in keys)} join f on f.file_id = g.file_id"""


_CALLERS = _grouped(["caller_kind", "caller", "symbol_name"], "coalesce(r.container_kind, 'function') as caller_kind, coalesce(r.container_name, '<top-level>') as caller")
_CALLEES = _grouped(["container_kind", "container_name", "symbol_name", "callee_kind"], "r.container_kind, r.container_name, st.kind as callee_kind").replace(f"symbol_name is not null and {q.CALLABLE}", f"symbol_name is not null and container_name is not null and {q.CALLABLE}", 1)


@query("G03_callers", _CALLERS)
def _(ix):
    return graph.callers(ix.raw_refs, ix.files)


@query("G04_callees", _CALLEES.replace("join kc on", "join kc on true and"))
def _(ix):
    return graph.callees(ix.raw_refs, ix.files)


@query("G07_ranked_callers", f"select * from ({_CALLERS}) where symbol_name = 'Get' order by weighted_score desc, reference_count desc, path, caller, first_line limit 50")
def _(ix):
    return graph.ranked(graph.callers(ix.raw_refs.where("symbol_name = 'Get'"), ix.files), "weighted", 50, ["path", "caller", "first_line"])


@query("G08_caller_counts", f"select symbol_name, count(*) as callers, cast(sum(reference_count) as bigint) as sites from ({_CALLERS}) group by symbol_name")
def _(ix):
    return graph.callers(ix.raw_refs, ix.files).groupBy("symbol_name").agg(F.count("*").alias("callers"), F.sum("reference_count").alias("sites"))


@query("G09_top_level", f"select path, symbol_name, reference_count from ({_CALLERS}) where caller = '<top-level>'")
def _(ix):
    return graph.callers(ix.raw_refs.where("container_name is null"), ix.files).select("path", "symbol_name", "reference_count")


@query("G10_by_identity", q.with_(*_ALL) + "select s.symbol_id, s.name, count(*) as n from r join s on s.symbol_id = r.target_symbol_id group by all")
def _(ix):
    counts = ix.refs_of("target_symbol_id").where("target_symbol_id is not null").groupBy(F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return counts.join(ix.symbols.select("symbol_id", "name"), "symbol_id").select("symbol_id", "name", "n")


@query("G11_identities", q.with_(q.SYMBOLS) + "select symbol_id, name, kind from s where name_folded = 'scorewidegraphorder' order by symbol_id limit 21")
def _(ix):
    return ix.symbols.where("name_folded = 'scorewidegraphorder'").select("symbol_id", "name", "kind").orderBy("symbol_id").limit(21)


@query("G13_unqualified", q.with_(q.REFS) + f"select reference_kind, count(*) as n from r where symbol_name is not null and not (target_qualifier is not null and lower(symbol_name) in {q.in_list(n.lower() for n in q.NOISE)}) group by reference_kind")
def _(ix):
    common = F.col("target_qualifier").isNotNull() & predicates.is_noise(F.col("symbol_name"))
    return ix.refs_of("symbol_name", "target_qualifier", "reference_kind").where(F.col("symbol_name").isNotNull() & ~common).groupBy("reference_kind").agg(F.count("*").alias("n"))


_EDGES = f"ed as (select distinct f.lang, symbol_name_folded as callee, container_name_folded as caller from r join f using (file_id) where lang is not null and reference_kind in {q.in_list(IMPACT_KINDS)} and symbol_name_folded is not null and container_name_folded is not null)"


@query("G14_impact", q.with_(q.FILES, q.REFS, _EDGES).replace("with ", "with recursive ", 1) + """, w as (select 'get' as caller, 0 as depth union select ed.caller, w.depth + 1 from w join ed on ed.callee = w.caller and ed.lang = 'python' where w.depth < 5)
  select caller, min(depth) as depth from w where caller <> 'get' group by caller""")
def _(ix):
    return graph.impact(ix.raw_refs, ix.files, "Get", "python", 5)[0]


def _path_levels(depth: int) -> str:
    """Paths level by level, of which the first ten to a caller go on."""
    parts = ["q0 as (select 'get' as node, ['get'] as path)"]
    for d in range(1, depth + 1):
        step = f"select distinct e.caller as node, list_append(q.path, e.caller) as path from q{d - 1} q join e on e.callee = q.node join v on v.caller = e.caller and v.depth = {d} where not list_contains(q.path, e.caller)"
        parts.append(f"q{d} as (select node, path from (select *, row_number() over (partition by node order by path) as k from ({step})) where k <= 10)")
    return ", ".join(parts)


@query("G15_paths", q.with_(q.FILES, q.REFS, _EDGES).replace("with ", "with recursive ", 1) + f""", e as (select callee, caller from ed where lang = 'python'), w as (select 'get' as caller, 0 as depth union select e.caller, w.depth + 1 from w join e on e.callee = w.caller where w.depth < 5),
  v as (select caller, min(depth) as depth from w where caller <> 'get' group by caller), {_path_levels(5)} """ + " union all ".join(f"select node as caller, {d} as depth, array_to_string(path, ' <- ') as path from q{d}" for d in range(1, 6)))
def _(ix):
    return graph.impact_paths(ix.raw_refs, ix.files, "Get", "python", 5)


@query("G16_two_cycles", q.with_(q.FILES, q.REFS, _EDGES) + "select a.lang, a.caller as a, a.callee as b from ed a join ed b on a.lang = b.lang and a.caller = b.callee and a.callee = b.caller where a.caller < a.callee")
def _(ix):
    edges = graph.call_edges(ix.raw_refs, ix.files)
    both = edges.where("caller <> callee").groupBy("lang", F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").select("lang", "a", "b")


@query("G16_walk_cycles", q.with_(q.FILES, q.REFS, _EDGES).replace("with ", "with recursive ", 1) + """, w as (select 'get' as caller, 0 as depth union select ed.caller, w.depth + 1 from w join ed on ed.callee = w.caller and ed.lang = 'python' where w.depth < 5),
  e as (select distinct callee as src, caller as dst from ed where lang = 'python' and callee in (select caller from w) and caller in (select caller from w)), t as (select src, dst from e union select t.src, e.dst from t join e on e.src = t.dst)
  select a.src as node, max(a.dst) as component from t a join t b on b.src = a.dst and b.dst = a.src group by a.src""")
def _(ix):
    return structure.impact_cycles(ix.raw_refs, ix.files, "Get", "python", 5)


@query("G18_roots", q.with_(q.FILES, q.SYMBOLS, q.DEFS) + "select lang, name_folded, definitions, files from d where files = 1 or lang = 'csharp'")
def _(ix):
    return graph.definition_names(ix.symbols, ix.files).where("files = 1 or lang = 'csharp'").select("lang", "name_folded", "definitions", "files")


@query("G19_hierarchy", q.with_(q.REFS) + "select source_symbol_id as symbol_id, count(*) as sites, min(line) as first_line from r where target_symbol_id = 410 and source_symbol_id is not null group by 1")
def _(ix):
    return graph.call_hierarchy(ix.refs_of("source_symbol_id", "target_symbol_id", "line"), 410)


@query("G20_positions", q.with_(q.REFS) + "select ref_id, symbol_name from r where line = 29 and 15 between column_number and column_number + span_length - 1")
def _(ix):
    return ix.refs.where(predicates.at_position(F.col("line"), F.col("column_number"), F.col("span_length"), 29, 15)).select("ref_id", "symbol_name")


@query("G21_sources", q.with_(*_ALL) + """select ref_id, arg_min(symbol_id, cast(end_line - start_line as hugeint) * 1000000000000 + symbol_id) as source_symbol_id from (select distinct r.ref_id, s.symbol_id, s.start_line, s.end_line from r join s on s.file_id = r.file_id and s.name = r.container_name and r.line between s.start_line and s.end_line) group by ref_id""")
def _(ix):
    return graph.source_symbols(ix.raw_refs, ix.symbols)


@query("G23_unique", q.with_(q.FILES, q.SYMBOLS, q.DEFS) + "select lang, name_folded, lo as family from d where lo = hi")
def _(ix):
    return graph.unique_families(ix.symbols, ix.files)


_RESOLVED = q.with_(*_ALL) + """, w as (select file_id, lang, left(path, length(path) - length(split_part(path, '/', -1))) as dir from f), df as (select s.symbol_id, s.name_folded, lower(s.container_name) as container, w.* from s join w using (file_id) where s.name_folded is not null),
  o as (select file_id, container, lang, name_folded, count(*) as n, min(symbol_id) as id from df group by all), a as (select file_id, lang, name_folded, count(*) as n, min(symbol_id) as id from df group by all), b as (select dir, lang, name_folded, count(*) as n, min(symbol_id) as id from df group by all), c as (select lang, name_folded, count(*) as n, min(symbol_id) as id from df group by all),
  x as (select r.ref_id, case when o.n is not null then 1 when a.n is not null then 2 when b.n is not null then 3 when c.n is not null then 4 end as scope_rank, coalesce(o.n, a.n, b.n, c.n, 0) as candidate_count, coalesce(o.id, a.id, b.id, c.id) as id from r join w using (file_id)
    left join o on o.file_id = r.file_id and o.container = r.container_name_folded and o.lang = w.lang and o.name_folded = r.symbol_name_folded
    left join a on a.file_id = r.file_id and a.lang = w.lang and a.name_folded = r.symbol_name_folded left join b on b.dir = w.dir and b.lang = w.lang and b.name_folded = r.symbol_name_folded left join c on c.lang = w.lang and c.name_folded = r.symbol_name_folded where r.symbol_name_folded is not null)
  """


def _resolution(ix):
    return graph.candidate_summary(ix.refs_of("file_id", "symbol_name_folded", "container_name_folded"), ix.symbols, ix.files)


@query("G24_resolution", _RESOLVED + "select ref_id, scope_rank, candidate_count, case when candidate_count = 1 then id end as target_symbol_id, case candidate_count when 0 then 'unresolved' when 1 then 'resolved' else 'ambiguous' end as state from x")
def _(ix):
    return _resolution(ix)


@query("G22_ranks", _RESOLVED + "select scope_rank, count(*) as refs, cast(sum(candidate_count) as bigint) as candidates from x group by scope_rank")
def _(ix):
    return _resolution(ix).groupBy("scope_rank").agg(F.count("*").alias("refs"), F.sum("candidate_count").alias("candidates"))


@query("G25_self", q.with_(q.REFS) + "select coalesce(source_symbol_id = target_symbol_id, symbol_name_folded = container_name_folded, false) as is_self, count(*) as n from r group by 1")
def _(ix):
    return graph.self_references(ix.refs_of("source_symbol_id", "target_symbol_id", "symbol_name_folded", "container_name_folded")).groupBy("is_self").agg(F.count("*").alias("n"))


@query("G26_mutual", q.with_(q.REFS) + ", e as (select distinct source_symbol_id as s, target_symbol_id as t from r where source_symbol_id <> target_symbol_id) select x.s as a, x.t as b from e x join e y on x.s = y.t and x.t = y.s where x.s < x.t")
def _(ix):
    return graph.mutual_recursion(ix.raw_refs)


# dependencies


_USES = f"u as (select x.file_id as src, f.lang, x.name_folded, count(*) as sites, min(x.symbol_name) as symbol from (select file_id, symbol_name, line, column_number, {q.LOGICAL} as kind, min_by(symbol_name_folded, ref_id) as name_folded from r where symbol_name_folded is not null group by file_id, symbol_name, line, column_number, kind) x join f on f.file_id = x.file_id where f.lang is not null group by x.file_id, f.lang, x.name_folded)"
_TARGETS = "t as (select distinct s.file_id as dst, f.lang, s.name_folded from s join f on f.file_id = s.file_id where f.lang is not null and s.name_folded is not null)"
_DEPS = q.with_(*_ALL, q.DEFS, _USES, _TARGETS)


@query("A01_dependencies", _DEPS + """select fa.path as src_path, fb.path as dst_path, cast(sum(sites) as bigint) as reference_count, count(*) as symbol_count, array_to_string(list_slice(list_sort(list(distinct symbol)), 1, 32), ',') as symbols
  from u join t using (lang, name_folded) join f fa on fa.file_id = src join f fb on fb.file_id = dst where src <> dst group by src, dst, fa.path, fb.path""")
def _(ix):
    return structure.file_dependencies(ix.raw_refs, ix.symbols, ix.files)


@query("A01_ambiguous", q.with_(q.FILES, q.SYMBOLS, q.DEFS) + f"select lang, name_folded, files from d where lang is not null and files > {structure.AMBIGUOUS_FROM}")
def _(ix):
    return structure.ambiguous_targets(ix.symbols, ix.files)


@query("A01_ambiguous_sides", _DEPS + f"""select lang, name_folded, 'use' as side, path, cast(sum(sites) as bigint) as sites from u join d using (lang, name_folded) join f on f.file_id = src where d.files > {structure.AMBIGUOUS_FROM} group by lang, name_folded, path, f.lang having true
  union all select distinct f.lang, s.name_folded, 'definition', path, 0::bigint from s join f on f.file_id = s.file_id join d on d.lang = f.lang and d.name_folded = s.name_folded where d.files > {structure.AMBIGUOUS_FROM}""".replace("select lang, name_folded, 'use'", "select u.lang as lang, u.name_folded as name_folded, 'use'").replace("group by lang, name_folded, path, f.lang having true", "group by u.lang, u.name_folded, path"))
def _(ix):
    return structure.ambiguous_sides(ix.raw_refs, ix.symbols, ix.files)


@query("A06_evidence", q.with_(*_ALL) + "select r.file_id as src, s.file_id as dst, reference_kind as kind, resolution_state as state, count(*) as n from r join s on s.symbol_id = r.target_symbol_id where r.file_id <> s.file_id group by all")
def _(ix):
    return structure.dependency_evidence(ix.refs_of("file_id", "target_symbol_id", "reference_kind", "resolution_state"), ix.symbols, ix.files)


@query("A08_dependents", _DEPS + "select dst, count(distinct src) as dependents from u join t using (lang, name_folded) where src <> dst group by dst")
def _(ix):
    return structure.dependent_counts(ix.raw_refs, ix.symbols, ix.files)


@query("A09_by_symbol", _DEPS + "select src, dst, cast(sum(sites) as bigint) as n from u join t using (lang, name_folded) where src <> dst and starts_with(name_folded, 'score') group by all")
def _(ix):
    return structure.dependencies_by_name(ix.raw_refs, ix.symbols, ix.files, "score")


@query("A10_ranked", _DEPS + f"""select src, dst, cast(sum(sites) as bigint) as reference_count, round(cast(sum(sites) as double) * sum(case when lower(symbol) in {q.in_list(n.lower() for n in q.NOISE)} then 1 else 10 end) / (count(*) * 10), 4) as score
  from u join t using (lang, name_folded) where src <> dst group by src, dst order by score desc, src, dst limit 200""")
def _(ix):
    return structure.ranked_dependencies(ix.raw_refs, ix.symbols, ix.files, 200)


def _file_edges(ix):
    return structure.dependency_evidence(ix.refs_of("file_id", "target_symbol_id", "reference_kind", "resolution_state"), ix.symbols, ix.files).select("src", "dst").distinct()


_SCC = "with recursive " + ", ".join([q.SYMBOLS, q.REFS]) + """, e as (select distinct r.file_id as src, s.file_id as dst from r join s on s.symbol_id = r.target_symbol_id where r.file_id <> s.file_id),
  t as (select src, dst from e union select t.src, e.dst from t join e on e.src = t.dst), m as (select a.src as node, a.dst as other from t a join t b on b.src = a.dst and b.dst = a.src),
  k as (select node, max(other) as component from m group by node)
  """


@query("A12_cycles", _SCC + "select node, component from k")
def _(ix):
    return structure.cycles(_file_edges(ix))


@query("A12_ranked", _SCC + """, n as (select component, count(*) as nodes from k group by component), i as (select a.component, count(*) as edges from e join k a on a.node = e.src join k b on b.node = e.dst where a.component = b.component group by a.component)
  select cast(row_number() over (order by nodes desc, edges desc, component) as int) as rank, component, nodes, edges from n join i using (component) order by rank limit 20""")
def _(ix):
    return structure.ranked_cycles(_file_edges(ix), 20)


@query("A13_nodes", q.with_(q.FILES, q.SYMBOLS) + "select container_qualified_name as node, count(distinct path) as files, min(path) as first from s join f on f.file_id = s.file_id where container_qualified_name is not null group by 1")
def _(ix):
    rows = ix.symbols.where("container_qualified_name is not null").join(ix.files.select("file_id", "path"), "file_id")
    return rows.groupBy(F.col("container_qualified_name").alias("node")).agg(F.countDistinct("path").alias("files"), F.min("path").alias("first"))


_HOT = f"""hs as (select f.file_id, f.lang, split_part(x.symbol_name, '#', 1) as symbol_name, count(*) as reference_count, cast(sum({q.weight('x.kind', HOTSPOT_WEIGHTS)}) as double) / 10 as score from (
  select file_id, symbol_name, line, column_number, {q.LOGICAL} as kind from r where symbol_name is not null group by all) x join f on f.file_id = x.file_id group by f.file_id, f.lang, split_part(x.symbol_name, '#', 1))"""


@query("A14_hotspot_counts", q.with_(q.FILES, q.REFS, _HOT) + "select * from hs")
def _(ix):
    return structure.hotspot_counts(ix.raw_refs, ix.files)


@query("A15_hotspots", q.with_(*_ALL, q.DEFS, _HOT) + f"""
  , g as (select lang, lower(symbol_name) as nf, sum(reference_count) as n, sum(score) as sc from hs group by all), o as (select file_id, lower(symbol_name) as nf, sum(reference_count) as n, sum(score) as sc from hs group by all),
  x as (select path, symbol_id, name, kind, cast(coalesce(case when definitions = 1 then g.n else o.n end, 0) as bigint) as reference_count, round(coalesce(case when definitions = 1 then g.sc else o.sc end, 0.0) * (case when lower(name) in {q.in_list(structure.GENERIC_NAMES)} then 0.35::double else 1.0::double end), 4) as score
    from s join f on f.file_id = s.file_id join d on d.lang = f.lang and d.name_folded = s.name_folded left join g on g.lang = f.lang and g.nf = s.name_folded left join o on o.file_id = s.file_id and o.nf = s.name_folded)
  select * from x where reference_count > 0 order by score desc, reference_count desc, path, symbol_id limit 100""")
def _(ix):
    return structure.symbol_hotspots(ix.symbols, ix.raw_refs, ix.files, 100)


@query("A16_file_hotspots", q.with_(q.FILES, q.REFS, _HOT) + "select path, cast(sum(reference_count) as bigint) as reference_count, round(sum(score), 4) as score from hs join f using (file_id) group by hs.file_id, path")
def _(ix):
    return structure.file_hotspots(ix.raw_refs, ix.files)


@query("A17_name_hotspots", q.with_(q.FILES, q.SYMBOLS) + "select name, kind, count(*) as sites, array_to_string(list_slice(list_sort(list(distinct path)), 1, 20), ',') as paths from s join f on f.file_id = s.file_id where name is not null and kind is not null group by name, kind")
def _(ix):
    return structure.name_hotspots(ix.symbols.where("kind is not null"), ix.files)


@query("A18_identities", q.with_(*_ALL) + f""", t as (select symbol_id, name_folded, name, kind, coalesce(family_key, 'sym:' || symbol_id) as key from s join f on f.file_id = s.file_id where f.lang = 'csharp'),
  g as (select name_folded, min(key) as key, min(name) as name, min(kind) as kind from t where name_folded is not null group by name_folded having count(distinct key) = 1 and count(distinct name) = 1 and count(distinct kind) <= 1 and (count(kind) = count(*) or count(kind) = 0)),
  x as (select r.file_id, r.line, r.column_number, {q.LOGICAL} as kind_, resolution_state, target_symbol_id, symbol_name_folded from r join f on f.file_id = r.file_id where f.lang = 'csharp'),
  z as (select distinct t.key, t.name, t.kind, x.file_id, x.line, x.column_number, kind_ from x join t on t.symbol_id = x.target_symbol_id
    union select distinct g.key, g.name, g.kind, x.file_id, x.line, x.column_number, kind_ from x join g on g.name_folded = x.symbol_name_folded where x.target_symbol_id is null and resolution_state in ('ambiguous', 'resolved_group'))
  select key as target_key, name, kind, count(*) as reference_count, cast(sum({q.weight('kind_', HOTSPOT_WEIGHTS)}) as double) / 10 as score from z group by key, name, kind""")
def _(ix):
    return structure.identity_hotspots(ix.raw_refs, ix.symbols, ix.files)


_FRONT = q.with_(*_ALL, q.DEFS, _HOT) + f"""
  , top as (select distinct lang, lower(symbol_name) as nf from (select * from hs order by score desc, reference_count desc, lang nulls first, symbol_name, file_id limit 1280)),
  g as (select lang, lower(symbol_name) as nf, sum(reference_count) as n, sum(score) as sc from hs group by all), o as (select file_id, lower(symbol_name) as nf, sum(reference_count) as n, sum(score) as sc from hs group by all),
  x as (select path, symbol_id, name, kind, cast(coalesce(case when definitions = 1 then g.n else o.n end, 0) as bigint) as reference_count, round(coalesce(case when definitions = 1 then g.sc else o.sc end, 0.0) * (case when lower(name) in {q.in_list(structure.GENERIC_NAMES)} then 0.35::double else 1.0::double end), 4) as score
    from s join f on f.file_id = s.file_id join d on d.lang = f.lang and d.name_folded = s.name_folded join top on top.lang = f.lang and top.nf = s.name_folded left join g on g.lang = f.lang and g.nf = s.name_folded left join o on o.file_id = s.file_id and o.nf = s.name_folded)
  select * from x where reference_count > 0 order by score desc, reference_count desc, path, symbol_id limit 20"""


@query("A20_frontier", _FRONT)
def _(ix):
    return structure.frontier_hotspots(ix.symbols, ix.raw_refs, ix.files, 20)


_UNUSED = q.with_(*_ALL) + r"""
  , n as (select distinct f.lang, r.symbol_name_folded as nf from r join f on f.file_id = r.file_id where symbol_name_folded is not null and (container_name_folded is null or container_name_folded <> symbol_name_folded)),
  x as (select symbol_id, path, name, kind, case when coalesce(regexp_matches(signature, '(?i)@|\[[A-Z]|attribute|decorator'), false) or regexp_matches(path, '(?i)(config|settings|migrations?|handlers?|controllers?)[/.]') then 'reflection_or_config_suspect'
    when lower(visibility) in ('private', 'fileprivate') then 'likely_unused_private' when lower(visibility) in ('internal', 'protected', 'private protected', 'protected internal') then 'maybe_unused_nonpublic' else 'public_or_exported_no_refs' end as bucket
    from s join f on f.file_id = s.file_id where (kind is null or kind not in ('import', 'namespace', 'heading')) and not exists (select 1 from r where r.target_symbol_id = s.symbol_id) and not exists (select 1 from n where n.lang = f.lang and n.nf = s.name_folded))
  select *, case when bucket = 'likely_unused_private' then 'medium' else 'low' end as confidence from x"""


@query("A21_unused", _UNUSED)
def _(ix):
    return structure.unused_symbols(ix.symbols, ix.raw_refs, ix.files)


@query("A21_beyond_text", _UNUSED.replace("select *, case when bucket", ", y as (select *, case when bucket").rstrip() + "), " + q.CHUNKS + ", " + q.LINES + """,
  p as (select y.symbol_id, s.file_id, s.name, s.line, s.container_qualified_name as type from y join s using (symbol_id) where bucket = 'likely_unused_private' and s.name is not null),
  z as (select distinct coalesce(s.container_qualified_name || '.' || s.name, s.name) as type, s.file_id from s join f on f.file_id = s.file_id where f.lang = 'csharp' and s.kind in ('class', 'struct', 'interface', 'enum', 'record') and regexp_matches(s.signature, '\\bpartial\\b')),
  o as (select symbol_id, file_id, name, line from p union all select p.symbol_id, z.file_id, p.name, null from p join f on f.file_id = p.file_id join z on z.type = p.type and z.file_id <> p.file_id where f.lang = 'csharp')
  select * from y where symbol_id not in (select o.symbol_id from o join ln on ln.file_id = o.file_id and ln.line is distinct from o.line and list_contains(regexp_split_to_array(ln.text, '[^A-Za-z0-9_]+'), o.name))""")
def _(ix):
    return structure.unused_beyond_text(ix.symbols, ix.raw_refs, ix.files, ix.chunks)


@query("A22_unused_buckets", f"select bucket, confidence, count(*) as n from ({_UNUSED}) group by all")
def _(ix):
    return structure.unused_symbols(ix.symbols, ix.raw_refs, ix.files).groupBy("bucket", "confidence").agg(F.count("*").alias("n"))


_ENRICHED = "en as (select f.*, coalesce(a.n, 0) as symbols, coalesce(b.n, 0) as refs, coalesce(f.lines, 0) + 5 * coalesce(a.n, 0) + 2 * coalesce(b.n, 0) as score from f left join (select file_id, count(*) as n from s group by 1) a on a.file_id = f.file_id left join (select file_id, count(*) as n from r group by 1) b on b.file_id = f.file_id)"
_MAP = q.with_(*_ALL, _ENRICHED)


@query("A23_modules", _MAP + "select array_to_string(list_slice(string_split(path, '/'), 1, greatest(least(len(string_split(path, '/')) - 1, 2), 1)), '/') as module, count(*) as files, cast(sum(coalesce(lines, 0)) as bigint) as lines, cast(sum(symbols) as bigint) as symbols, cast(sum(refs) as bigint) as refs from en group by 1")
def _(ix):
    return structure.modules(structure.enriched_files(ix.files, ix.symbols, ix.refs_of("file_id")))


@query("A24_top_files", _MAP + "select path, lines, size, symbols, refs, score from en order by score desc nulls last, path limit 50")
def _(ix):
    return structure.top_files(structure.enriched_files(ix.files, ix.symbols, ix.refs_of("file_id")), "score", 50)


@query("A25_module_depth", q.with_(q.FILES) + "select array_to_string(list_slice(string_split(path, '/'), 1, greatest(least(len(string_split(path, '/')) - 1, 3), 1)), '/') as module, count(*) as files from f group by 1")
def _(ix):
    return ix.files.groupBy(structure.module_key(F.col("path"), 3).alias("module")).agg(F.count("*").alias("files"))


@query("A26_entry_points", _SF + f""", x as (select path, symbol_id, name, case when {_N} in {q.in_list(structure.ENTRY_NAMES)} then 4 else 0 end + case when regexp_matches(lower(path), '{structure.ENTRY_PATHS}') then 3 else 0 end as hints, case when kind in ('function', 'class', 'method') then 1 else 0 end + case when len(string_split(path, '/')) <= 3 then 1 else 0 end as extra from s join f on f.file_id = s.file_id where name is not null)
  select path, symbol_id, name, hints + extra as score, round(least(case when hints >= 7 then 0.85::double when hints >= 4 then 0.65::double else 0.5::double end + 0.02::double * (hints + extra), 1.0::double), 3) as confidence from x where hints > 0""")
def _(ix):
    return structure.entry_points(ix.symbols, ix.files)


@query("A27_files", _MAP + "select path, lang, size, symbols, refs from en where path is not null order by path limit 200")
def _(ix):
    page = structure.listed_files(ix.files.where("path is not null"), 200)
    return structure.enriched_files(page, ix.symbols, ix.refs_of("file_id")).select("path", "lang", "size", "symbols", "refs")


@query("A28_file_sizes", q.with_(q.FILES) + "select count(*) as files, cast(sum(size) as bigint) as bytes, round(avg(size), 4) as mean, max(size) as largest from f")
def _(ix):
    return ix.files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 4).alias("mean"), F.max("size").alias("largest"))


@query("A29_status", q.with_(*_ALL, q.CHUNKS) + """select 'files' as measure, count(*) as value from f union all select 'symbols', count(*) from s union all select 'references', count(*) from r union all select 'chunks', count(*) from c
  union all select 'languages', count(distinct lang) from f union all select 'bytes', cast(sum(coalesce(size, 0)) as bigint) from f union all select 'generated', count(*) filter (where generated) from f""")
def _(ix):
    from skerry.operators.search import distinct_chunks

    return structure.status(ix.files, ix.symbols, ix.refs, distinct_chunks(ix.chunks))


@query("A30_freshness", q.with_(q.FILES) + """, n as (select path, lower(checksum) as checksum from (select *, row_number() over (partition by path order by scanned_at desc nulls last, lower(checksum) desc nulls last) as k from file_scan where path is not null) where k = 1),
  x as (select coalesce(n.path, f.path) as path, case when n.path is null then 'missing' when f.path is null then 'added' when n.checksum is distinct from lower(f.checksum) then 'changed' end as state from n full join f on f.path = n.path)
  select path, state from x where state is not null""")
def _(ix):
    return structure.freshness(ix.files, table(ix.spark, ix.root, "file_scan", "path", "checksum", "scanned_at"))


@query("A33_languages", q.with_(q.FILES) + "select lang, count(*) as files, cast(sum(coalesce(lines, 0)) as bigint) as lines from f where lang is not null group by lang")
def _(ix):
    return ix.files.where("lang is not null").groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


@query("A34_diff", "with a as (select distinct * from symbols), b as (select distinct * from symbols_right) select 'added' as change, count(*) as n from (select * from b except select * from a) union all select 'removed', count(*) from (select * from a except select * from b)")
def _(ix):
    right = table(ix.spark, ix.root, "symbols_right", *ix.symbols.columns).distinct()
    one = lambda df, tag: df.agg(F.count("*").alias("n")).select(F.lit(tag).alias("change"), "n")
    return one(right.exceptAll(ix.symbols), "added").unionByName(one(ix.symbols.exceptAll(right), "removed"))


@query("A35_coverage", q.with_(q.FILES, q.CHUNKS) + "select case when exists (select 1 from c where c.file_id = f.file_id) then 'indexed' else 'known_unindexed' end as state, count(*) as files from f group by 1")
def _(ix):
    held = ix.chunks.where("content is not null").select("file_id").distinct().withColumn("held", F.lit(True))
    return ix.files.join(held, "file_id", "left").groupBy(F.when(F.col("held"), "indexed").otherwise("known_unindexed").alias("state")).agg(F.count("*").alias("files"))


@query("A37_page", q.with_(q.FILES) + "select file_id, path from f where path > 'juniper' order by path limit 50")
def _(ix):
    return structure.listed_files(ix.files, 50, "juniper").select("file_id", "path")


@query("A39_integrity", "select 'symbols' as relation, count(*) as orphans from (select distinct file_id from symbols where file_id is not null and file_id not in (select file_id from files where file_id is not null)) union all select 'refs', count(*) from (select distinct file_id from refs where file_id is not null and file_id not in (select file_id from files where file_id is not null))")
def _(ix):
    def orphans(df, tag):
        return df.where("file_id is not null").select("file_id").distinct().join(ix.files, "file_id", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(tag).alias("relation"), "orphans")

    return orphans(ix.symbols, "symbols").unionByName(orphans(ix.refs, "refs"))


_SELECTOR = """select symbol_id, 'id:' || symbol_id || '@7:' || left(sha256('{"path":' || coalesce('"' || path || '"', 'null') || ',"kind":' || coalesce('"' || kind || '"', 'null') || ',"container_qualified_name":' || coalesce('"' || container_qualified_name || '"', 'null')
  || ',"name":' || coalesce('"' || replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"', 'null') || ',"line":' || coalesce(line::varchar, 'null') || '}'), 16) as selector from s join f on f.file_id = s.file_id"""


@query("Y13_selectors", _SF + _SELECTOR)
def _(ix):
    return service.selectors(ix.symbols, ix.files, 7)


@query("A38_batch", q.with_(q.FILES, q.SYMBOLS) + """select 0 as ordinal, 'kinds' as query, '{"kind":' || coalesce('"' || kind || '"', 'null') || ',"n":' || count(*) || '}' as row from s group by kind
  union all select 1, 'languages', '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"files":' || count(*) || '}' from f group by lang""")
def _(ix):
    kinds = ix.symbols.groupBy("kind").agg(F.count("*").alias("n"))
    return service.batch([("kinds", kinds), ("languages", ix.files.groupBy("lang").agg(F.count("*").alias("files")))])


# sinks


@query("K03_ctags", _SF + "select name, path, line || ';\"' as address, case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in sinks.CTAGS_KINDS.items()) + f" end as kind, line from s join f on f.file_id = s.file_id where name is not null and line is not null and not contains(name, chr(9)) and kind in {q.in_list(sinks.CTAGS_KINDS)}")
def _(ix):
    return sinks.ctags(ix.symbols, ix.files)


@query("K03_skipped", q.with_(q.SYMBOLS) + f""", x as (select case when name is null then 'no_name' when line is null then 'no_line' when not coalesce(kind in {q.in_list(sinks.CTAGS_KINDS)}, false) then 'kind' when contains(name, chr(9)) then 'bad_name' end as reason from s)
  select r as reason, count(reason) as n from (values ('no_name'), ('no_line'), ('kind'), ('bad_name')) v(r) left join x on x.reason = r group by r""")
def _(ix):
    return sinks.ctags_skipped(ix.symbols)


@query("K04_redacted", q.with_(q.FILES) + "select file_id, array_to_string(list_transform(string_split(path, '/'), lambda p, i: case when i = 1 or i = len(string_split(path, '/')) then p else substr(sha256(p), 1, 12) end), '/') as path from f where path is not null")
def _(ix):
    return ix.files.where("path is not null").select("file_id", sinks.redacted(F.col("path")).alias("path"))


def _graph(ix):
    return _file_edges(ix).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(1).alias("n"))


_GRAPH = q.with_(*_ALL) + ", g as (select distinct r.file_id as src, s.file_id as dst from r join s on s.symbol_id = r.target_symbol_id where r.file_id <> s.file_id) "


@query("K06_dot", _GRAPH + "select '\"' || src || '\" -> \"' || dst || '\" [weight=1];' as value from g")
def _(ix):
    return sinks.dot_edges(_graph(ix))


@query("K06_graphml", _GRAPH + "select '<edge source=\"' || src || '\" target=\"' || dst || '\"><data key=\"n\">1</data></edge>' as value from g")
def _(ix):
    return sinks.graphml_edges(_graph(ix))


@query("K06_edge_list", _GRAPH + "select src || chr(9) || dst || chr(9) || '1' as value from g")
def _(ix):
    return sinks.edge_list(_graph(ix))


@query("K05_quickfix", q.with_(q.FILES, q.SYMBOLS) + "select path || ':' || line || ':' || coalesce(start_column, 1) || ':' || name as value from s join f on f.file_id = s.file_id where path is not null and line is not null and name is not null")
def _(ix):
    rows = ix.symbols.where("line is not null and name is not null").join(ix.files.where("path is not null").select("file_id", "path"), "file_id")
    return sinks.quickfix(rows.select("path", "line", F.coalesce("start_column", F.lit(1)).alias("column"), F.col("name").alias("text")))


def _places(ix):
    rows = ix.symbols.where("line is not null and name is not null").join(ix.files.where("path is not null").select("file_id", "path"), "file_id")
    return rows.select("path", "line", F.coalesce("start_column", F.lit(1)).alias("column"), F.length("name").alias("length"), F.col("name").alias("text"))


_PLACES = q.with_(q.FILES, q.SYMBOLS) + """, p as (select path, line, coalesce(start_column, 1) as col, length(name) as len, name as text, replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as quoted from s join f on f.file_id = s.file_id where path is not null and line is not null and name is not null) """


@query("K05_lsp", _PLACES + """select '{"uri":"file:///' || path || '","range":{"start":{"line":' || (line - 1) || ',"character":' || (col - 1) || '},"end":{"line":' || (line - 1) || ',"character":' || (col - 1 + len) || '}}}' as value from p""")
def _(ix):
    return sinks.lsp_locations(_places(ix))


@query("K05_sarif", _PLACES + """select '{"ruleId":"symbol","level":"note","message":{"text":"' || quoted || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || line || ',"startColumn":' || col || '}}}]}' as value from p""")
def _(ix):
    return sinks.sarif_results(_places(ix), "symbol")


@query("K05_csv", _PLACES + """select path || ',' || line || ',' || case when contains(text, ',') or contains(text, '"') or contains(text, chr(10)) then '"' || replace(text, '"', '""') || '"' else text end as value from p""")
def _(ix):
    return sinks.delimited(_places(ix), ["path", "line", "text"])


@query("K05_grouped", _PLACES + ", k as (select *, row_number() over (partition by path order by line, col, text) as k from p) select path, count(*) as matches, string_agg(line || ': ' || text, chr(10) order by k) filter (where k <= 5) as value from k group by path")
def _(ix):
    return sinks.grouped_by_path(_places(ix), 5)


@query("K07_projection", q.with_(q.FILES) + "select '{\"path\":\"' || path || '\",\"size\":' || size || '}' as value from f where path is not null and size is not null")
def _(ix):
    return sinks.ndjson(ix.files.where("path is not null and size is not null"), ["path", "size"])


@query("K07_bounded", q.with_(q.FILES) + ", x as (select file_id, size, sum(length('{\"file_id\":' || file_id || ',\"size\":' || size || '}') + 1) over (order by file_id) as b from f where size is not null) select file_id, size from x where b <= 4096")
def _(ix):
    return sinks.within_bytes(ix.files.where("size is not null").select("file_id", "size"), 4096, ["file_id"])
