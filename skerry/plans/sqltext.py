"""Parts of DuckDB SQL that oracles share: clean views, lines, predicates."""

from __future__ import annotations

from skerry import schema
from skerry.operators.predicates import DOCS_FORMS, TEST_FORMS

_F = ", ".join(f"{c} desc nulls last" for c in ("indexed_at", "modified", "checksum", "size", "lines", "path", "lang", "generated"))
FILES = f"""f as (select file_id, path, lower(lang) as lang, size, lines, checksum, modified, generated, indexed_at from (
  select *, row_number() over (partition by file_id order by {_F}) as rn from files where file_id is not null) where rn = 1)"""
SYMBOLS = f"s as (select distinct {', '.join(schema.names(schema.SYMBOLS))} from symbols)"
REFS = f"r as (select distinct {', '.join(schema.names(schema.REFS))} from refs)"
CHUNKS = "c as (select distinct chunk_id, file_id, start_line, content from chunks where content is not null)"
LINES = """ln as (select file_id, chunk_id, start_line + k - 1 as line, parts[k] as text from (
  select file_id, chunk_id, start_line, nxt, string_split(content, chr(10)) as parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) as k from (
    select file_id, chunk_id, start_line, content, lead(start_line) over (partition by file_id order by start_line, chunk_id) as nxt from c))
  where nxt is null or start_line + k - 1 < nxt)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def is_test(path: str = "path") -> str:
    return "(" + " or ".join(f"lower({path}) like '{p}' escape '\\'" for p in TEST_FORMS) + ")"


def bucket(path: str = "path") -> str:
    docs = " or ".join(f"lower({path}) like '{p}' escape '\\'" for p in DOCS_FORMS)
    return f"case when {is_test(path)} then 1 when {docs} then 2 else 0 end"


def folded(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def weight(kind: str, weights: dict[str, int]) -> str:
    return "case " + kind + " " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + " else 0 end"


def visibility(c: str = "visibility") -> str:
    return (
        f"case when lower({c}) in ('public','open','pub','export') then 0 when lower({c}) in ('protected','protected internal') then 1"
        f" when lower({c}) in ('internal','private protected') then 2 when lower({c}) in ('private','fileprivate') then 3 else 4 end"
    )


#: Expected noise names, written out apart from the operator's own.
NOISE = """Append AppendLine Array BoundedRegex CancellationToken Code Console Count DateTime Dictionary Directory Dispose Encoding Enumerable Error Escape File Flush IEnumerable IsMatch Kind
  Language Length List Match Matches Math Name None Option Options Path Read ReadLine Record Regex Replace Result Results String StringBuilder Task Token ToString Unescape Value Values
  Version Write WriteLine""".split()
LOGICAL = f"case when reference_kind in {in_list(schema.EVENT_KINDS)} then 'subscribe' else reference_kind end"
CALLABLE = f"reference_kind in {in_list(schema.CALLABLE_KINDS)}"
SITES = f"sites as (select file_id, symbol_name, line, column_number, {LOGICAL} as kind, min(ref_id) as ref_id from r where symbol_name is not null group by all)"
DEFS = """d as (select f.lang, s.name_folded, count(*) as definitions, count(distinct s.file_id) as files, min(symbol_id) as least_id,
  min(coalesce(family_key, 'sym:' || symbol_id)) as lo, max(coalesce(family_key, 'sym:' || symbol_id)) as hi
  from s join f on f.file_id = s.file_id where s.name_folded is not null group by f.lang, s.name_folded)"""
