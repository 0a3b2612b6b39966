"""Queries of the text operators, with the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.mixing import mix_documents, mix_shares
from skerry.llm.provenance import file_origins, not_hand_written, shared_subtrees
from skerry.llm.repetition import clean_lines, repetition_shares, repetitive_documents
from skerry.llm.splitting import piece_texts, split_chunks
from skerry.llm.syntax import invalid_files, invalid_rates
from skerry.llm.tokenizer import encode_documents
from skerry.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return invalid_files(table(spark, root, "files"), table(spark, root, "chunks"))


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    return invalid_rates(table(spark, root, "files"), table(spark, root, "chunks"), table(spark, root, "symbols"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return split_chunks(table(spark, root, "chunks")).select("chunk_id", "piece_index", "start_line", "end_line")


def p4_texts(spark: SparkSession, root: str) -> DataFrame:
    return piece_texts(table(spark, root, "chunks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return not_hand_written(table(spark, root, "files"), table(spark, root, "chunks"))


def p6_origins(spark: SparkSession, root: str) -> DataFrame:
    """Files by repository and origin."""
    origins = file_origins(table(spark, root, "files"), table(spark, root, "chunks"))
    return origins.groupBy(F.substring_index("path", "/", 1).alias("repo"), "origin").agg(F.count("*").alias("files"))


def p6_shared(spark: SparkSession, root: str) -> DataFrame:
    return shared_subtrees(table(spark, root, "files"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_documents(table(spark, root, "documents"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix_shares(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix_documents(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return repetitive_documents(table(spark, root, "documents"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return repetition_shares(table(spark, root, "documents")).select("doc_id", "words", "repeated_words", "share")


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    return clean_lines(table(spark, root, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_texts": p4_texts,
    "p6_found": p6_found,
    "p6_origins": p6_origins,
    "p6_shared": p6_shared,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_clean": p9_clean,
}

_P9 = """
with w as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as ws from documents),
g as (select doc_id, p, array_to_string(list_slice(ws, p, p + 7), ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as p from w where len(ws) >= 8)),
again as (select doc_id, p from (select doc_id, p, min(p) over (partition by doc_id, gram) as first from g) where p > first),
hit as (select doc_id, count(distinct p + k) as n from again, range(0, 8) t(k) group by doc_id),
s as (select w.doc_id, len(ws) as words, coalesce(n, 0) as repeated_words from w left join hit on hit.doc_id = w.doc_id)
"""

#: The rule piece by piece: from the first new line and the lines repeated before it the furthest line that fits, or the pause before that.
_P4 = """
with recursive c as (select distinct chunk_id, coalesce(start_line, 1) as first, content from chunks where length(content) > 4000),
l as (select row_number() over (order by chunk_id, first, content) as item, chunk_id, first, string_split(content, chr(10)) as lines from c),
t as (select item, chunk_id, first, len(lines) as n, list_transform(lines, lambda x: length(x)) as size, list_prepend(0, list_transform(range(1, len(lines) + 1), lambda k: list_sum(list_transform(list_slice(lines, 1, k), lambda x: length(x) + 1)))) as offs,
  list_filter(range(0, len(lines)), lambda k: regexp_full_match(lines[k + 1], '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\v]*')) as blanks from l),
w as (
  select item, 0 as new, 0 as rep, 0 as done, -1 as piece, 0 as a, 0 as b, -1 as part from t
  union all
  select item, case when long then case when done + 4000 >= size then new + 1 else new end else b + 1 end, case when long then 0 else least(3, b - a + 1) end, case when long and done + 4000 < size then done + 4000 else 0 end, piece + 1, a, b, case when long then done else -1 end from (
    select *, case when long then new when reach < n - 1 and next_size <= 4000 and pause is not null then pause else reach end as b from (
      select *, list_max(list_filter(blanks, lambda k: k <= reach and k >= greatest(new, reach - 19))) as pause, sizes[reach + 2] as next_size from (
        select *, case when long then new else cast(len(list_filter(offs, lambda x: x <= offs[a + 1] + 4001)) - 2 as bigint) end as reach from (
          select w.item, w.new, w.rep, w.done, w.piece, t.n, t.size as sizes, t.offs, t.blanks, t.size[w.new + 1] as size, t.size[w.new + 1] > 4000 as long,
            case when t.size[w.new + 1] > 4000 then w.new else list_min(list_filter(range(w.new - w.rep, w.new + 1), lambda s: t.offs[w.new + 2] - 1 - t.offs[s + 1] <= 4000)) end as a
          from w join t using (item) where w.new < t.n))))
)
"""
_PIECE = "cast(piece as int) as piece_index, cast(first + a as int) as start_line, cast(first + b as int) as end_line"

#: Token ids, hashes of trees, lexers and seeded draws have no workable SQL on whole tables; see tests/llm.
SQL: dict[str, str] = {
    "p4_found": _P4 + f"select chunk_id, {_PIECE} from w join t using (item) where piece >= 0",
    "p4_texts": _P4 + f"select l.chunk_id, {_PIECE.replace('first', 'l.first')}, case when part >= 0 then substr(lines[a + 1], part + 1, 4000) else array_to_string(list_slice(lines, a + 1, b + 1), chr(10)) end as text from w join l using (item) where piece >= 0",
    "p9_found": _P9 + "select doc_id from s where words > 0 and repeated_words >= 0.35 * words",
    "p9_shares": _P9 + "select doc_id, cast(words as bigint) as words, repeated_words, case when words > 0 then repeated_words / words else 0.0 end as share from s",
}
