"""The tables of an index, their clean views, and the fixed values that operators share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.runtime import table

FILES = "file_id BIGINT, path STRING, lang STRING, size BIGINT, lines INT, checksum STRING, modified TIMESTAMP, generated BOOLEAN, indexed_at TIMESTAMP"
CHUNKS = "chunk_id BIGINT, file_id BIGINT, chunk_index INT, start_line INT, end_line INT, content STRING"
SYMBOLS = (
    "symbol_id BIGINT, file_id BIGINT, kind STRING, sub_kind STRING, name STRING, line INT, start_line INT, start_column INT, end_line INT, body_start_line INT,"
    " body_end_line INT, signature STRING, container_kind STRING, container_name STRING, container_qualified_name STRING, family_key STRING, visibility STRING,"
    " return_type STRING, name_folded STRING"
)
REFS = (
    "ref_id BIGINT, file_id BIGINT, symbol_name STRING, reference_kind STRING, line INT, column_number INT, span_length INT, context STRING, container_kind STRING,"
    " container_name STRING, source_symbol_id BIGINT, target_symbol_id BIGINT, target_symbol_key STRING, target_qualifier STRING, resolution_state STRING,"
    " resolution_candidate_count INT, symbol_name_folded STRING, container_name_folded STRING, is_self_reference BOOLEAN, is_mutual_recursion BOOLEAN"
)
ISSUES = "file_id BIGINT, kind STRING, line INT, message STRING, origin STRING, severity STRING"


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


#: Kinds of references and what they weigh.
CALLABLE_KINDS = ("augmentation", "call", "instantiate", "generic_type_argument", "subscribe", "unsubscribe", "razor_event_binding", "friend", "consumes_hook", "capture", "project_reference")
EVENT_KINDS = ("subscribe", "unsubscribe", "razor_event_binding")
IMPACT_KINDS = ("call", "instantiate", "subscribe", "unsubscribe", "razor_event_binding", "capture")
HOTSPOT_WEIGHTS = {"call": 10, "instantiate": 10, "subscribe": 3, "friend": 3, "type_reference": 1}  # tenths
CALLER_WEIGHTS = {"instantiate": 30, "call": 10, "generic_type_argument": 5, "subscribe": 1, "unsubscribe": 1, "razor_event_binding": 1}  # tenths
TOP_LEVEL = "<top-level>"


def latest_files(files: DataFrame) -> DataFrame:
    """One row for each file_id: the last one written, by indexed_at and then by the other columns."""
    order = ["indexed_at", "modified", "checksum", "size", "lines", "path", "lang", "generated"]
    row = F.max(F.struct(*order)).alias("row")
    rows = files.where("file_id is not null").groupBy("file_id").agg(row)
    return rows.select("file_id", "row.path", F.lower("row.lang").alias("lang"), "row.size", "row.lines", "row.checksum", "row.modified", "row.generated", "row.indexed_at")


@dataclass(frozen=True)
class Index:
    """The clean views of one index folder; copies of rows are gone."""

    spark: SparkSession
    root: str

    @cached_property
    def files(self) -> DataFrame:
        return latest_files(table(self.spark, self.root, "files", *names(FILES)))

    @cached_property
    def chunks(self) -> DataFrame:
        """Copies remain; the line views leave them out without an exchange of their own."""
        return table(self.spark, self.root, "chunks", *names(CHUNKS))

    @cached_property
    def symbols(self) -> DataFrame:
        return table(self.spark, self.root, "symbols", *names(SYMBOLS)).distinct()

    @cached_property
    def refs(self) -> DataFrame:
        return self.raw_refs.distinct()

    @cached_property
    def raw_refs(self) -> DataFrame:
        """With copies of rows, for operators on sites, names and edges, which tell them apart anyway: no exchange of whole rows."""
        return table(self.spark, self.root, "refs", *names(REFS))

    def refs_of(self, *columns: str) -> DataFrame:
        """References once each, with some columns only; what is exchanged to leave copies out is as narrow."""
        return table(self.spark, self.root, "refs", "ref_id", *columns).distinct()
