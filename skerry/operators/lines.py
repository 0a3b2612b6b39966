"""Line-level reads and searches over chunks that overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.predicates import path_bucket
from skerry.runtime import cut_lineage, measured_side, shuffle_partitions


def file_lines(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_id, line, text) of each line of each file, once, for work that needs all lines.

    A chunk owns its lines up to the start of the next chunk of its file; a copy of a chunk owns
    nothing, since its successor starts where it does. Null contents have no lines. This exchanges
    contents by file; ``matching_lines`` and ``lines_at`` don't.
    """
    w = Window.partitionBy("file_id").orderBy("start_line", "chunk_id")
    rows = chunks.where("content is not null").select("file_id", "chunk_id", "start_line", "content", F.lead("start_line").over(w).alias("next"))
    lines = rows.where("next is null or next > start_line").select("file_id", "chunk_id", "start_line", "next", F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    return lines.select("file_id", "chunk_id", (F.col("start_line") + F.col("k")).alias("line"), "text", "next").where("next is null or line < next").drop("next")


def _owned(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the copies of a line, in chunks that overlap or are copies, the one in the last chunk that has it."""
    last = F.max_by(F.struct("chunk_id", "text"), F.struct("start_line", "chunk_id")).alias("last")
    found = rows.groupBy("file_id", "line", *keys).agg(last)
    return found.select("file_id", F.col("last.chunk_id").alias("chunk_id"), "line", F.col("last.text").alias("text"), *keys)


def matching_lines(chunks: DataFrame, found: Callable[[Column], Column], maybe: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file_id, chunk_id, line, text) of the lines that ``found`` holds for, each once.

    Lines are looked at where their chunks lie; only those found are exchanged. ``maybe`` is a test that
    holds for every content with such a line, and keeps the others from being cut into lines. Null
    contents have no lines.
    """
    rows = chunks.where("content is not null")
    if maybe is not None:
        rows = rows.where(maybe(F.col("content")))
    lines = rows.select("file_id", "chunk_id", "start_line", F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    return _owned(lines.where(found(F.col("text"))).select("file_id", "chunk_id", "start_line", (F.col("start_line") + F.col("k")).alias("line"), "text"))


def literal_lines(chunks: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """(file_id, chunk_id, line, text) of the lines that hold ``query``, without regard to case unless ``exact``."""
    if exact:
        holds = lambda c: F.contains(c, F.lit(query))
    else:
        holds = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    return matching_lines(chunks, holds, None if "\n" in query else holds)


def lines_at(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, line, text) of the lines (file_id, line) of ``wanted``, where they exist.

    The wanted lines are gathered by file and meet the chunks of that file; they are written and
    counted first, and chunks are only exchanged where the files that are wanted are too many to broadcast.
    """
    by_file = measured_side(wanted.select("file_id", "line").groupBy("file_id").agg(F.sort_array(F.collect_set("line")).alias("wanted")))
    held = chunks.where("content is not null").select("file_id", "chunk_id", "start_line", "content").join(by_file, "file_id")
    parts = held.select("file_id", "chunk_id", "start_line", "wanted", F.split("content", "\n", -1).alias("parts"))
    inside = F.filter("wanted", lambda n: (n >= F.col("start_line")) & (n < F.col("start_line") + F.size("parts")))
    rows = parts.select("file_id", "chunk_id", "start_line", "parts", F.explode(inside).alias("line"))
    return _owned(rows.select("file_id", "chunk_id", "start_line", "line", F.get("parts", F.col("line") - F.col("start_line")).alias("text"))).drop("chunk_id")


def overlaps_itself(text: str) -> bool:
    return any(text[:k] == text[-k:] for k in range(1, len(text)))


def positions(text: Column, query: str) -> Column:
    """All places, from 1, where ``query`` begins, overlapping ones included."""
    n = len(query)
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if not overlaps_itself(query):  # the parts between occurrences tell where they are, in one pass
        parts = F.split(text, quoted, -1)
        ends = F.aggregate(
            parts,
            F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
            lambda a, p: F.struct((a["at"] + F.length(p) + n).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")),
            lambda a: a["found"],
        )
        return F.slice(ends, 1, F.size(parts) - 1)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)) == query)


def find_literal(chunks: DataFrame, files: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """(path, bucket, line, column, text) of all occurrences in each line, without regard to case unless ``exact``."""
    text, wanted = (F.col("text"), query) if exact else (F.lower("text"), query.lower())
    hits = literal_lines(chunks, query, exact).withColumn("column", F.explode(positions(text, wanted)))
    return hits.join(files.select("file_id", "path"), "file_id").select("path", path_bucket(F.col("path")).alias("bucket"), "line", "column", "text")


def find_regex(chunks: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, ordinal, match) of all non-overlapping matches in each line; the pattern is one that Java and RE2 read alike."""
    rows = matching_lines(chunks, lambda c: c.rlike(pattern))
    hits = rows.select("file_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ordinal", "match"))
    return hits.join(files.select("file_id", "path"), "file_id").select("path", "line", "ordinal", "match")


def with_context(chunks: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """(file_id, hit_line, line, text) of the lines around each hit; an equi-join on the line number, no range join."""
    around = hits.select("file_id", F.col("line").alias("hit_line"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    return around.join(lines_at(chunks, around), ["file_id", "line"]).select("file_id", "hit_line", "line", "text")


def excerpts(chunks: DataFrame, ranges: DataFrame, before: int = 0, after: int = 0, width: int | None = None) -> DataFrame:
    """(file_id, start_line, end_line, excerpt) for ranges of lines with context, clamped to the file.

    Ranges stay two numbers, however many lines they span; only the numbers of their files are broadcast, if
    few. Contents of these files move once, by file, where a chunk owns its lines up to the start of the next
    one and gives each range its own part of it.
    """
    lo, hi = F.greatest(F.col("start_line") - before, F.lit(1)), F.col("end_line") + after
    spans = cut_lineage(ranges.select("file_id", "start_line", "end_line", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").distinct())
    files = measured_side(spans.select("file_id").distinct())
    w = Window.partitionBy("file_id").orderBy("at", "chunk_id")
    held = chunks.where("content is not null").select("file_id", "chunk_id", F.col("start_line").alias("at"), "content").join(files, "file_id", "left_semi")
    owned = held.select("file_id", "at", "content", F.lead("at").over(w).alias("next")).where("next is null or next > at")
    parts = owned.select("file_id", "at", "next", F.split("content", "\n", -1).alias("parts")).select("file_id", "at", "parts", F.least(F.col("at") + F.size("parts"), "next").alias("stop"))
    first, last = F.greatest("lo", "at"), F.least("hi", F.col("stop") - 1)
    rows = F.slice("parts", first - F.col("at") + 1, last - first + 1)
    if width is not None:
        rows = F.transform(rows, lambda t: F.substring(t, 1, width))
    met = parts.join(spans, "file_id").where("lo < stop and hi >= at").select("file_id", "start_line", "end_line", "at", F.array_join(rows, "\n").alias("t"))
    found = met.groupBy("file_id", "start_line", "end_line").agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("rows"))
    return found.select("file_id", "start_line", "end_line", F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("excerpt"))


def file_texts(chunks: DataFrame, most_lines: int | None = None) -> DataFrame:
    """(file_id, text) of every file, up to line ``most_lines``.

    Chunks move once, by file, and are put together there: of each the lines up to the start of the next one.
    """
    rows = chunks.where("content is not null").groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct("start_line", "chunk_id", "content"))).alias("parts"))
    start = lambda k: F.get("parts", k)["start_line"]
    end = lambda k: F.coalesce(start(k + 1), F.lit(2**31 - 1))
    if most_lines is not None:
        inner, end = end, lambda k: F.least(inner(k), F.lit(most_lines + 1))
    lines = F.flatten(F.transform("parts", lambda p, k: F.slice(F.split(p["content"], "\n", -1), 1, F.greatest(end(k) - p["start_line"], F.lit(0)))))
    return rows.select("file_id", lines.alias("lines")).where(F.size("lines") > 0).select("file_id", F.array_join("lines", "\n").alias("text"))


def clamp_line(text: Column, width: int, column: Column, length: Column) -> Column:
    """At most ``width`` characters around a match."""
    start = F.greatest(F.lit(1), F.least(column - F.floor((F.lit(width) - length) / 2).cast("int"), F.length(text) - width + 1))
    return F.when(F.length(text) <= width, text).otherwise(F.substring(text, start.cast("int"), F.lit(width)))


def find_windows(lines: DataFrame, pattern: str, window_lines: int = 8, window_bytes: int = 64 * 1024) -> DataFrame:
    """(file_id, line, column, end_line, match) of matches that may span lines.

    A match starts on its owner line and is sought in the text of that line and the next ones, up to
    ``window_lines`` lines or ``window_bytes`` bytes. Text that a match has consumed starts no other.
    Lines come sorted by file and number and stream through a window, so no file is ever held.
    """
    if not 1 <= window_lines <= 64 or not 1 <= window_bytes <= 256 * 1024:
        raise ValueError("window too large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = regex.compile(pattern)
        held: list[tuple[int, int, str]] = []
        free = (0, 0)  # line and column up to which text is consumed
        out: list[tuple] = []

        def owner() -> None:
            nonlocal free
            file_id, line, first = held[0]
            window, size = [first], len(first.encode())
            for k, (_, number, text) in enumerate(held[1:window_lines], 1):
                size += len(text.encode()) + 1
                if number != line + k or size > window_bytes:
                    break
                window.append(text)
            whole = "\n".join(window)
            at = free[1] if free[0] == line else (0 if free[0] < line else len(first) + 1)
            while at <= len(first):
                m = search.search(whole, at)
                if m is None or m.start() > len(first):
                    break
                if m.end() > m.start():
                    inner = whole[m.start() : m.end()].count("\n")
                    tail = m.end() - (whole.rfind("\n", 0, m.end()) + 1)
                    out.append((file_id, line, m.start() + 1, line + inner, m.group()))
                    if inner:
                        free = (line + inner, tail)
                        break
                at = max(m.end(), m.start() + 1)

        def drop() -> None:
            owner()
            held.pop(0)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file_id", "line", "column", "end_line", "match"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file_id", "line", "text"))):
                if held and held[0][0] != row[0]:
                    while held:
                        drop()
                    free = (0, 0)
                held.append(row)
                if len(held) > window_lines:
                    drop()
            yield flush()
        while held:
            drop()
        yield flush()

    ordered = lines.select("file_id", "line", "text").repartition(shuffle_partitions(lines.sparkSession), "file_id").sortWithinPartitions("file_id", "line")
    return ordered.mapInArrow(run, "file_id bigint, line int, column int, end_line int, match string")
