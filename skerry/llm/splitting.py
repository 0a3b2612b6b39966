"""Cutting oversized items at natural boundaries, with overlap (problem 4).

Items are worked on in ranges of bytes. A worker sees one range and a halo of the few bytes
of a code point that crosses its end, and gives the boundary table of the range: where its
lines end, how long they are in characters and which are blank. The tables of an item are
stitched in order and lengths become offsets by prefix sums; the pieces are cut on these
numbers alone, and the text of a piece is later taken from its ranges by offset. No worker in Python
ever holds a whole item, and the text isn't shuffled unless an item is very large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP_LINES = 3
BACK_LINES = 20
#: Bytes of a range.
RANGE = 1 << 20
_HALO = 3
#: Items of more bytes than this have their ranges dealt out over the cluster.
_GIANT = 16 << 20

_TABLE = "item string, range int, chars array<int>, blank array<boolean>"


def range_bounds(data: bytes, first: bool, own: int) -> tuple[int, int]:
    """Where the code points of a range begin and end in its data: those whose first byte lies in its own bytes."""
    start = 0
    if not first:
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
    end = own
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def range_table(data: bytes, first: bool, own: int) -> tuple[np.ndarray, list[bool]]:
    """The boundary table of one range.

    ``data`` holds ``own`` bytes of the range and a halo. The range is cut at its line feeds into
    segments, the last of which runs on in the next range. Gives for each segment its characters and
    whether it holds white space only.
    """
    start, end = range_bounds(data, first, own)
    raw = np.frombuffer(data, dtype=np.uint8)[start:end]
    feeds = np.flatnonzero(raw == 10)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cuts = np.concatenate([[-1], feeds, [len(raw)]])
    body = data[start:end].decode("utf-8", "replace")
    return lead[cuts[1:]] - lead[cuts[:-1] + 1], [not s.strip() for s in body.split("\n")]


def _range_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [range_table(d.as_py(), r.as_py() == 0, o.as_py()) for d, r, o in zip(batch.column("data"), batch.column("range"), batch.column("own"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("range"), pa.array([x[0] for x in rows], pa.list_(pa.int32())), pa.array([x[1] for x in rows], pa.list_(pa.bool_()))],
            names=["item", "range", "chars", "blank"],
        )


def stitch(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and blankness of the lines of an item, from the tables of its ranges in order: the last segment of one goes on in the first of the next."""
    sizes = np.array([len(chars) for chars, _ in tables])
    chars = np.concatenate([np.asarray(c, dtype=np.int64) for c, _ in tables])
    blank = np.concatenate([np.asarray(b, dtype=bool) for _, b in tables])
    begins = np.ones(len(chars), dtype=bool)
    begins[np.cumsum(sizes)[:-1]] = False
    at = np.flatnonzero(begins)
    return np.add.reduceat(chars, at), np.logical_and.reduceat(blank, at)


def cut(chars: np.ndarray, blank: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP_LINES, back: int = BACK_LINES) -> list[tuple[int, int, int, int]]:
    """The pieces of an item: (first line, last line, first character, length), lines from 0.

    ``limit`` counts characters with the line feeds inside a piece. See ``split_items`` for the rule.
    """
    n = len(chars)
    offset = np.concatenate([[0], np.cumsum(chars + 1)])  # of each line's first character
    blanks = np.flatnonzero(blank)
    pieces: list[tuple[int, int, int, int]] = []
    new = 0
    repeat = 0  # lines repeated at the start of the next piece
    while new < n:
        if chars[new] > limit:
            at, end = int(offset[new]), int(offset[new] + chars[new])
            while at < end:
                pieces.append((new, new, at, min(limit, end - at)))
                at += limit
            new, repeat = new + 1, 0
            continue
        start = new - repeat
        while start < new and offset[new + 1] - 1 - offset[start] > limit:
            start += 1
        # the last line whose end lies within the limit
        last = int(np.searchsorted(offset, offset[start] + limit + 1, side="right")) - 2
        last = min(last, n - 1)
        if last < n - 1 and chars[last + 1] <= limit:
            k = int(np.searchsorted(blanks, last, side="right")) - 1
            if k >= 0 and blanks[k] >= max(new, last - back + 1):
                last = int(blanks[k])
        pieces.append((start, last, int(offset[start]), int(offset[last + 1] - 1 - offset[start])))
        repeat = min(overlap, last - start + 1)
        new = last + 1
    return pieces


_PIECE = "item string, piece_index int, line_from int, line_to int, char_from bigint, n_chars bigint, parts array<struct<range: int, at: int, n: int>>"


def _pieces_of(limit: int, overlap: int, back: int):
    def run(item: pa.Table) -> pa.Table:
        tables = {}
        for k, r in enumerate(item["range"].to_pylist()):
            if r not in tables:  # copies of an item give equal tables
                tables[r] = tuple(item[c].combine_chunks()[k].values.to_numpy(zero_copy_only=False) for c in ("chars", "blank"))
        order = [tables[r] for r in sorted(tables)]
        pieces = cut(*stitch(order), limit, overlap, back)
        # the character at which each range begins; a line feed belongs to the range it lies in
        starts = np.concatenate([[0], np.cumsum([int(c.sum()) + len(c) - 1 for c, _ in order])])
        parts = []
        for _, _, at, n in pieces:
            lo = int(np.searchsorted(starts, at, side="right")) - 1
            hi = int(np.searchsorted(starts, at + n, side="left"))
            parts.append([{"range": r, "at": max(0, at - int(starts[r])), "n": min(at + n, int(starts[r + 1])) - max(at, int(starts[r]))} for r in range(lo, min(hi, len(order)))])
        name = item["item"][0].as_py()
        return pa.table(
            {
                "item": pa.array([name] * len(pieces), pa.string()),
                "piece_index": pa.array(range(len(pieces)), pa.int32()),
                "line_from": pa.array([p[0] for p in pieces], pa.int32()),
                "line_to": pa.array([p[1] for p in pieces], pa.int32()),
                "char_from": pa.array([p[2] for p in pieces], pa.int64()),
                "n_chars": pa.array([p[3] for p in pieces], pa.int64()),
                "parts": pa.array(parts, pa.list_(pa.struct([("range", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]))),
            }
        )

    return run


def _slices(items: DataFrame, item: str, content: str) -> DataFrame:
    """(item, range, giant, data, own): the ranges of the items, each with its halo."""
    rows = items.select(F.col(item).alias("item"), F.encode(F.col(content), "utf-8").alias("bytes")).where(F.col("bytes").isNotNull())
    size = F.length("bytes")
    ranges = rows.select(
        "item", "bytes", (size > _GIANT).alias("giant"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / RANGE).cast("int") - 1, F.lit(0)))).alias("range"),
    )
    pos = F.col("range") * RANGE
    return ranges.select(
        "item", "range", "giant",
        F.substring("bytes", pos + 1, F.lit(RANGE + _HALO)).alias("data"),
        F.least(F.lit(RANGE), F.length("bytes") - pos).cast("int").alias("own"),
    )


def split_items(items: DataFrame, item: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP_LINES, back: int = BACK_LINES) -> DataFrame:
    """Pieces of each item: (item, piece_index, line_from, line_to, char_from, n_chars, parts), lines from 0.

    ``item`` is a text that names the item; rows with the same name must hold the same content and
    count once. Lines are what lies between line feeds. A piece is a run of whole lines of at most
    ``limit`` characters and reaches to the furthest line that fits; unless the item's end or an
    overlong line follows, it ends with the last blank line among the last ``back`` lines of that
    reach, as far as they are new. The next piece first repeats the last ``overlap`` lines of this
    one, less as many of the earliest as needed for its first new line to fit. A line of over
    ``limit`` characters is cut every ``limit`` characters, nothing being repeated in or right after
    these pieces. An item within the limit is one piece; null contents give none, empty ones one
    empty piece. ``parts`` tells in which ranges a piece lies, from which of their characters on and
    for how many.
    """
    spark = items.sparkSession
    slices = _slices(items, item, content)
    near = slices.where(~F.col("giant")).drop("giant").mapInArrow(_range_tables, _TABLE)
    far = slices.where("giant").drop("giant").repartition(2 * spark.sparkContext.defaultParallelism, "item", "range").mapInArrow(_range_tables, _TABLE)
    tables = near.unionByName(far).select("item", "range", "chars", "blank")
    return tables.groupBy("item").applyInArrow(_pieces_of(limit, overlap, back), _PIECE)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each part of a piece, from the range that it lies in."""
    for batch in batches:
        last, body, texts = None, "", []
        for data, r, own, at, n in zip(*(batch.column(c) for c in ("data", "range", "own", "at", "n"))):
            data = data.as_py()
            if data is not last and data != last:
                start, end = range_bounds(data, r.as_py() == 0, own.as_py())
                last, body = data, data[start:end].decode("utf-8", "replace")
            texts.append(body[at.as_py() : at.as_py() + n.as_py()])
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("piece_index"), batch.column("range"), pa.array(texts, pa.string())], names=["item", "piece_index", "range", "text"])


def split_texts(items: DataFrame, item: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP_LINES, back: int = BACK_LINES) -> DataFrame:
    """The pieces of ``split_items`` with their text: (item, piece_index, line_from, line_to, text).

    A piece is taken from the ranges that it lies in, nearly always one, which meet it by item and
    range; no whole item is put together again.
    """
    pieces = split_items(items, item, content, limit, overlap, back)
    wanted = pieces.select("item", "piece_index", F.explode("parts").alias("part")).select("item", "piece_index", "part.*")
    slices = _slices(items, item, content).groupBy("item", "range").agg(F.first("data").alias("data"), F.first("own").alias("own"))
    found = wanted.join(slices, ["item", "range"]).select("item", "piece_index", "range", "at", "n", "data", "own").mapInArrow(_cut_out, "item string, piece_index int, range int, text string")
    texts = found.groupBy("item", "piece_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "text"))), lambda p: p["text"]), "").alias("text"))
    return pieces.join(texts, ["item", "piece_index"], "left").select("item", "piece_index", "line_from", "line_to", F.coalesce("text", F.lit("")).alias("text"))


def _oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """(item, content) of the chunks over the limit; an item is named by id, first line and content."""
    name = F.concat_ws(" ", F.coalesce(F.col("chunk_id").cast("string"), F.lit("null")), F.coalesce("start_line", F.lit(1)).cast("string"), F.sha2("content", 256))
    return chunks.where(F.length("content") > limit).select(name.alias("item"), "content")


def _of_chunks(pieces: DataFrame, *more: str) -> DataFrame:
    first = F.split("item", " ")[1].cast("int")
    return pieces.select(
        F.expr("try_cast(split(item, ' ')[0] as bigint)").alias("chunk_id"), "piece_index", (first + F.col("line_from")).alias("start_line"), (first + F.col("line_to")).alias("end_line"), *more
    )


def split_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pieces of each distinct chunk of over ``limit`` characters: (chunk_id, piece_index, start_line, end_line, char_from, n_chars).

    Chunks that differ in chunk_id, start_line or content are distinct; null contents are left out, a
    null start_line counts as 1, and end_line isn't used.
    """
    return _of_chunks(split_items(_oversized(chunks, limit), "item", "content", limit), "char_from", "n_chars")


def piece_texts(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces of ``split_chunks`` with their text: (chunk_id, piece_index, start_line, end_line, text)."""
    return _of_chunks(split_texts(_oversized(chunks, limit), "item", "content", limit), "text")
