"""Source files that do not parse (problem 3).

A file is cut into blocks of lines and each block is scanned where its chunks lie, into a
lexer-state map with a bracket summary; maps of a file are composed in order. Where the
composed map shows that the file is broken, that is the verdict; else its text is read by
the local grammar of its language. Nearly every file is one block, so this takes one exchange
of text by file. The blocks of a huge file are scanned in as many tasks; its text is then put
together in one task, for the verdict is the grammar's whatever the size of a file.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.grammar import PARSERS, why_invalid
from skerry.llm.lexstate import CODE, Effect, StateMap, compose, state_map, surely_invalid
from skerry.runtime import shuffle_partitions, spread

LANGUAGES = tuple(PARSERS)
#: The verdict of a map.
UNBALANCED = "unbalanced"
#: Lines of a block, which is scanned in one task.
BLOCK_LINES = 20_000
#: Pieces in which a block is scanned.
_PIECE_LINES = 5_000
#: Chunks that a split remembers, to hand on copies of a chunk once.
_REMEMBERED = 500_000


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        keys = zip(batch.column("file_id").to_pylist(), batch.column("start_line").to_pylist(), (None if c is None else xxhash.xxh3_128_intdigest(c) for c in batch.column("content").to_pylist()))
        keep = []
        for k in keys:
            keep.append(k not in seen)
            seen.add(k)
        if len(seen) > _REMEMBERED:
            seen.clear()
        yield batch if all(keep) else batch.filter(pa.array(keep))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """(file_id, start_line, content) without the copies that lie in one input split.

    Copies of a row are dropped before any exchange, so a chunk that is repeated without end
    reaches its file's task once from each split.
    """
    rows = chunks.where(F.col("file_id").isNotNull()).select(
        F.col("file_id").cast("bigint").alias("file_id"), F.coalesce(F.col("start_line").cast("int"), F.lit(1)).alias("start_line"), F.col("content").cast("string").alias("content")
    )
    return spread(rows).mapInArrow(_without_copies, "file_id bigint, start_line int, content string")


def file_languages(files: DataFrame) -> DataFrame:
    """(file_id, lang, repo) of each file, lang in lower case, the greatest where rows differ."""
    return files.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(
        F.max(F.lower(F.trim("lang"))).alias("lang"), F.max(F.substring_index("path", "/", 1)).alias("repo")
    )


class _Lines:
    """The lines of one block of a file, by number, from chunks that overlap."""

    def __init__(self) -> None:
        self.lines: dict[int, str] = {}
        self.chunks = 0
        self.more = False  # whether the file goes on in another block

    def add(self, start: int, content: str | None, lo: int, hi: int) -> None:
        self.chunks += 1
        k = start
        for k, line in enumerate((content or "").split("\n"), start):
            if lo <= k < hi:
                self.lines.setdefault(k, line)
        self.more |= k >= hi

    def numbers(self) -> list[int]:
        return sorted(self.lines)


def _block_map(lang: str, lines: list[str], first: bool) -> StateMap:
    whole: StateMap | None = None
    for at in range(0, max(len(lines), 1), _PIECE_LINES):
        piece = state_map(lang, "\n".join(lines[at : at + _PIECE_LINES]) + "\n", first and whole is None)
        whole = piece if whole is None else compose(whole, piece)
    return whole


def _packed(maps: dict[str, StateMap]) -> str:
    return json.dumps({lang: {s: [*e] for s, e in m.items()} for lang, m in maps.items()})


def _unpacked(text: str) -> dict[str, StateMap]:
    return {lang: {s: Effect(*e) for s, e in m.items()} for lang, m in json.loads(text).items()}


def judge(lang: str, lines: list[str]) -> str | None:
    """What is wrong with a file of one block: by its map, if that is sure, else by the grammar."""
    if surely_invalid(_block_map(lang, lines, True)[CODE]):
        return UNBALANCED
    return why_invalid(lang, "\n".join(lines))


def _judge_blocks(block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = lang = repo = None
        block = _Lines()

        def close() -> None:
            if key is None or not (block.chunks or lang is not None):
                return
            lines = [block.lines[k] for k in block.numbers()]
            if key[1] == 0 and lang not in PARSERS:
                out.append((*key, lang, repo, block.chunks, None, None, None))
            elif key[1] == 0 and block.more:
                maps = {lang: _block_map(lang, lines, True)}
                out.append((*key, lang, repo, block.chunks, None, _packed(maps), "\n".join(lines) if lines else None))
            elif key[1] == 0:
                out.append((*key, lang, repo, block.chunks, judge(lang, lines) if block.chunks else None, None, None))
            else:
                maps = {x: _block_map(x, lines, False) for x in LANGUAGES}
                out.append((*key, None, None, block.chunks, None, _packed(maps), "\n".join(lines) if lines else None))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 8
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "block", "lang", "repo", "chunks", "why", "map", "text"])
            out.clear()
            return batch

        for batch in batches:
            for file_id, b, start, row_lang, row_repo, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "block", "start_line", "lang", "repo", "content"))):
                if (file_id, b) != key:
                    close()
                    key, lang, repo, block = (file_id, b), None, None, _Lines()
                if start is None:
                    lang, repo = row_lang, row_repo
                elif b > 0 or lang in PARSERS:
                    block.add(start, content, b * block_lines, (b + 1) * block_lines)
            if len(out) >= 1000:
                yield flush()
        close()
        yield flush()

    return run


def _whole_file(blocks: list[dict], lang: str) -> str | None:
    """The verdict on a file of several blocks, from their maps and texts in order."""
    maps = [_unpacked(b["map"])[lang] for b in blocks]
    if surely_invalid(functools.reduce(compose, maps)[CODE]):
        return UNBALANCED
    return why_invalid(lang, "\n".join(b["text"] for b in blocks if b["text"] is not None))


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each file of a known language with a chunk; maps are composed and texts read where a file has several blocks."""
    for batch in batches:
        rows = [r for r in batch.to_pylist() if r["lang"] in PARSERS and r["chunks"] > 0]
        why = [_whole_file(r["blocks"], r["lang"]) if r["blocks"] else r["why"] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["file_id"] for r in rows], pa.int64()), pa.array([r["lang"] for r in rows], pa.string()), pa.array([r["repo"] for r in rows], pa.string()),
                pa.array([w is None for w in why], pa.bool_()), pa.array(why, pa.string()),
            ],
            names=["file_id", "lang", "repo", "valid", "why"],
        )


def syntax_verdicts(files: DataFrame, chunks: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Each file of a known language with a chunk: (file_id, lang, repo, valid, why).

    Known are python, javascript, java, csharp, go and json, in any letter case. The text of a file
    is the lines of its chunks by number, a line that several chunks hold being taken once; null
    contents are empty. An empty text is valid except as go and json. Files without a chunk, chunks
    without a file and null ids give no row; copies of rows don't count. Only syntax counts, and the
    verdict doesn't depend on ``block_lines``. Python that is nested too deep for the interpreter's own
    parser counts as valid.
    """
    spark = files.sparkSession
    rows = chunk_rows(chunks)
    last = F.col("start_line") + F.length("content") - F.length(F.translate("content", "\n", ""))
    block_of = lambda at: F.greatest(F.floor(at / block_lines), F.lit(0)).cast("int")
    spans = F.sequence(block_of(F.col("start_line")), block_of(F.coalesce(last, F.col("start_line"))))
    # the first block of a file also learns of chunks beyond it, without their text
    blocks = rows.withColumn("first", block_of(F.col("start_line"))).select(
        "file_id", F.explode(F.array_union(F.array(F.lit(0)), spans)).alias("block"), "first", "start_line", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("repo"), "content",
    ).withColumn("content", F.when(F.col("block") >= F.col("first"), F.col("content"))).drop("first")
    heads = file_languages(files).select(
        "file_id", F.lit(0).alias("block"), F.lit(None).cast("int").alias("start_line"), "lang", "repo", F.lit(None).cast("string").alias("content")
    )
    grouped = heads.unionByName(blocks).repartition(shuffle_partitions(spark), "file_id", "block").sortWithinPartitions("file_id", "block", F.col("start_line").asc_nulls_first())
    judged = grouped.mapInArrow(_judge_blocks(block_lines), "file_id bigint, block int, lang string, repo string, chunks bigint, why string, map string, text string")
    by_file = judged.groupBy("file_id").agg(
        F.max("lang").alias("lang"), F.max("repo").alias("repo"), F.sum("chunks").alias("chunks"), F.max("why").alias("why"), F.max("block").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("map").isNotNull(), F.struct("block", "map", "text")))).alias("blocks"),
    )
    return by_file.select("file_id", "lang", "repo", "chunks", "why", "blocks").mapInArrow(_verdicts, "file_id bigint, lang string, repo string, valid boolean, why string")


def invalid_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose text isn't valid in their language: (file_id)."""
    return syntax_verdicts(files, chunks).where(~F.col("valid")).select("file_id")


def invalid_rates(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, lang, files, invalid, invalid_without_symbols, rate) of each repository and language."""
    named = symbols.where("kind is not null and file_id is not null").groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(F.count("*").alias("symbols"))
    rows = syntax_verdicts(files, chunks).join(named, "file_id", "left")
    bad = F.when(~F.col("valid"), 1).otherwise(0)
    return rows.groupBy("repo", "lang").agg(
        F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.sum(F.when(F.col("symbols").isNull(), bad).otherwise(0)).alias("invalid_without_symbols"), F.avg(bad.cast("double")).alias("rate")
    )
