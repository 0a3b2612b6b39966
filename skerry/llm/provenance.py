"""Generated, minified and vendored files (problem 6).

Copies of third-party packages are found by Merkle hashes: hashes of files are combined
bottom-up into hashes of directories, and a subtree that occurs in several repositories
was written in at most one of them. What no second repository holds is told by its path,
by the banner in front of its code and by the layout of its text: minified code, rows of
literals. Layout is measured on each chunk where it lies, as sums that add up to those of
the file, so no text is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.syntax import chunk_rows
from skerry.runtime import cut_lineage

#: Directories and file names that tools and package managers use by convention.
GENERATED_DIRS = ("gen", "generated", "autogen", "__generated__", "generated-sources", "generated-src", "obj")
VENDORED_DIRS = ("vendor", "third_party", "third-party", "thirdparty", "external", "externals", "node_modules", "bower_components", "site-packages", "godeps", "pods", "carthage")
_GENERATED_PATH = r"(?i)(^|/)(" + "|".join(GENERATED_DIRS) + ")/"
_VENDORED_PATH = r"(?i)^[^/]+/(.*/)?((" + "|".join(VENDORED_DIRS) + r")/|(libs?|deps|packages)/[^/]+-v?\d+(\.\d+)+/)"
_GENERATED_NAME = (
    r"(?i)(^|/)("
    r"[^/]*(_pb2|_pb2_grpc)\.pyi?|[^/]*_pb\.(js|d\.ts)|[^/]*_grpc_web_pb\.js|[^/]*\.pb\.(go|cc|h|gw\.go|validate\.go)|[^/]*_grpc\.pb\.go"
    r"|zz_generated[._][^/]*|[^/]*[._-](generated|gen|autogen)\.[a-z]+|[^/]*\.g(\.i)?\.(cs|dart)|[^/]*\.designer\.(cs|vb)|[^/]*\.freezed\.dart"
    r")$"
)
#: Names whose letter case tells them from ordinary words.
_GENERATED_CLASS = r"[a-z0-9A-Z](Grpc|OuterClass)\.java$"
_BUNDLED_NAME = r"(?i)[^/]*(\.min|\.bundle|\.packed)\.(m?js|css)$"
#: Names that only count with a minified line in the text.
_MAYBE_BUNDLED_NAME = r"(?i)[^/]*[.-](min|bundle|packed|chunk)\.(m?js|css)$"

#: What tools and packages say of a file before its code.
_GENERATED_BANNER = regex.compile(
    r"(?i)<auto-?generated\b|@generated\b|\bcode generated by\b.*\bdo not edit\b|\b(auto-?generated|automatically generated) (file|code|by|from|with)\b"
    r"|\b(this|the) (file|code|source) (was|is|has been) ((auto-?|automatically )?(generated|written|created|produced|emitted)) (by|with|from) (a tool|the tool|[\w.-]*(gen|compiler|tool)[\w.-]*)"
    r"|\bdo not (edit|modify|change)\b.*\b(output|generated|produced|written|emitted) (of|by|from|with)\b|\b(generated|produced|written|emitted) by\b.*\bdo not (edit|modify|change)\b|\b(manual )?changes will be (lost|overwritten)\b"
)
_VENDORED_BANNER = regex.compile(
    r"(?i)\bbundled copy\b|\bupstream release\b.*\blicen[cs]e\b|\bcopy of [\w.-]+ v?\d+(\.\d+)+|\bvendored (from|copy)\b|\(c\) the [\w.-]+ contributors, version v?\d|^\W*[\w.-]+ v?\d+(\.\d+)+ \| \(c\)"
)

_COMMENT_START = ("//", "#", "/*", "*", "--", "<!--", ";;")
_LITERALS = regex.compile(r"^[\d\s,.()\[\]{}:;+\-_xXa-fA-F]*$")
_NUMBER = regex.compile(r"\d+")
_CODED = regex.compile(r"""(["'`])(?=[^"'`]*\d)[0-9a-zA-Z+/=_-]{16,}\1""")
_WORDY = regex.compile(r"[A-Z_-]?[a-z]{5,}")
_RECORD = regex.compile(r"^[^,;(){}=\"'<>\[\]]+(,[^,;(){}=\"'<>\[\]]*){2,}$")

#: Lines that a window owns before the next one takes over.
STRIDE = 70
MINIFIED_LINE = 200
MINIFIED_SHARE = 0.6
DATA_SHARE = 0.8
DATA_CHARS = 500
MINIFIED_CHARS = 300


def is_data_line(line: str) -> bool:
    """Whether a line holds literals only, as rows of numbers, coded strings or separated records."""
    if len(_NUMBER.findall(line)) >= 3 and _LITERALS.match(line):
        return True
    coded = sum(len(m.group()) for m in _CODED.finditer(line) if not _WORDY.search(m.group()))
    if coded >= 0.6 * len(line) and coded:
        return True
    return any(c.isdigit() for c in line) and _RECORD.match(line) is not None


def is_minified_line(line: str) -> bool:
    if len(line) < MINIFIED_LINE or line.lstrip().startswith(_COMMENT_START):
        return False
    spaces = sum(map(line.count, " \t"))
    marks = sum(map(line.count, ";{}(),=:?&|!"))
    return spaces < 0.08 * len(line) and marks > 0.12 * len(line)


def layout(lines: list[str]) -> tuple[int, int, int, int]:
    """(characters, those of minified lines, those of data lines, source map notes); blank lines and indents don't count."""
    chars = minified = data = notes = 0
    for raw in lines:
        line = raw.strip()
        if not line:
            continue
        n = len(line)
        chars += n
        if line.startswith("//# sourceMappingURL="):
            notes += 1
        elif is_minified_line(line):
            minified += n
        elif is_data_line(line):
            data += n
    return chars, minified, data, notes


#: The ends of comments over several lines, by their starts.
_SPANS = (("/*", "*/"), ("<!--", "-->"))
#: What a chunk may begin in: the comments in front of the code, or a comment over several lines among them.
_ENTRIES = ("", *(end for _, end in _SPANS))
_CODE = "code"


def leading_comment(lines: list[str], inside: str = "") -> tuple[list[str], str]:
    """The comments in front of the first line of code, and what the text ends in: code, or one of ``_ENTRIES``, the last of which it may begin in."""
    kept = []
    for raw in lines:
        line = raw.strip()
        if inside:
            kept.append(line)
            if inside in line:
                inside = ""
            continue
        start = next((s for s in _SPANS if line.startswith(s[0])), None)
        if start:
            kept.append(line)
            inside = "" if start[1] in line[2:] else start[1]
        elif line.startswith(("//", "#", "--", ";;")) or not line or line.startswith("<?xml"):
            kept.append(line)
        else:
            return kept, _CODE
    return kept, inside


def banner(lines: list[str]) -> str | None:
    """What a text says of itself, line by line."""
    for line in lines:
        if _GENERATED_BANNER.search(line):
            return "generated"
        if _VENDORED_BANNER.search(line):
            return "vendored"
    return None


#: Texts, one of which is in every banner, in lower case.
_BANNER_HINTS = ("generated", "written", "created", "produced", "emitted", "edit", "modify", "change", "copy", "upstream", "vendored", "contributors", "(c)")


def leads(lines: list[str], first: bool) -> list[str]:
    """For each of ``_ENTRIES`` how a piece that begins so ends, and the banner in its comments, with a bar between; nothing if all end in code without one."""
    out = []
    hinted = None
    for entry in _ENTRIES[:1] if first else _ENTRIES:
        kept, leaves = leading_comment(lines, entry)
        said = None
        if kept:
            if hinted is None:
                low = "\n".join(lines).lower()
                hinted = any(h in low for h in _BANNER_HINTS)
            said = banner(kept) if hinted else None
        out.append(f"{leaves}|{said or ''}")
    return [] if all(x == f"{_CODE}|" for x in out) else out


_STATS = "file_id bigint, start_line int, lead array<string>, lead_rest array<string>, own array<bigint>, rest array<bigint>, followed boolean"


def _chunk_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a row of its own figures, and a row that tells the chunk ``STRIDE`` lines before that it is followed."""
    for batch in batches:
        starts = batch.column("start_line").to_pylist()
        own, rest, lead, lead_rest = [], [], [], []
        for start, content in zip(starts, batch.column("content").to_pylist()):
            lines = (content or "").split("\n")
            own.append(layout(lines[:STRIDE]))
            rest.append(layout(lines[STRIDE:]))
            lead.append(leads(lines[:STRIDE], start <= 1))
            lead_rest.append(leads(lines[STRIDE:], False) if len(lines) > STRIDE and lead[-1] else None)
        n, kind, texts, ids = len(starts), pa.list_(pa.int64()), pa.list_(pa.string()), batch.column("file_id").to_pylist()
        none = [None] * n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids + ids, pa.int64()), pa.array(starts + [s - STRIDE for s in starts], pa.int32()), pa.array(lead + none, texts), pa.array(lead_rest + none, texts),
                pa.array(own + none, kind), pa.array(rest + none, kind), pa.array([False] * n + [True] * n, pa.bool_()),
            ],
            names=["file_id", "start_line", "lead", "lead_rest", "own", "rest", "followed"],
        )


def _banner_of(leads: Column) -> Column:
    """The first banner of a file, from the leads of its chunks in order, as long as all that is before a chunk is comment."""
    def step(acc: Column, lead: Column) -> Column:
        at = acc["at"]
        mine = F.coalesce(F.get(lead, F.when(at == _ENTRIES[1], 1).when(at == _ENTRIES[2], 2).otherwise(0)), F.lit(f"{_CODE}|"))
        said = F.substring_index(mine, "|", -1)
        over = (at == _CODE) | (acc["said"] != "")
        return F.when(over, acc).otherwise(F.struct(F.substring_index(mine, "|", 1).alias("at"), said.alias("said")))

    return F.aggregate(leads, F.struct(F.lit("").alias("at"), F.lit("").alias("said")), step, lambda a: F.nullif(a["said"], F.lit("")))


def file_layouts(chunks: DataFrame) -> DataFrame:
    """(file_id, banner, chars, minified, data, notes) of each file with a chunk.

    A chunk's first ``STRIDE`` lines are its own; what lies beyond them counts for a chunk that none
    follows, as windows overlap. The banner is sought in all comments in front of the first line of
    code, however many chunks they fill; chunks tell for themselves what they would add to them.
    """
    stats = chunk_rows(chunks).mapInArrow(_chunk_stats, _STATS)
    seen = stats.groupBy("file_id", "start_line").agg(*(F.max(c).alias(c) for c in ("lead", "lead_rest", "own", "rest", "followed"))).where("own is not null")
    part = lambda k: (F.col("own")[k] + F.when(F.col("followed"), 0).otherwise(F.col("rest")[k])).cast("bigint")
    mine = F.array_compact(F.array("lead", F.when(~F.col("followed"), F.col("lead_rest"))))
    kept = F.struct("start_line", mine.alias("leads"))  # a few bytes for each chunk
    by_file = seen.groupBy("file_id").agg(F.sort_array(F.collect_list(kept)).alias("found"), *(F.sum(part(k)).alias(n) for k, n in enumerate(("chars", "minified", "data", "notes"))))
    return by_file.select("file_id", _banner_of(F.flatten(F.transform("found", lambda x: x["leads"]))).alias("banner"), "chars", "minified", "data", "notes")


def shared_subtrees(files: DataFrame, least_files: int = 2) -> DataFrame:
    """Directories whose whole subtree, by relative paths and checksums, lies in several repositories: (dir, tree_hash, n_files).

    A directory's hash is a sum over its entries of hashes of name and hash, in two independent halves,
    so it is built by a partial aggregation level by level, however many entries a directory has. Each
    level is written, so the plan doesn't grow with the depth.
    Whole repositories don't count, nor do subtrees of under ``least_files`` files. Files without a
    checksum make the subtrees above them unlike any other.
    """
    latest = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("indexed_at", F.lower("checksum").alias("checksum"))).alias("row"))
    entry = F.coalesce(F.col("row.checksum"), F.concat(F.lit("path:"), F.col("path")))
    nodes = cut_lineage(
        latest.select(
            "path", F.size(F.split("path", "/")).alias("depth"), F.struct(F.xxhash64(entry, F.lit(1)).alias("a"), F.xxhash64(entry, F.lit(2)).alias("b")).alias("hash"), F.lit(1).cast("bigint").alias("n_files")
        )
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    found = level = None
    for depth in range(deepest, 2, -1):
        here = nodes.where(F.col("depth") == depth).select("path", "hash", "n_files")
        if level is not None:
            here = here.unionByName(level)
        name = F.substring_index("path", "/", -1)
        wrapped = lambda h, k: F.xxhash64(name, F.col(f"hash.{h}"), F.lit(k)) % F.lit(1 << 40)  # noqa: E731 - sums of 2^23 of these fit 64 bits
        grouped = here.groupBy(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("path")).agg(
            F.struct(F.sum(wrapped("a", 3)).alias("a"), F.sum(wrapped("b", 4)).alias("b")).alias("hash"), F.sum("n_files").alias("n_files")
        )
        level = cut_lineage(grouped)
        found = level if found is None else found.unionByName(level)
    if found is None:
        found = nodes.select("path", "hash", "n_files").where(F.lit(False))
    dirs = found.select(F.col("path").alias("dir"), F.xxhash64("hash.a", "hash.b", "n_files").alias("tree_hash"), "n_files").where(F.col("n_files") >= least_files)
    repo = F.substring_index("dir", "/", 1)
    several = dirs.groupBy("tree_hash").agg(F.min(repo).alias("lo"), F.max(repo).alias("hi")).where("lo <> hi").select("tree_hash")
    return dirs.join(several, "tree_hash", "left_semi").select("dir", "tree_hash", "n_files")


def file_origins(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file and why it isn't hand-written: (file_id, path, origin).

    ``origin`` is generated, vendored, minified, data or null for a hand-written file. Paths and the
    banner in front of the code decide first, then the layout of the text, then subtrees shared by
    repositories. The stored ``generated`` flag, size and lines aren't trusted and not read. Mentions
    after the first line of code, look-alike names and a single long line of a comment or of text don't
    count. Files without a chunk are judged by path and tree alone; rows with a null file_id are left
    out, a null path fits no rule; copies of rows count once.
    """
    rows = files.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(F.max("path").alias("path"))
    ancestors = rows.where(F.col("path").isNotNull()).select(
        "file_id", F.explode(F.expr("transform(sequence(2, greatest(size(split(path, '/')) - 1, 2)), k -> substring_index(path, '/', k))")).alias("dir")
    )
    shared = ancestors.join(shared_subtrees(files).select("dir").distinct(), "dir", "left_semi").groupBy("file_id").agg(F.lit(True).alias("shared"))
    known = rows.join(file_layouts(chunks), "file_id", "left").join(shared, "file_id", "left")
    path = F.col("path")
    origin = (
        F.when(path.rlike(_VENDORED_PATH) | (F.col("banner") == "vendored"), "vendored")
        .when(path.rlike(_GENERATED_PATH) | path.rlike(_GENERATED_NAME) | path.rlike(_GENERATED_CLASS) | (F.col("banner") == "generated"), "generated")
        .when(path.rlike(_MAYBE_BUNDLED_NAME) & (F.coalesce(F.col("minified"), F.lit(0)) > 0) | (F.col("notes") > 0) & (F.col("minified") > 0), "minified")
        .when((F.col("minified") >= MINIFIED_CHARS) & (F.col("minified") >= MINIFIED_SHARE * F.col("chars")), "minified")
        .when((F.col("data") >= DATA_CHARS) & (F.col("data") >= DATA_SHARE * F.col("chars")), "data")
        .when(path.rlike(_BUNDLED_NAME), "minified")
        .when(F.col("shared"), "vendored")
    )
    return known.select("file_id", "path", origin.alias("origin"))


def not_hand_written(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that nobody here wrote by hand: (file_id)."""
    return file_origins(files, chunks).where("origin is not null").select("file_id")
