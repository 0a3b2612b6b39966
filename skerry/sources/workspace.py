"""Reading a source tree into the tables of an index."""

from __future__ import annotations

import fnmatch
import functools
import itertools
import os
import posixpath
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.runtime import cut_lineage
from skerry.sources.languages import language_of

#: Directories that are never scanned, without regard to case.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", ".pnpm-store", ".yarn", ".turbo", ".parcel-cache", ".svelte-kit", ".nx", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".nox", ".eggs", "htmlcov", "venv", ".venv", "env", "dist", "build", ".build", "out", ".cache", "testresults", "bin", "obj", "target", ".gradle",
    ".next", ".nuxt", ".cmake", "cmakefiles", "bazel-bin", "bazel-out", "bazel-testlogs", "buck-out", ".pants.d", ".bloop", ".metals", ".idea", ".vscode", "coverage", "vendor",
    ".terraform", ".cargo", ".pub-cache", ".dart_tool", ".swiftpm", "deriveddata", ".stack-work", ".bundle", "_build",
)
#: Files that are never scanned.
EXCLUDED_FILES = (".ds_store", "thumbs.db")
MAX_BYTES = 4 << 20
WINDOW, STRIDE, MAX_LINE = 80, 70, 64 * 1024


def is_excluded(path: Column) -> Column:
    """By a directory on the way, the file's name or a resource-fork prefix, without regard to case."""
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    return F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in EXCLUDED_DIRS))) | name.isin(*EXCLUDED_FILES) | name.startswith("._")


class IgnoreRules:
    """Rules of ignore files: ``*`` and ``**``, a leading slash, a trailing one for directories, ``!`` to take back; the last match decides."""

    def __init__(self, lines: Sequence[str], base: str = "") -> None:
        self.rules: list[tuple[bool, re.Pattern]] = []
        for raw in lines:
            line = raw.rstrip("\n")
            if not line.strip() or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line.removeprefix("!").removeprefix("\\").rstrip()
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            rooted = "/" in line
            body = "".join(self._part(p) for p in re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*)", line.lstrip("/")))
            prefix = re.escape(base.strip("/") + "/") if base.strip("/") else ""
            head = "^" + prefix + ("" if rooted else "(?:.*/)?")
            self.rules.append((keep, re.compile(head + body + ("/.*$" if only_dir else "(?:/.*)?$"))))

    @staticmethod
    def _part(text: str) -> str:
        if text in ("**/", "/**/"):
            return "(?:.*/)?" if text == "**/" else "/(?:.*/)?"
        if text in ("/**", "**"):
            return "/.*" if text == "/**" else ".*"
        out = fnmatch.translate(text)
        return out[out.index(":") + 1 : out.rindex(")")].replace(".*", "[^/]*") if text else ""

    def ignored(self, path: str) -> bool:
        found = False
        for keep, rule in self.rules:
            if rule.match(path):
                found = not keep
        return found


class RuleTree:
    """Ignore files of a tree by their directories: rules of deeper directories come later, so they decide; below an ignored directory nothing is taken back."""

    def __init__(self, files: dict[str, Sequence[str]]) -> None:
        self.by_dir = {d.strip("/"): IgnoreRules(lines, d) for d, lines in files.items()}

    def _verdict(self, path: str) -> bool:
        found = False
        parts = path.split("/")
        for k in range(len(parts)):
            rules = self.by_dir.get("/".join(parts[:k]))
            for keep, rule in rules.rules if rules else ():
                if rule.match(path):
                    found = not keep
        return found

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        return any(self._verdict("/".join(parts[:k]) + "/") for k in range(1, len(parts))) or self._verdict(path)


def not_ignored(files: DataFrame, rules: IgnoreRules | RuleTree, path: str = "path") -> DataFrame:
    """Files that no rule leaves out; only paths are handed to the rules, which travel with the tasks."""
    kept = F.pandas_udf(lambda paths: paths.map(lambda p: p is None or not rules.ignored(p)).astype(bool), "boolean")
    return files.where(kept(F.col(path)))


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, of any kind that pyarrow knows, and the folder's path in it."""
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))
    return system, path.rstrip("/")


def _entries(system: fs.FileSystem, base: str, dir_: str) -> list[tuple[str, fs.FileInfo]]:
    """What lies in a folder, links left out, with paths below the root."""
    found = system.get_file_info(fs.FileSelector(f"{base}/{dir_}".rstrip("/")))
    local = isinstance(system, fs.LocalFileSystem)
    return [(f"{dir_}/{i.base_name}".lstrip("/"), i) for i in sorted(found, key=lambda i: i.path) if not (local and os.path.islink(i.path))]


_LISTED = "path string, size bigint, modified timestamp, repository boolean"


def _listing(root: str):
    """Lists folders to the bottom, without going into excluded ones; a ``.git`` comes out as such."""

    def rows(system: fs.FileSystem, base: str, dirs: list[str]) -> Iterator[tuple]:
        while dirs:
            for path, info in _entries(system, base, dirs.pop()):
                if info.base_name == ".git":
                    yield path, None, None, True
                elif info.type == fs.FileType.Directory:
                    if info.base_name.lower() not in EXCLUDED_DIRS:
                        dirs.append(path)
                elif info.type == fs.FileType.File:
                    yield path, info.size, info.mtime, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            found = rows(system, base, batch.column("dir").to_pylist())
            while part := list(itertools.islice(found, 10_000)):
                columns = list(zip(*part))
                kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "size", "modified", "repository"])

    return run


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, repository) of the files below a folder, hidden and empty ones included.

    The folders of the first two levels are listed on the driver and dealt out, the rest where they
    fall. Excluded folders aren't gone into, and links are left out. ``repository`` marks a ``.git``.
    """
    system, base = _opened(root)
    top = [("", True)]
    for _ in range(2):
        level = []
        for dir_, whole in top:
            inner = _entries(system, base, dir_) if whole else []
            dirs = [p for p, i in inner if i.type == fs.FileType.Directory and i.base_name.lower() not in EXCLUDED_DIRS and i.base_name != ".git"]
            level += [(p, True) for p in dirs] + [(dir_, False)]
        top = level
    shallow = [d for d, whole in top if not whole]
    deep = [d for d, whole in top if whole]
    near = spark.createDataFrame([(p, i.size, i.mtime, i.base_name == ".git") for d in shallow for p, i in _entries(system, base, d) if i.type == fs.FileType.File or i.base_name == ".git"], _LISTED)
    if not deep:
        return near
    dealt = spark.createDataFrame([(d,) for d in deep], "dir string").repartition(min(len(deep), 4 * spark.sparkContext.defaultParallelism))
    return near.unionByName(dealt.mapInArrow(_listing(root), _LISTED))


def _with_content(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            at = size = 0
            contents: list[bytes | None] = []
            for i, path in enumerate(batch.column("path").to_pylist()):
                with system.open_input_stream(f"{base}/{path}") as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size > 64 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "size", "modified")), pa.array(contents, pa.binary())], names=["path", "size", "modified", "content"])
                    at, size, contents = i + 1, 0, []

    return run


def tree_rules(spark: SparkSession, root: str, names: Sequence[str] = (".gitignore", ".ignore")) -> RuleTree:
    """The ignore files of a tree, one for each directory that has one; they are read on the driver, as rules are needed everywhere."""
    system, base = _opened(root)
    found: dict[str, list[str]] = {}
    rows = listed(spark, root).where(F.substring_index("path", "/", -1).isin(*names)).select("path")
    for r in rows.orderBy("path").toLocalIterator():
        with system.open_input_stream(f"{base}/{r.path}") as f:
            found.setdefault(posixpath.dirname(r.path), []).extend(decode(f.read())[0].splitlines())
    return RuleTree(found)


#: Ends of the names of generated files, without regard to case.
GENERATED_NAMES = (".designer.cs", ".generated.cs", ".g.cs", ".g.dart", ".gen.go", ".generated.ts", "_pb.go", "_pb2.py")
#: The head of a text, in which its marks are sought.
HEAD_LINES, HEAD_CHARS = 20, 16 * 1024


def has_generated_name(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return functools.reduce(Column.__or__, (name.endswith(e) for e in GENERATED_NAMES))


def has_generated_head(text: Column) -> Column:
    """Whether one of the first lines says so: auto-generated, @generated, or generated by and do not edit together."""
    lines = F.slice(F.split(F.lower(F.substring(text, 1, HEAD_CHARS)), "\n", HEAD_LINES + 1), 1, HEAD_LINES)
    says = lambda x, t: F.contains(x, F.lit(t))
    return F.exists(lines, lambda x: says(x, "<auto-generated") | says(x, "@generated") | says(x, "generated by") & says(x, "do not edit"))


def is_generated(path: Column, text: Column) -> Column:
    """By its name or its head; null texts have none."""
    return F.coalesce(has_generated_name(path), F.lit(False)) | F.coalesce(has_generated_head(text), F.lit(False))


def submodule_paths(text: str) -> list[str]:
    """The directories that a .gitmodules file names."""
    found = re.findall(r"(?m)^\s*path\s*=\s*(.+?)\s*$", text)
    return [p.strip('"').replace("\\", "/").strip("/") for p in found if not p.startswith("/") and ".." not in p.split("/")]


def nested_repositories(spark: SparkSession, root: str) -> list[str]:
    """Directories below the root that are repositories of their own: submodules, and those with a .git of theirs."""
    system, base = _opened(root)
    rows = listed(spark, root)
    named = []
    for r in rows.where("path = '.gitmodules' or endswith(path, '/.gitmodules')").select("path").toLocalIterator():
        with system.open_input_stream(f"{base}/{r.path}") as f:
            named += [posixpath.join(posixpath.dirname(r.path), p) for p in submodule_paths(decode(f.read())[0])]
    own = rows.where("repository and path <> '.git'").select(F.regexp_replace("path", "/\\.git$", "").alias("dir"))
    return sorted({*named, *(r.dir for r in own.toLocalIterator())})


def outside_of(path: Column, dirs: Sequence[str]) -> Column:
    """Whether a path lies in none of some directories."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return ~F.arrays_overlap(ancestors, F.array(*(F.lit(d) for d in dirs))) if dirs else F.lit(True)


def size_state(size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is skipped for its size, null if it isn't."""
    return F.when(size > max_bytes, "too_large")


def scan_workspace(spark: SparkSession, root: str, rules: IgnoreRules | RuleTree | None = None, max_bytes: int = MAX_BYTES, nested: Sequence[str] = ()) -> DataFrame:
    """(path, size, modified, content, skipped) of the files below a folder, hidden and empty ones included.

    Excluded and ignored paths, and those in ``nested`` repositories, are left out before any content is
    read; of oversized files none is.
    """
    rows = listed(spark, root).where("not repository").drop("repository").where(~is_excluded(F.col("path")) & outside_of(F.col("path"), nested))
    rows = rows if rules is None else not_ignored(rows, rules)
    small = rows.where(F.col("size") <= max_bytes).repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_with_content(root), "path string, size bigint, modified timestamp, content binary")
    big = rows.where(F.col("size") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(big).select("path", "size", "modified", "content", size_state(F.col("size"), max_bytes).alias("skipped"))


def content_state(text: Column) -> Column:
    """Why a text isn't indexed, null if it is: binary content, or a pointer to a large file kept elsewhere."""
    return F.when(F.contains(text, F.lit("\u0000")), "binary").when(text.startswith("version https://git-lfs"), "lfs_pointer")


def decode(content: bytes) -> tuple[str, str]:
    """The text of a file and how it was read: marks first, then UTF-16 by its zero bytes, UTF-8, and UTF-8 with replacements."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace"), "utf-8-bom"
    if content.startswith((b"\xff\xfe", b"\xfe\xff")):
        return content.decode("utf-16", "replace"), "utf-16"
    head = content[:512]
    if len(head) >= 4:
        even, odd = head[0::2].count(0), head[1::2].count(0)
        half = len(head) // 2
        if odd > 0.6 * half and even < 0.1 * half:
            return content.decode("utf-16-le", "replace"), "utf-16-le"
        if even > 0.6 * half and odd < 0.1 * half:
            return content.decode("utf-16-be", "replace"), "utf-16-be"
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("utf-8", "replace"), "utf-8-lenient"


def decoded(scanned: DataFrame) -> DataFrame:
    """(path, size, modified, text, encoding, skipped); binary files and large-file pointers are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, how = [], []
            for c in b.column("content").to_pylist():
                t, e = decode(c) if c is not None else (None, None)
                texts.append(t)
                how.append(e)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), b.column("modified"), pa.array(texts, pa.string()), pa.array(how, pa.string()), b.column("skipped")], names=["path", "size", "modified", "text", "encoding", "skipped"])

    rows = scanned.mapInArrow(run, "path string, size bigint, modified timestamp, text string, encoding string, skipped string")
    skipped = F.coalesce("skipped", content_state(F.col("text")))
    return rows.select("path", "size", "modified", F.when(skipped.isNull(), normalised(F.col("text"))).alias("text"), "encoding", skipped.alias("skipped"))


def normalised(text: Column) -> Column:
    """One kind of line end, and no invisible marks at the start of lines."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?m)^[\\ufeff\\u200b\\u200c\\u200d\\u2060]+", "")


def chunk_texts(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, chunk_index, start_line, end_line, content): windows of 80 lines every 70.

    A final line feed adds no line; an empty text has no chunk, nor has one with a line of over 64 KiB.
    A window is left out when the one before it reaches the end.
    """
    lines = F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1)
    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("file_id"), lines.alias("lines"))
    fit = rows.where(~F.exists("lines", lambda x: F.length(x) > MAX_LINE))
    last = F.greatest(F.size("lines") - (WINDOW - STRIDE) - 1, F.lit(0))
    starts = fit.select("file_id", "lines", F.posexplode(F.sequence(F.lit(0), last, F.lit(STRIDE))).alias("chunk_index", "from"))
    part = F.slice("lines", F.col("from") + 1, WINDOW)
    return starts.select("file_id", "chunk_index", (F.col("from") + 1).alias("start_line"), (F.col("from") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("content"))


def changed_since(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned paths that the index lacks or holds with another checksum."""
    return scan.join(files.select("path", F.col("checksum").alias("known")), "path", "left").where(~F.col("checksum").eqNullSafe(F.col("known"))).drop("known")


def vanished(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Indexed files whose path is no longer there."""
    return files.join(scan.select("path").distinct(), "path", "left_anti")


def ingest(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> dict[str, DataFrame]:
    """files, chunks, symbols and refs of a source tree; file_id is a hash of the path, so a run needs no counter.

    Texts and symbols are written once in between, so each file is read and each text extracted once
    for all four tables.
    """
    from skerry.sources.extractors import extract_references, extract_symbols

    texts = decoded(scan_workspace(spark, root, rules)).where("text is not null")
    rows = cut_lineage(texts.select(
        F.xxhash64("path").alias("file_id"), "path", language_of(F.col("path"), F.col("text")).alias("lang"), "size",
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split(F.regexp_replace("text", "\n\\z", ""), "\n", -1))).alias("lines"), F.sha2("text", 256).alias("checksum"), "modified", "text",
    ))
    chunks = chunk_texts(rows).withColumn("chunk_id", F.xxhash64("file_id", "chunk_index"))
    symbols = cut_lineage(extract_symbols(rows))
    return {
        "files": rows.withColumn("generated", is_generated(F.col("path"), F.col("text"))).drop("text").withColumn("indexed_at", F.current_timestamp()),
        "chunks": chunks.select("chunk_id", "file_id", "chunk_index", "start_line", "end_line", "content"),
        "symbols": symbols,
        "refs": extract_references(rows, symbols),
    }


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The published version of an index; one that lacks a table or a column, or has one of another type, is refused."""
    from skerry import schema
    from skerry.sources.sinks import published

    version = published(spark, path)
    out = {}
    for name, ddl in (("files", schema.FILES), ("chunks", schema.CHUNKS), ("symbols", schema.SYMBOLS), ("refs", schema.REFS)):
        if name not in version["tables"]:
            raise ValueError(f"the index has no {name}")
        df = spark.read.parquet(f"{version['data']}/{name}")
        kinds = dict(df.dtypes)
        for part in ddl.split(", "):
            column, kind = part.split()
            if kinds.get(column) != kind.lower():
                raise ValueError(f"{name}.{column} is {kinds.get(column)}, not {kind.lower()}")
        out[name] = df.select(*schema.names(ddl))
    return out


def import_index(spark: SparkSession, source: str, path: str, prefix: str | None = None) -> None:
    """An exported index, checked and published as an index here; with ``prefix`` only the files below it."""
    from skerry.sources.sinks import write_index

    tables = read_index(spark, source)
    if prefix is not None:
        files = tables["files"].where(F.col("path").startswith(prefix.rstrip("/") + "/"))
        tables = {"files": files} | {n: df.join(files.select("file_id").distinct(), "file_id", "left_semi") for n, df in tables.items() if n != "files"}
    write_index(tables, path)


def union_members(indexes: dict[str, DataFrame]) -> DataFrame:
    """One table of several member indexes, with the member's name in ``workspace``."""
    rows = None
    for name, df in indexes.items():
        one = df.withColumn("workspace", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows
