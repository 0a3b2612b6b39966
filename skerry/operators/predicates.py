"""Column predicates that all queries share: paths, languages, kinds and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skerry.schema import CALLABLE_KINDS, EVENT_KINDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only, as names and paths are compared without regard to case."""
    return F.translate(c, _UPPER, _UPPER.lower())


def like_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_to_like(pattern: str) -> str:
    """``*`` is any text and ``?`` any character; a leading ./ or / and a trailing / are left out."""
    if len(pattern) > 1024 or pattern.count("*") + pattern.count("?") > 128:
        raise ValueError("pattern too long")
    pattern = pattern.replace("\\", "/").removeprefix("./").lstrip("/").rstrip("/")
    return like_escaped(pattern).replace("*", "%").replace("?", "_")


def path_matches(path: Column, pattern: str) -> Column:
    """A pattern without wildcards also matches the subtree below it."""
    like = glob_to_like(pattern).lower()
    folded = ascii_lower(path)
    found = folded.like(like)
    return found if "*" in pattern or "?" in pattern else found | folded.like(like + "/%")


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def paths_filter(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), also: Sequence[str] = ()) -> Column:
    """(any of include) and (any of also) and none of exclude; empty groups don't restrict."""
    out = F.lit(True)
    if include:
        out = out & any_of([path_matches(path, p) for p in include])
    if also:
        out = out & any_of([path_matches(path, p) for p in also])
    if exclude:
        out = out & ~any_of([path_matches(path, p) for p in exclude])
    return out


#: Forms of lower-cased test paths.
TEST_FORMS = (
    "tests/%", "%/tests/%", "test/%", "%/test/%", "tests.%", "%/tests.%", "test.%", "%/test.%", "tests\\_%", "%/tests\\_%", "test\\_%", "%/test\\_%",
    "%\\_tests.%", "%\\_test.%", "conftest.py", "%/conftest.py", "%.spec.%", "%.test.%",
)
#: Forms of lower-cased documentation paths.
DOCS_FORMS = ("docs/%", "%/docs/%", "readme%", "changelog%", "%.md")


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return any_of([low.like(p) for p in TEST_FORMS])


def path_bucket(path: Column) -> Column:
    """0 for production code, 1 for tests, 2 for documentation."""
    low = F.lower(path)
    return F.when(is_test_path(path), 1).when(any_of([low.like(p) for p in DOCS_FORMS]), 2).otherwise(0)


LIKELY_TEST = r"(^|/)(tests?|__tests__|specs?|fixtures|testdata)(/|$)|[._-](tests?|specs?)\.[a-z0-9]+$|(^|/)(tests?[._-]|conftest\.)|(tests?|specs?)\.(cs|java|kt|scala|swift)$"


def is_likely_test_path(path: Column) -> Column:
    """A wider test: also fixtures, test data and names such as FooTest.java."""
    return F.lower(path).rlike(LIKELY_TEST)


#: Other names of languages.
LANGUAGE_ALIASES = {"js": "javascript", "py": "python", "c#": "csharp", "cs": "csharp", "golang": "go", "ts": "typescript", "md": "markdown", "rb": "ruby", "rs": "rust", "kt": "kotlin", "sh": "shell", "yml": "yaml"}


def language(name: str) -> str:
    low = name.strip().lower()
    return LANGUAGE_ALIASES.get(low, low)


#: Languages whose references form a call graph.
GRAPH_LANGUAGES = ("python", "javascript", "typescript", "java", "csharp", "go", "rust", "kotlin", "swift", "c", "cpp", "php", "ruby", "scala", "sql")


def visibility_rank(visibility: Column) -> Column:
    v = F.lower(visibility)
    return (
        F.when(v.isin("public", "open", "pub", "export"), 0)
        .when(v.isin("protected", "protected internal"), 1)
        .when(v.isin("internal", "private protected"), 2)
        .when(v.isin("private", "fileprivate"), 3)
        .otherwise(4)
    )


def kind_predicate(kind: Column, wanted: str | None = None, member_reads: bool = False) -> Column:
    """The kinds a call-graph query looks at: by default callable ones, ``subscribe`` for all event kinds, else the one named."""
    if wanted is None:
        found = kind.isin(*CALLABLE_KINDS)
        return found | (kind == "member_read") if member_reads else found
    return kind.isin(*EVENT_KINDS) if wanted == "subscribe" else kind == wanted


def logical_kind(kind: Column) -> Column:
    return F.when(kind.isin(*EVENT_KINDS), "subscribe").otherwise(kind)


def weight(kind: Column, weights: dict[str, int]) -> Column:
    """Tenths, as whole numbers, so that sums don't depend on their order."""
    out = F.lit(0)
    for k, w in weights.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def name_matches(name: Column, query: str, mode: str = "substring") -> Column:
    """How a name may match: substring, exact, folded, leaf (of a qualified name) or prefix."""
    low = query.translate(str.maketrans(_UPPER, _UPPER.lower()))
    if mode == "exact":
        return name == query
    if mode == "folded":
        return ascii_lower(name) == low
    if mode == "prefix":
        return ascii_lower(name).startswith(low)
    if mode == "leaf":
        return ascii_lower(F.substring_index(name, ".", -1)) == low
    return F.contains(ascii_lower(name), F.lit(low))


def normalised_names(name: Column, lang: Column) -> Column:
    """Names as their languages store them: Rust paths with dots, C#'s verbatim signs, module exports and SQL's quotes left out."""
    n = F.trim(name)
    sql = F.array_join(F.transform(F.split(n, r"\."), lambda p: F.regexp_replace(p, r'^[\["`]+|[\]"`]+$', "")), ".")
    return (
        F.when(lang == "rust", F.replace(n, F.lit("::"), F.lit(".")))
        .when(lang == "csharp", F.regexp_replace(n, r"(^|\.)@", "$1"))
        .when(lang == "javascript", F.regexp_replace(n, r"^(module\.)?exports\.", ""))
        .when(lang == "sql", sql)
        .otherwise(n)
    )


def normalised_query(spark: SparkSession, query: str, lang: str | None = None) -> str:
    """A name that is asked for, as its language stores it."""
    return spark.createDataFrame([(query, lang)], "q string, lang string").select(normalised_names(F.col("q"), F.col("lang"))).first()[0]


#: Framework names that say little of a dependency.
NOISE_NAMES = (
    "Append", "AppendLine", "Array", "BoundedRegex", "CancellationToken", "Code", "Console", "Count", "DateTime", "Dictionary", "Directory", "Dispose", "Encoding", "Enumerable",
    "Error", "Escape", "File", "Flush", "IEnumerable", "IsMatch", "Kind", "Language", "Length", "List", "Match", "Matches", "Math", "Name", "None", "Option", "Options", "Path",
    "Read", "ReadLine", "Record", "Regex", "Replace", "Result", "Results", "String", "StringBuilder", "Task", "Token", "ToString", "Unescape", "Value", "Values", "Version",
    "Write", "WriteLine",
)


def is_noise(name: Column) -> Column:
    """Whether a name is one of these, whatever its case."""
    return F.lower(name).isin(*(n.lower() for n in NOISE_NAMES))


def in_partition(path: Column, paths: Sequence[str]) -> Column:
    """Whether a path is, to the letter, one of those of an audit's part."""
    return path.isin(*paths)


#: Most values of one kind of evidence that a filter may name.
MOST_EVIDENCE = 64


def evidence(state: Column, kind: Column, states: Sequence[str] = (), kinds: Sequence[str] = ()) -> Column:
    """References whose resolution state and kind are among those named; naming none doesn't restrict."""
    if max(len(states), len(kinds)) > MOST_EVIDENCE:
        raise ValueError(f"more than {MOST_EVIDENCE} values")
    out = F.lit(True)
    if states:
        out = out & state.isin(*states)
    return out & kind.isin(*kinds) if kinds else out


def at_position(line: Column, start: Column, length: Column, at_line: int, at_column: int) -> Column:
    """Whether a reference of ``length`` characters from a column on covers a place in a file, both counted from 1."""
    return (line == at_line) & F.lit(at_column).between(start, start + length - 1)
