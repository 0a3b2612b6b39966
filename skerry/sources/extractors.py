"""Symbols and references of source texts, by the rules of each language.

A language is a row of patterns over lines: what declares a symbol, and what a declared block looks
like. Rules are data, so a language is added by a row. Strings and comments are blanked in the whole
text first, so those over several lines hold no names; parameters may go on over lines. Extraction sees
one file at a time and passes over it a fixed number of times.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import fold_name
from skerry.runtime import cut_lineage


@dataclass(frozen=True)
class Rules:
    """``declares`` are (kind, pattern with a group ``name``); ``blocks`` is brace, indent, end or none."""

    declares: tuple[tuple[str, str], ...]
    blocks: str = "brace"
    comment: str = r"//"
    keywords: frozenset[str] = field(default_factory=frozenset)
    imports: str | None = None


_VIS = r"(?P<vis>public|protected|private|internal)?\s*"
_MODS = r"(?:(?:static|abstract|sealed|final|async|override|virtual|partial|readonly|new|unsafe|extern|synchronized|default|native)\s+)*"
#: A type with arguments in three levels of angle brackets at most, arrays and nullables included.
_TYPE = r"[\w.]+(?:<(?:[^<>(){};]|<(?:[^<>(){};]|<[^<>(){};]*>)*>)*>)?(?:\[[\],]*\])*\??"
#: Words that no call begins with.
_C_WORDS = frozenset({
    "if", "for", "while", "switch", "catch", "return", "sizeof", "new", "throw", "else", "do", "try", "using", "lock", "foreach", "typeof", "nameof",
    "await", "function", "in", "not", "and", "or", "elif", "assert", "with", "yield", "lambda", "def", "class", "match", "case", "super", "this",
    "range", "defer", "go", "func", "select",
})

RULES: dict[str, Rules] = {
    "python": Rules((("class", r"^\s*class\s+(?P<name>\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)"), ("variable", r"^(?P<name>[A-Z][A-Z0-9_]+)\s*=")), "indent", r"#", _C_WORDS | {"print"}, r"^\s*(?:from\s+(?P<a>[\w.]+)\s+import|import\s+(?P<b>[\w.]+))"),
    "javascript": Rules((("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", r"^\s+(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?(?P<name>(?!(?:if|for|while|switch|catch|return|function)\b)\w+)\s*\([^)]*\)\s*\{")), "brace", r"//", _C_WORDS, r"from\s+['\"](?P<a>[^'\"]+)['\"]|require\(\s*['\"](?P<b>[^'\"]+)"),
    "java": Rules((("class", rf"^\s*{_VIS}{_MODS}class\s+(?P<name>\w+)"), ("interface", rf"^\s*{_VIS}{_MODS}@?interface\s+(?P<name>\w+)"), ("enum", rf"^\s*{_VIS}{_MODS}enum\s+(?P<name>\w+)"), ("record", rf"^\s*{_VIS}{_MODS}record\s+(?P<name>\w+)\s*\("), ("method", rf"^\s+{_VIS}{_MODS}(?:<[^>]+>\s+)?(?P<type>(?!(?:return|new|else|throw|package|import)\b){_TYPE})\s+(?P<name>\w+)\s*\([^;]*$")), "brace", r"//", _C_WORDS, r"^import\s+(?:static\s+)?(?P<a>[\w.]+)"),
    "csharp": Rules((("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("class", rf"^\s*{_VIS}{_MODS}(?:class|record)\s+(?P<name>\w+)"), ("struct", rf"^\s*{_VIS}{_MODS}struct\s+(?P<name>\w+)"), ("interface", rf"^\s*{_VIS}{_MODS}interface\s+(?P<name>\w+)"), ("enum", rf"^\s*{_VIS}{_MODS}enum\s+(?P<name>\w+)"), ("property", rf"^\s+{_VIS}{_MODS}(?P<type>{_TYPE})\s+(?P<name>\w+)\s*\{{\s*get"), ("method", rf"^\s+{_VIS}{_MODS}(?P<type>(?!(?:return|new|else|throw|using|await|var)\b){_TYPE})\s+(?P<name>\w+)(?:<[^>]*>)?\s*\([^;]*$")), "brace", r"//", _C_WORDS, r"^\s*using\s+(?:static\s+)?(?P<a>[\w.]+)\s*;"),
    "go": Rules((("struct", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)")), "brace", r"//", _C_WORDS, r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<a>[\w./-]+)\"$"),
    "rust": Rules((("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)")), "brace", r"//", _C_WORDS | {"fn", "impl", "loop"}, r"^\s*use\s+(?P<a>[\w:]+)"),
    "kotlin": Rules((("class", rf"^\s*{_VIS}(?:data\s+|open\s+|sealed\s+|abstract\s+)*(?:class|object|interface)\s+(?P<name>\w+)"), ("function", rf"^\s*{_VIS}(?:override\s+|suspend\s+|inline\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)")), "brace", r"//", _C_WORDS | {"fun", "when"}, r"^import\s+(?P<a>[\w.]+)"),
    "swift": Rules((("class", rf"^\s*{_VIS}(?:final\s+|open\s+)*(?:class|struct|enum|protocol|actor)\s+(?P<name>\w+)"), ("function", rf"^\s*{_VIS}(?:static\s+|mutating\s+|override\s+)*func\s+(?P<name>\w+)")), "brace", r"//", _C_WORDS | {"guard"}, r"^import\s+(?P<a>\w+)"),
    "php": Rules((("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(?P<name>\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+&?(?P<name>\w+)")), "brace", r"//|#", _C_WORDS | {"echo", "isset", "array", "empty"}, r"^\s*use\s+(?P<a>[\w\\]+)"),
    "c": Rules((("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("function", r"^(?:static\s+|inline\s+|extern\s+)*[\w*]+(?:\s+[\w*]+)*\s+\**(?P<name>\w+)\s*\([^;]*$")), "brace", r"//", _C_WORDS, r"^\s*#\s*include\s*[<\"](?P<a>[^>\"]+)"),
    "ruby": Rules((("class", r"^\s*(?:class|module)\s+(?P<name>[\w:]+)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")), "end", r"#", _C_WORDS | {"puts", "require", "end", "unless"}, r"^\s*require(?:_relative)?\s+['\"](?P<a>[^'\"]+)"),
    "shell": Rules((("function", r"^\s*(?:function\s+)?(?P<name>\w+)\s*\(\)\s*\{?"),), "brace", r"#", _C_WORDS),
    "sql": Rules((("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\[\]\"`]+)"), ("view", r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+(?P<name>[\w.\[\]\"`]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\[\]\"`]+)")), "none", r"--", frozenset()),
    "markdown": Rules((("heading", r"^(?P<hash>#{1,6})\s+(?P<name>.+?)\s*#*$"),), "none", r"(?!)", frozenset()),
    "html": Rules((("heading", r"(?i)<h[1-6][^>]*>\s*(?P<name>[^<]+?)\s*</h[1-6]>"), ("anchor", r"(?i)\bid\s*=\s*[\"'](?P<name>[^\"']+)")), "none", r"(?!)", frozenset()),
    "css": Rules((("class", r"^\s*\.(?P<name>[\w-]+)[^{;]*\{"), ("id", r"^\s*#(?P<name>[\w-]+)[^{;]*\{")), "brace", r"(?!)", frozenset()),
    "terraform": Rules((("resource", r'^\s*resource\s+"[^"]+"\s+"(?P<name>[^"]+)"'), ("variable", r'^\s*variable\s+"(?P<name>[^"]+)"'), ("module", r'^\s*module\s+"(?P<name>[^"]+)"')), "brace", r"#|//", frozenset()),
    "protobuf": Rules((("message", r"^\s*message\s+(?P<name>\w+)"), ("service", r"^\s*service\s+(?P<name>\w+)"), ("method", r"^\s*rpc\s+(?P<name>\w+)"), ("enum", r"^\s*enum\s+(?P<name>\w+)")), "brace", r"//", frozenset()),
    "graphql": Rules((("type", r"^\s*(?:type|input|interface|union|enum|scalar)\s+(?P<name>\w+)"), ("operation", r"^\s*(?:query|mutation|subscription|fragment)\s+(?P<name>\w+)")), "brace", r"#", frozenset()),
    "dockerfile": Rules((("stage", r"(?i)^FROM\s+\S+\s+AS\s+(?P<name>[\w-]+)"),), "none", r"#", frozenset(), r"(?i)^FROM\s+(?P<a>\S+)"),
    "lua": Rules((("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)"),), "end", r"--", _C_WORDS),
    "elixir": Rules((("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)")), "end", r"#", _C_WORDS),
    "scala": Rules((("class", r"^\s*(?:case\s+|abstract\s+|sealed\s+)*(?:class|object|trait)\s+(?P<name>\w+)"), ("function", r"^\s*(?:override\s+|private\s+|protected\s+)*def\s+(?P<name>\w+)")), "brace", r"//", _C_WORDS, r"^import\s+(?P<a>[\w.]+)"),
}
RULES["typescript"] = Rules((*RULES["javascript"].declares, ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)")), "brace", r"//", _C_WORDS, RULES["javascript"].imports)
RULES["cpp"] = Rules((("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)"), ("namespace", r"^\s*namespace\s+(?P<name>\w+)"), *RULES["c"].declares), "brace", r"//", _C_WORDS, RULES["c"].imports)

#: Words of the list above that are keywords in other languages only.
_FOREIGN = {lang: frozenset({"go", "defer", "func", "select", "range", "def", "elif", "lambda", "not", "and", "or", "match"}) for lang in ("java", "csharp", "javascript", "typescript", "c", "cpp")}
_FOREIGN["python"] = frozenset({"go", "defer", "func", "select", "range", "match", "this", "new", "do", "switch", "catch", "throw", "using", "lock", "foreach", "sizeof", "typeof", "nameof", "function"})
_FOREIGN["go"] = frozenset({"lock", "using", "foreach", "not", "and", "or", "in", "with", "yield", "match", "def", "this", "do", "try", "catch", "assert"})
RULES.update({lang: replace(RULES[lang], keywords=RULES[lang].keywords - words) for lang, words in _FOREIGN.items()})

_CONTAINERS = frozenset("class struct interface enum record namespace module heading type message service".split())
_CALL = regex.compile(r"(?P<new>\bnew\s+)?(?:(?P<qual>[A-Za-z_]\w*)\s*(?:\.|::|->)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:<[\w\s,.<>]*>)?\s*\(")
_LINK = regex.compile(r"\[[^\]]*\]\((?P<to>[^)\s]+)")
_HREF = regex.compile(r"(?i)\b(?:href|src)\s*=\s*[\"'](?P<to>[^\"']+)")
_SQL_FROM = regex.compile(r"(?i)\b(?:from|join|into|update|table)\s+(?P<to>[\w.\[\]\"`]+)")
_COMPILED: dict[str, list[tuple[str, regex.Pattern]]] = {}

#: Plug-ins: more extractors by language, (file_id, lang, text) to rows as the built-in ones give them.
SYMBOL_PLUGINS: dict[str, Callable[[int, str, str], list[dict]]] = {}
REFERENCE_PLUGINS: dict[str, Callable[[int, str, str], list[dict]]] = {}


def _patterns(lang: str) -> list[tuple[str, regex.Pattern]]:
    if lang not in _COMPILED:
        _COMPILED[lang] = [(k, regex.compile(p)) for k, p in RULES[lang].declares]
    return _COMPILED[lang]


_BRACE_TEXT = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'"
#: What has no names in it, strings and comments over lines included, by family of languages; quotes stay, the rest is blanked.
_BLANKED = {
    "c": regex.compile(r"//[^\n]*|/\*(?s:.)*?(?:\*/|\Z)|" + _BRACE_TEXT),
    "raw": regex.compile(r"//[^\n]*|/\*(?s:.)*?(?:\*/|\Z)|`(?:[^`\\]|\\(?s:.))*+`|" + _BRACE_TEXT),
    "triple": regex.compile(r'//[^\n]*|/\*(?s:.)*?(?:\*/|\Z)|"""(?s:.)*?(?:"""+|\Z)|@\$?"(?:[^"]|"")*+"|' + _BRACE_TEXT),
    "python": regex.compile(r'#[^\n]*|"""(?:[^"\\]|\\(?s:.)|"(?!""))*+(?:"""|\Z)|' + r"'''(?:[^'\\]|\\(?s:.)|'(?!''))*+(?:'''|\Z)|" + _BRACE_TEXT),
    "hash": regex.compile(r"#[^\n]*|" + _BRACE_TEXT),
    "dash": regex.compile(r"--\[\[(?s:.)*?(?:\]\]|\Z)|--[^\n]*|/\*(?s:.)*?(?:\*/|\Z)|" + r"'(?:[^'\n]|'')*+'"),
}
_FAMILY = {
    "java": "triple", "csharp": "triple", "kotlin": "triple", "scala": "triple", "swift": "triple", "javascript": "raw", "typescript": "raw", "go": "raw", "python": "python", "rust": "c", "c": "c", "cpp": "c",
    "php": "c", "protobuf": "c", "ruby": "hash", "shell": "hash", "elixir": "hash", "terraform": "hash", "graphql": "hash", "dockerfile": "hash", "lua": "dash", "sql": "dash",
}
_INSIDE = regex.compile(r"[^\n\"'`]")


def masked(text: str, lang: str) -> str:
    """The text with strings and comments blanked, over lines too; places and line ends are kept."""
    family = _FAMILY.get(lang)
    return text if family is None else _BLANKED[family].sub(lambda m: _INSIDE.sub(" ", m.group()), text)


class _Blocks:
    """Where the blocks of a text in braces end, from one pass over it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in regex.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in regex.finditer(r"[{}]", text):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line_of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def end(self, at: int) -> int:
        """Index of the last line of the block that is declared on line ``at``: up to the brace that closes it, or to a semicolon that comes first."""
        depth = 0
        for m in regex.finditer(r"[(){};\[\]]", self.text, pos=self.starts[at]):
            c = m.group()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{" and depth <= 0:
                return self.line_of(self.close.get(m.start(), len(self.text)))
            elif c == ";" and depth <= 0:
                return self.line_of(m.start())
            elif c == "}" and depth <= 0:
                return at
        return at


def _indent_end(lines: list[str], at: int, style: str) -> int:
    indent = len(lines[at]) - len(lines[at].lstrip())
    last, depth = at, 0
    for k in range(at, len(lines)):
        line = lines[k]
        here = len(line) - len(line.lstrip())
        if k > at and line.strip() and depth <= 0 and here <= indent:
            return k if style == "end" and line.strip().startswith("end") else last
        depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
        if line.strip():
            last = k
    return last


def symbols_of(file_id: int, lang: str, text: str) -> list[dict]:
    """The symbols of one file, in source order, each with its block and its innermost container."""
    if lang in SYMBOL_PLUGINS:
        return SYMBOL_PLUGINS[lang](file_id, lang, text)
    if lang not in RULES:
        return []
    rules = RULES[lang]
    raw = text.split("\n")
    bare = text if rules.blocks == "none" and lang != "sql" else masked(text, lang)
    lines = bare.split("\n")
    blocks = _Blocks(bare) if rules.blocks == "brace" else None
    found: list[dict] = []
    for at, line in enumerate(lines):
        if not line or line.isspace():
            continue
        for kind, pattern in _patterns(lang):
            # names in quotes are only there in the line as it is written
            m = pattern.search(raw[at] if '"' in pattern.pattern else line)
            if m is None:
                continue
            groups = m.groupdict()
            end = blocks.end(at) if blocks else _indent_end(lines, at, rules.blocks) if rules.blocks in ("indent", "end") else at
            if kind == "heading" and lang == "markdown":
                level = len(groups["hash"])
                end = next((k - 1 for k in range(at + 1, len(lines)) if (h := regex.match(r"^(#{1,6})\s", lines[k])) and len(h.group(1)) <= level), len(lines) - 1)
            found.append({
                "file_id": file_id, "kind": kind, "sub_kind": "async" if regex.search(r"\basync\b", line[: m.end()]) else None, "name": groups["name"].strip("[]\"`"), "line": at + 1, "start_line": at + 1, "start_column": m.start("name") + 1,
                "end_line": end + 1, "body_start_line": min(at + 2, end + 1), "body_end_line": end + 1, "signature": _signature(raw, lines, at), "visibility": groups.get("vis"), "return_type": groups.get("type"),
            })
            break
    stack: list[dict] = []
    for s in found:
        while stack and stack[-1]["end_line"] < s["start_line"]:
            stack.pop()
        holder = next((h for h in reversed(stack) if h["kind"] in _CONTAINERS and h["end_line"] >= s["end_line"]), None)
        s["container_kind"] = holder and holder["kind"]
        s["container_name"] = holder and holder["name"]
        s["container_qualified_name"] = holder and ".".join(h["name"] for h in stack if h["kind"] in _CONTAINERS and h["end_line"] >= s["end_line"])
        if s["kind"] == "function" and holder and holder["kind"] != "heading" and lang == "python":
            s["kind"] = "method"
        stack.append(s)
    return found


def _signature(raw: list[str], lines: list[str], at: int) -> str:
    """A declaration up to the end of its parameters, which may go on over lines."""
    parts, depth = [], 0
    for k in range(at, min(at + 20, len(lines))):
        parts.append(raw[k].strip())
        depth += sum(map(lines[k].count, "([")) - sum(map(lines[k].count, ")]"))
        if depth <= 0:
            break
    return " ".join(parts)[:400]


#: Names that a declaration derives from, after its own.
_BASES = regex.compile(r"(?:\bextends\b|\bimplements\b|:(?!:)|\bclass\s+\w+\s*\()\s*(?P<list>[\w.<>\[\], ]+)")
_TYPE_NAME = regex.compile(r"(?<![\w.])(?:\w+\.)*(?P<name>[A-Z]\w*)")
#: Attributes and annotations, and handlers that are put on an event or taken off.
_ANNOTATION = regex.compile(r"^\s*(?:@(?P<at>[A-Za-z_][\w.]*)|\[(?:\w+:\s*)?(?P<attr>[A-Z][\w.]*)[\](])")
_EVENT = regex.compile(r"(?P<event>[A-Za-z_]\w*)\s*(?P<sign>[+-])=\s*(?:this\.)?(?P<name>[A-Z]\w*)\s*;")
_LITERAL = regex.compile(r"(?<![\w.])&?(?:\w+\.)?(?P<name>[A-Z]\w*)\{")


def references_of(file_id: int, lang: str, text: str, symbols: list[dict] | None = None) -> list[dict]:
    """The references of one file: calls, instantiations, base types, annotations, event handlers, imports, links, and tables of queries."""
    if lang in REFERENCE_PLUGINS:
        return REFERENCE_PLUGINS[lang](file_id, lang, text)
    if lang not in RULES:
        return []
    rules = RULES[lang]
    symbols = symbols_of(file_id, lang, text) if symbols is None else symbols
    declared = {(s["line"], s["name"]) for s in symbols}
    out: list[dict] = []
    raw_lines = text.split("\n")
    # symbols come by their first lines, inner ones after outer ones, so the last to paint a line is the innermost
    inner: list[dict | None] = [None] * (len(raw_lines) + 2)
    for s in sorted(symbols, key=lambda s: (s["start_line"], -s["end_line"])):
        for k in range(s["start_line"], min(s["end_line"], len(raw_lines)) + 1):
            inner[k] = s

    def add(name: str, kind: str, line: int, column: int, qualifier: str | None, context: str) -> None:
        holder = inner[line]
        out.append({
            "file_id": file_id, "symbol_name": name, "reference_kind": kind, "line": line, "column_number": column, "span_length": len(name), "context": context.strip()[:400],
            "container_kind": holder and holder["kind"], "container_name": holder and holder["name"], "target_qualifier": qualifier,
        })

    bare = masked(text, lang).split("\n")
    typed = {s["line"] for s in symbols if s["kind"] in ("class", "struct", "interface", "record", "enum")}
    for at, raw in enumerate(raw_lines, 1):
        line = bare[at - 1]
        if rules.imports and line.strip() and (m := regex.search(rules.imports, raw)):
            name = next(g for g in m.groups() if g)
            add(name, "import", at, raw.index(name) + 1, None, raw)
            continue
        if lang in ("markdown", "html"):
            for m in (_LINK if lang == "markdown" else _HREF).finditer(raw):
                add(m.group("to"), "link", at, m.start("to") + 1, None, raw)
            continue
        if lang == "sql":
            for m in _SQL_FROM.finditer(line):
                if (at, m.group("to").strip("[]\"`")) not in declared:
                    add(m.group("to"), "call", at, m.start("to") + 1, None, raw)
            continue
        noted = _ANNOTATION.match(line) if lang in ("python", "java", "kotlin", "csharp", "typescript", "swift", "scala") else None
        if noted:
            group = "at" if noted.group("at") else "attr"
            add(noted.group(group).rsplit(".", 1)[-1], "annotation", at, noted.end(group) - len(noted.group(group).rsplit(".", 1)[-1]) + 1, None, raw)
        if at in typed and (m := _BASES.search(line)):
            for t in _TYPE_NAME.finditer(line, m.start("list"), m.end("list")):
                if (at, t.group("name")) not in declared:
                    add(t.group("name"), "type_reference", at, t.start("name") + 1, None, raw)
        for m in _EVENT.finditer(line) if lang == "csharp" else ():
            add(m.group("name"), "subscribe" if m.group("sign") == "+" else "unsubscribe", at, m.start("name") + 1, m.group("event"), raw)
        for m in _LITERAL.finditer(line) if lang in ("go", "rust") and at not in typed else ():
            add(m.group("name"), "instantiate", at, m.start("name") + 1, None, raw)
        for m in _CALL.finditer(line, overlapped=False):
            name = m.group("name")
            if name in rules.keywords or (at, name) in declared or noted and m.start("name") < noted.end():
                continue
            kind = "instantiate" if m.group("new") or (lang == "python" and name[0].isupper()) else "call"
            add(name, kind, at, m.start("name") + 1, m.group("qual"), raw)
    return out


_SYMBOL_FIELDS = "file_id bigint, kind string, sub_kind string, name string, line int, start_line int, start_column int, end_line int, body_start_line int, body_end_line int, signature string, container_kind string, container_name string, container_qualified_name string, visibility string, return_type string"
_REFERENCE_FIELDS = "file_id bigint, symbol_name string, reference_kind string, line int, column_number int, span_length int, context string, container_kind string, container_name string, target_qualifier string"


def _rows(batches: Iterator[pa.RecordBatch], rule: Callable, fields: str) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    layout = [(p.split()[0], kinds[p.split()[1]]) for p in fields.split(",")]
    for b in batches:
        rows: list[dict] = []
        for f, lang, text in zip(b.column("file_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if lang is not None and text is not None:
                rows += rule(f, lang, text)
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in layout], names=[n for n, _ in layout])


def extract_symbols(texts: DataFrame) -> DataFrame:
    """The symbols table of (file_id, lang, text)."""
    rows = texts.select("file_id", "lang", "text").mapInArrow(lambda it: _rows(it, symbols_of, _SYMBOL_FIELDS), _SYMBOL_FIELDS)
    folded = fold_name(F.col("name"))
    return rows.select(F.xxhash64("file_id", "line", "start_column", "name").alias("symbol_id"), "*", F.concat_ws("|", "kind", folded).alias("family_key"), folded.alias("name_folded"))


def extract_references(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """The refs table of (file_id, lang, text), resolved against the symbols of all files."""
    from skerry.operators.graph import candidate_summary, self_references, source_symbols

    rows = texts.select("file_id", "lang", "text").mapInArrow(lambda it: _rows(it, references_of, _REFERENCE_FIELDS), _REFERENCE_FIELDS)
    keyed = cut_lineage(rows.select(F.xxhash64("file_id", "line", "column_number", "symbol_name", "reference_kind").alias("ref_id"), "*", fold_name(F.col("symbol_name")).alias("symbol_name_folded"), fold_name(F.col("container_name")).alias("container_name_folded")))
    files = texts.select("file_id", "path", "lang") if "path" in texts.columns else texts.select("file_id", F.lit("").alias("path"), "lang")
    found = keyed.join(source_symbols(keyed, symbols), "ref_id", "left").join(candidate_summary(keyed, symbols, files), "ref_id", "left")
    whole = found.select(
        *keyed.columns, "source_symbol_id", "target_symbol_id", F.concat(F.lit("sym:"), F.col("target_symbol_id").cast("string")).alias("target_symbol_key"),
        F.coalesce("state", F.lit("unresolved")).alias("resolution_state"), F.col("candidate_count").cast("int").alias("resolution_candidate_count"),
    )
    return whole.join(self_references(whole).withColumnRenamed("is_self", "is_self_reference"), "ref_id", "left").withColumn("is_mutual_recursion", F.lit(None).cast("boolean"))
