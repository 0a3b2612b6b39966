"""The language of a file, by name, first line and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of languages, without regard to case. Two languages claim m and pl, and the text decides.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "pyx": "cython", "pxd": "cython", "js": "javascript", "cjs": "javascript", "mjs": "javascript", "ts": "typescript",
    "cts": "typescript", "mts": "typescript", "jsx": "javascript", "tsx": "typescript", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "podspec": "ruby",
    "groovy": "groovy", "gvy": "groovy", "gy": "groovy", "gsh": "groovy", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "cu": "cuda", "cuh": "cuda", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "hlsl": "hlsl", "wgsl": "wgsl", "metal": "metal", "c": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "h": "c", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "cshtml": "csharp", "razor": "csharp", "m": "ambiguous_m", "mm": "objc",
    "php": "php", "s": "assembly", "asm": "assembly", "nasm": "assembly", "sh": "shell", "sql": "sql", "pgsql": "sql", "tsql": "sql", "plsql": "sql", "pls": "sql",
    "pks": "sql", "pkb": "sql", "plb": "sql", "psql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl",
    "toml": "toml", "config": "xml", "runsettings": "xml", "rules": "config", "xaml": "xml", "axaml": "xml", "sln": "solution", "manifest": "app_manifest",
    "csproj": "msbuild", "fsproj": "msbuild", "vbproj": "msbuild", "props": "msbuild", "targets": "msbuild", "html": "html", "htm": "html", "xhtml": "html",
    "shtml": "html", "css": "css", "scss": "css", "less": "css", "pcss": "css", "sass": "sass", "styl": "stylus", "vue": "vue", "svelte": "svelte", "tf": "terraform",
    "v": "verilog", "sv": "systemverilog", "svh": "systemverilog", "vhd": "vhdl", "vhdl": "vhdl", "lisp": "commonlisp", "lsp": "commonlisp", "cl": "commonlisp",
    "rkt": "racket", "pas": "pascal", "pp": "pascal", "dpr": "pascal", "st": "smalltalk", "smalltalk": "smalltalk", "ada": "ada", "adb": "ada", "ads": "ada",
    "f": "fortran", "f77": "fortran", "f90": "fortran", "f95": "fortran", "f03": "fortran", "f08": "fortran", "for": "fortran", "ftn": "fortran", "cbl": "cobol",
    "cob": "cobol", "cobol": "cobol", "cpy": "cobol", "raku": "raku", "rakumod": "raku", "rakutest": "raku", "t": "perl", "dart": "dart", "scala": "scala", "sc": "scala",
    "r": "r", "ex": "elixir", "exs": "elixir", "lua": "lua", "ml": "ocaml", "mli": "ocaml", "cr": "crystal", "clj": "clojure", "cljs": "clojure", "cljc": "clojure",
    "edn": "clojure", "d": "d", "erl": "erlang", "hrl": "erlang", "jl": "julia", "nim": "nim", "nims": "nim", "pl": "ambiguous_pl", "pm": "perl", "pod": "perl",
    "psgi": "perl", "cgi": "perl", "fcgi": "perl", "sol": "solidity", "tcl": "tcl", "tk": "tcl", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "bas": "vb",
    "cls": "vb", "ctl": "vb", "dob": "vb", "dsr": "vb", "frm": "vb", "pag": "vb", "vba": "vb", "vb": "vb", "vbhtml": "vb", "vbs": "vb", "hs": "haskell", "lhs": "haskell",
    "zig": "zig", "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "gradle": "gradle", "cmake": "cmake", "mk": "makefile", "ps1": "powershell",
    "psm1": "powershell", "psd1": "powershell", "bat": "batch", "cmd": "batch", "bash": "shell", "zsh": "shell", "fish": "shell", "dockerfile": "dockerfile",
    "containerfile": "dockerfile",
}
#: Whole file names of languages, without regard to case.
FILE_NAMES = {
    "dockerfile": "dockerfile", ".dockerfile": "dockerfile", "containerfile": "dockerfile", ".containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile",
    "justfile": "justfile", "cmakelists.txt": "cmake", "vagrantfile": "ruby", "gemfile": "dependency_manifest", "rakefile": "ruby", "podfile": "dependency_manifest",
    "guardfile": "ruby", "capfile": "ruby", "namespace": "r", ".rprofile": "r", "rprofile.site": "r", "build": "python", "build.bazel": "python", "workspace": "python",
    "workspace.bazel": "python", "package.json": "dependency_manifest", "pyproject.toml": "dependency_manifest", "requirements.txt": "dependency_manifest",
    "pipfile": "dependency_manifest", "poetry.toml": "dependency_manifest", "cargo.toml": "dependency_manifest", "composer.json": "dependency_manifest",
    "go.mod": "dependency_manifest", "go.work": "dependency_manifest", "packages.config": "dependency_manifest", "directory.packages.props": "dependency_manifest",
    "package-lock.json": "dependency_lock", "npm-shrinkwrap.json": "dependency_lock", "yarn.lock": "dependency_lock", "pnpm-lock.yaml": "dependency_lock",
    "bun.lock": "dependency_lock", "bun.lockb": "dependency_lock", "gemfile.lock": "dependency_lock", "cargo.lock": "dependency_lock", "composer.lock": "dependency_lock",
    "poetry.lock": "dependency_lock", "pipfile.lock": "dependency_lock", "go.sum": "dependency_lock", "uv.lock": "dependency_lock", "packages.lock.json": "dependency_lock",
    ".editorconfig": "editorconfig", ".gitignore": "gitignore", ".gitattributes": "gitattributes", ".dockerignore": "dockerignore",
}
#: Beginnings of file names that are variants of these.
NAME_STEMS = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}
#: Interpreters of first lines; any name that begins with python is Python's.
INTERPRETERS = {
    "bash": "shell", "sh": "shell", "zsh": "shell", "fish": "shell", "dash": "shell", "ksh": "shell", "ash": "shell", "node": "javascript", "nodejs": "javascript", "ruby": "ruby",
    "perl": "perl", "tclsh": "tcl", "wish": "tcl", "matlab": "matlab", "octave": "matlab", "octave-cli": "matlab", "prolog": "prolog", "swipl": "prolog", "sicstus": "prolog",
    "gprolog": "prolog", "php": "php", "lua": "lua", "pwsh": "powershell", "powershell": "powershell",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language_of(path: Column, text: Column | None = None) -> Column:
    """By the file name, then the extension, then the first line of the text; null if nothing tells.

    Of the extensions that two languages share the first line decides, then what the text looks like;
    without a text they are the more common one: Objective-C and Perl.
    """
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    stem = F.regexp_extract(name, "^([a-z]+)[._-]", 1)
    found = F.coalesce(_looked_up(FILE_NAMES, name), _looked_up(EXTENSIONS, ext), _looked_up(NAME_STEMS, stem))
    likely = F.when(found == "ambiguous_m", "objc").when(found == "ambiguous_pl", "perl")
    if text is None:
        return F.coalesce(likely, found)
    interpreter = F.regexp_extract(F.substring(text, 1, 256), r"^#!\s*(?:/usr/bin/env\s+(?:-S\s+)?)?(?:/\S*/)?([a-z][a-z-]*)", 1)
    script = F.when(interpreter.startswith("python"), "python").otherwise(_looked_up(INTERPRETERS, interpreter))
    objc, matlab = text.rlike(r"(?m)^\s*(@interface|@implementation|@protocol|@end|#import|@import)"), text.rlike(r"(?m)^\s*(function\b|end\s*;?\s*$|%|classdef\b)")
    prolog, perl = text.rlike(r"(?m)^\s*:-|^[a-z]\w*(\(.*\))?\s*:-|^[a-z]\w*\(.*\)\.\s*$"), text.rlike(r"(?m)^\s*(use\s+(strict|warnings)|my\s+[$@%]|sub\s+\w+|package\s+\w+)")
    told = F.when(found == "ambiguous_m", F.coalesce(script, F.when(matlab & ~objc, "matlab"), F.lit("objc"))).when(found == "ambiguous_pl", F.coalesce(script, F.when(prolog & ~perl, "prolog"), F.lit("perl")))
    shared = F.when(ext == "t", script)
    return F.coalesce(told, shared, found, script)
