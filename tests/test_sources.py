import os

import pytest
from pyspark.sql import functions as F

from skerry.sources import extractors, workspace
from skerry.sources.languages import language_of


def _tree(root, files):
    for path, content in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_ignore_rules():
    r = workspace.IgnoreRules(["# note", "*.log", "!keep.log", "build/", "/top.txt", "a/**/z.py", "doc?.md"])
    ignored = ["x.log", "d/x.log", "build/a.c", "d/build/a.c", "top.txt", "a/b/c/z.py", "a/z.py", "doc1.md"]
    kept = ["keep.log", "d/keep.log", "build", "d/top.txt", "b/z.py", "doc12.md", "x.logs"]
    assert all(r.ignored(p) for p in ignored), [p for p in ignored if not r.ignored(p)]
    assert not any(r.ignored(p) for p in kept), [p for p in kept if r.ignored(p)]


def test_decode():
    assert workspace.decode("é\n".encode()) == ("é\n", "utf-8")
    assert workspace.decode(b"\xef\xbb\xbfa") == ("a", "utf-8-bom")
    assert workspace.decode("hé".encode("utf-16")) == ("hé", "utf-16")
    assert workspace.decode("hello wörld".encode("utf-16-le")) == ("hello wörld", "utf-16-le")
    assert workspace.decode("hello wörld".encode("utf-16-be")) == ("hello wörld", "utf-16-be")
    assert workspace.decode(b"a\xff") == ("a\ufffd", "utf-8-lenient")
    assert workspace.decode(b"") == ("", "utf-8")


def test_ingest(spark, tmp_path):
    _tree(tmp_path, {
        "src/a.py": "import os\n\nclass A:\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n",
        "src/B.java": "package p;\npublic class B {\n    private int f(int a) {\n        return new C(a).go();\n    }\n}\n",
        "node_modules/x.js": "x", "bin.dat": b"\x00\x01", "big.py": "x" * 3000, "skip.log": "no", "empty.py": "", "src/deep/er/__init__.py": "z = 1\n", "src/deep/bin/no.py": "", "crlf.go": "package a\r\n\r\nfunc F() {\r\n}\r\n",
    })
    scan = workspace.scan_workspace(spark, str(tmp_path), workspace.IgnoreRules(["*.log"]), max_bytes=2000)
    rows = {r.path: r for r in workspace.decoded(scan).collect()}
    assert set(rows) == {"src/a.py", "src/B.java", "bin.dat", "big.py", "crlf.go", "empty.py", "src/deep/er/__init__.py"}
    assert rows["empty.py"].text == "" and rows["src/deep/er/__init__.py"].text == "z = 1\n"
    assert rows["bin.dat"].skipped == "binary" and rows["big.py"].skipped == "too_large" and rows["big.py"].text is None
    assert "\r" not in rows["crlf.go"].text
    tables = workspace.ingest(spark, str(tmp_path), workspace.IgnoreRules(["*.log", "big.py"]))
    files = {r.path: r for r in tables["files"].collect()}
    assert files["src/a.py"].lang == "python" and files["src/a.py"].lines == 8
    symbols = {(r.kind, r.name, r.container_name, r.start_line, r.end_line) for r in tables["symbols"].collect()}
    assert {("class", "A", None, 3, 5), ("method", "run", "A", 4, 5), ("function", "helper", None, 7, 8), ("class", "B", None, 2, 6), ("method", "f", "B", 3, 5), ("function", "F", None, 3, 4)} <= symbols
    refs = {(r.symbol_name, r.reference_kind, r.container_name, r.resolution_state) for r in tables["refs"].collect()}
    assert ("helper", "call", "run", "resolved") in refs and ("C", "instantiate", "f", "unresolved") in refs and ("os", "import", None, "unresolved") in refs
    assert tables["chunks"].count() == 4


def test_written_index_reads_back(spark, tmp_path):
    from skerry.sources.sinks import write_index

    _tree(tmp_path / "w", {"a.py": "def f():\n    g()\n"})
    tables = workspace.ingest(spark, str(tmp_path / "w"))
    write_index(tables, str(tmp_path / "index"))
    back = workspace.read_index(spark, str(tmp_path / "index"))
    assert back["symbols"].count() == 1 and back["refs"].select("target_symbol_id").count() == 1
    # a run that fails before it publishes leaves what readers see as it was
    from skerry.sources import sinks

    failing = tables | {"refs": tables["refs"].withColumn("ref_id", F.raise_error(F.lit("lost")).cast("bigint"))}
    with pytest.raises(Exception):
        write_index(failing, str(tmp_path / "index"))
    assert sinks.published(spark, str(tmp_path / "index"))["data"].endswith(os.path.basename(sinks.published(spark, str(tmp_path / "index"))["data"]))
    assert workspace.read_index(spark, str(tmp_path / "index"))["symbols"].count() == 1
    write_index({n: df.limit(0) for n, df in tables.items()}, str(tmp_path / "index"))
    assert workspace.read_index(spark, str(tmp_path / "index"))["symbols"].count() == 0


def test_bad_indexes_are_refused(spark, tmp_path):
    from skerry.sources.sinks import write_index

    _tree(tmp_path / "w", {"src/a.py": "def f():\n    g()\n", "lib/b.py": "x = 1\n"})
    tables = workspace.ingest(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        workspace.read_index(spark, str(tmp_path / "none"))
    for k, bad in enumerate((tables | {"files": tables["files"].drop("lang")}, tables | {"files": tables["files"].withColumn("size", F.lit("x"))}, {n: df for n, df in tables.items() if n != "refs"})):
        write_index(bad, str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError):
            workspace.read_index(spark, str(tmp_path / f"bad{k}"))
    write_index(tables, str(tmp_path / "good"))
    workspace.import_index(spark, str(tmp_path / "good"), str(tmp_path / "copy"), "src")
    back = workspace.read_index(spark, str(tmp_path / "copy"))
    assert [r.path for r in back["files"].collect()] == ["src/a.py"] and back["chunks"].count() == 1


def test_rules_of_directories(spark, tmp_path):
    _tree(tmp_path, {".gitignore": "*.log\nout*/\n", "a/.gitignore": "!keep.log\n/top.txt\n", "a/keep.log": "1", "b/keep.log": "1", "a/top.txt": "1", "a/c/top.txt": "1", "outer/x.py": "1", "x.py": "1"})
    rules = workspace.tree_rules(spark, str(tmp_path))
    rows = {r.path for r in workspace.scan_workspace(spark, str(tmp_path), rules).collect()}
    assert rows == {".gitignore", "a/.gitignore", "a/keep.log", "a/c/top.txt", "x.py"}


def test_nested_repositories(spark, tmp_path):
    _tree(tmp_path, {".gitmodules": '[submodule "m"]\n\tpath = libs/m\n\turl = u\n[submodule "bad"]\n path = ../x\n', "libs/m/a.py": "1", "libs/n.py": "1", "sub/.git/HEAD": "ref", "sub/q.py": "1", "subway/r.py": "1", "wt/.git": "gitdir: x", "wt/s.py": "1"})
    nested = workspace.nested_repositories(spark, str(tmp_path))
    assert nested == ["libs/m", "sub", "wt"]
    assert {r.path for r in workspace.scan_workspace(spark, str(tmp_path), nested=nested).collect()} == {".gitmodules", "libs/n.py", "subway/r.py"}


def test_chunks_of_texts(spark):
    texts = {1: "\n".join(map(str, range(80))) + "\n", 2: "\n".join(map(str, range(81))), 3: "", 4: None, 5: "a\n\n", 6: "x" * 70000, 7: "\n".join(map(str, range(150)))}
    df = spark.createDataFrame(list(texts.items()), "file_id int, text string").selectExpr("*", "'c' as lines")
    got = sorted((r.file_id, r.chunk_index, r.start_line, r.end_line) for r in workspace.chunk_texts(df).collect())
    assert got == [(1, 0, 1, 80), (2, 0, 1, 80), (2, 1, 71, 81), (5, 0, 1, 2), (7, 0, 1, 80), (7, 1, 71, 150)]


def test_languages(spark):
    names = {"a/b.PY": "python", "Dockerfile": "dockerfile", "x.unknown": None, "noext": None, "m.m": "matlab", "q.ts": "typescript", "Dockerfile.dev": "dockerfile", "Makefile-x": "makefile", "go.sum": "dependency_lock", "a.cuh": "cuda"}
    df = spark.createDataFrame([(n, "function f\nend") for n in names], "path string, text string")
    assert {r.path: r.lang for r in df.select("path", language_of(F.col("path"), F.col("text")).alias("lang")).collect()} == names
    df = spark.createDataFrame([("tool", "#!/usr/bin/env python3\nx")], "path string, text string")
    assert df.select(language_of(F.col("path"), F.col("text")).alias("l")).first().l == "python"


SNIPPETS = {
    "javascript": ("export class A {\n  go(x) {\n    return b(x);\n  }\n}\nconst f = (y) => new A(y);\n", {("class", "A"), ("method", "go"), ("function", "f")}, {("b", "call"), ("A", "instantiate")}),
    "csharp": ("namespace N;\npublic class A {\n    public int P { get; }\n    void M(int x) {\n        Q.Run(x);\n    }\n}\n", {("namespace", "N"), ("class", "A"), ("property", "P"), ("method", "M")}, {("Run", "call")}),
    "go": ("package a\n\ntype T struct {\n}\n\nfunc (t *T) M() {\n\tf()\n}\n", {("struct", "T"), ("method", "M")}, {("f", "call")}),
    "rust": ("pub struct S {\n}\nfn f() {\n    g();\n}\n", {("struct", "S"), ("function", "f")}, {("g", "call")}),
    "sql": ("CREATE TABLE dbo.t (a int);\nselect * from u;\n", {("table", "dbo.t")}, {("u", "call")}),
    "markdown": ("# One\ntext [x](y.md)\n## Two\n", {("heading", "One"), ("heading", "Two")}, {("y.md", "link")}),
    "html": ('<h1>Top</h1><a id="z" href="q.html">', {("heading", "Top")}, {("q.html", "link")}),
    "ruby": ("class A\n  def b\n    c()\n  end\nend\n", {("class", "A"), ("method", "b")}, {("c", "call")}),
    "php": ("<?php\nclass A {\n  public function b() {\n    c();\n  }\n}\n", {("class", "A"), ("function", "b")}, {("c", "call")}),
    "kotlin": ("class A {\n  fun b() {\n    c()\n  }\n}\n", {("class", "A"), ("function", "b")}, {("c", "call")}),
    "terraform": ('resource "x" "y" {\n}\n', {("resource", "y")}, set()),
    "protobuf": ("message M {\n}\nservice S {\n  rpc G (M) returns (M);\n}\n", {("message", "M"), ("service", "S"), ("method", "G")}, None),
}


def test_extractors():
    for lang, (text, symbols, refs) in SNIPPETS.items():
        got = {(s["kind"], s["name"]) for s in extractors.symbols_of(1, lang, text)}
        assert symbols <= got, (lang, got)
        if refs is not None:
            found = {(r["symbol_name"], r["reference_kind"]) for r in extractors.references_of(1, lang, text)}
            assert refs <= found, (lang, found)
    assert extractors.symbols_of(1, "nolang", "x") == []


def test_strings_and_comments_hold_no_references():
    refs = extractors.references_of(1, "python", "x = 'call(1)'  # other(2)\nreal(3)\n")
    assert [r["symbol_name"] for r in refs] == ["real"]


OVER_LINES = {
    "python": ('''"""doc with call(1)\nand class No:\n"""\nclass A(Base, mixin.Other):\n    @cached\n    def run(\n        self,\n        x=f(")"),\n    ):\n        return B(x)\n\ny = g()\n''', {("class", "A", 4, 10), ("method", "run", 6, 10)}, {("Base", "type_reference", "A"), ("Other", "type_reference", "A"), ("cached", "annotation", "A"), ("f", "call", "run"), ("B", "instantiate", "run"), ("g", "call", None)}),
    "csharp": ('/* class No {\n */\npublic class A : Base<int>, IThing {\n    var s = @"x\n void No() {\n";\n    [Obsolete]\n    public Task<Dictionary<string, int>> Run(\n        int a,\n        string b)\n    {\n        Clicked += OnClick;\n        return new B<int>(a).Go("}");\n    }\n}\n', {("class", "A", 3, 15), ("method", "Run", 8, 14)}, {("Base", "type_reference", "A"), ("IThing", "type_reference", "A"), ("Obsolete", "annotation", "A"), ("OnClick", "subscribe", "Run"), ("B", "instantiate", "Run"), ("Go", "call", "Run")}),
    "javascript": ("const t = `\nfunction no() { call() }\n`;\nexport class A extends B {\n  run(a) {\n    /* x(\n */ return f(a);\n  }\n}\nfunction g(\n  a,\n  b,\n) {\n  h();\n}\n", {("class", "A", 4, 9), ("method", "run", 5, 8), ("function", "g", 10, 15)}, {("B", "type_reference", "A"), ("f", "call", "run"), ("h", "call", "g")}),
    "java": ('class A extends B implements C {\n  String s = """\n    void no() {\n  """;\n  @Override\n  public Map<String, List<Integer>> run(int a,\n      int b) {\n    return new D(a).go();\n  }\n}\n', {("class", "A", 1, 10), ("method", "run", 6, 9)}, {("B", "type_reference", "A"), ("C", "type_reference", "A"), ("Override", "annotation", "A"), ("D", "instantiate", "run"), ("go", "call", "run")}),
    "go": ("package p\n\nvar q = `\nfunc no() {\n`\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Run(\n\ta int,\n) *T {\n\treturn &T{a: f(a)}\n}\n", {("struct", "T", 7, 9), ("method", "Run", 11, 15)}, {("T", "instantiate", "Run"), ("f", "call", "Run")}),
}


@pytest.mark.parametrize("lang", sorted(OVER_LINES))
def test_extractors_over_lines(lang):
    text, symbols, refs = OVER_LINES[lang]
    assert {(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in extractors.symbols_of(1, lang, text)} == symbols
    assert {(r["symbol_name"], r["reference_kind"], r["container_name"]) for r in extractors.references_of(1, lang, text) if r["reference_kind"] != "import"} == refs
