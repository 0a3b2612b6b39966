import pytest
from pyspark.sql import functions as F

from skerry.functions import names, registry
from skerry.operators import issues, service
from skerry.sources import projects


def test_selectors(spark):
    files = spark.createDataFrame([(1, "a.py")], "file_id int, path string")
    rows = [(5, 1, "class", None, "A", 3), (6, 1, "method", "A", "b", 4)]
    symbols = lambda rows: spark.createDataFrame(rows, "symbol_id int, file_id int, kind string, container_qualified_name string, name string, line int")
    made = {r.symbol_id: r.selector for r in service.selectors(symbols(rows), files, 3).collect()}
    assert service.selected(symbols(rows), files, made[6], 3).first().name == "b"
    with pytest.raises(service.StaleSelector):
        service.selected(symbols(rows), files, made[6], 4)
    with pytest.raises(service.StaleSelector):
        service.selected(symbols([rows[0], (6, 1, "method", "A", "c", 4)]), files, made[6], 3)
    with pytest.raises(ValueError):
        service.selected(symbols(rows), files, "b", 3)


def test_batch_and_feedback(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "a int, b string")
    got = [(r.ordinal, r.query, r.row) for r in service.batch([("one", df), ("two", df.select("a"))], 2).collect()]
    assert got == [(0, "one", '{"a":1,"b":"x"}'), (0, "one", '{"a":2,"b":null}'), (1, "two", '{"a":1}'), (1, "two", '{"a":2}')]
    folder = f"file://{tmp_path}/s"
    assert [service.suggest(spark, folder, {"kind": "ranking", "text": t, "query": "q"}) for t in ("one", "two")] == [1, 2]
    assert [(r.number, r.text) for r in service.suggestions(spark, folder).collect()] == [(1, "one"), (2, "two")]
    with pytest.raises(ValueError):
        service.suggest(spark, folder, {"kind": "praise", "text": "x"})


def test_packages():
    cases = {
        "package-lock.json": ('{"packages": {"": {}, "node_modules/@a/b": {"version": "1.0.0"}, "node_modules/c": {"version": "2"}}}', [("@a/b", "1.0.0"), ("c", "2")]),
        "Cargo.lock": ('[[package]]\nname = "serde"\nversion = "1.0.1"\n\n[[package]]\nname = "log"\nversion = "0.4"\n', [("log", "0.4"), ("serde", "1.0.1")]),
        "yarn.lock": ('left-pad@^1.0.0:\n  version "1.3.0"\n\n"@x/y@~2":\n  version "2.1"\n', [("@x/y", "2.1"), ("left-pad", "1.3.0")]),
        "App.csproj": ('<Project><ItemGroup><PackageReference Include="N" Version="3"/><PackageReference Include="M"><Version>4</Version></PackageReference></ItemGroup></Project>', [("M", "4"), ("N", "3")]),
        "pom.xml": ('<project xmlns="u"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>', [("g:a", "1")]),
        "Gemfile.lock": ("GEM\n  specs:\n    rake (13.0)\n      dep (1)\n", [("rake", "13.0")]),
        "go.sum": ("a.b/c v1.2.3 h1:x=\na.b/c v1.2.3/go.mod h1:y=\n", [("a.b/c", "v1.2.3")]),
        "composer.lock": ('{"packages": [{"name": "v/p", "version": "1"}]}', [("v/p", "1")]),
        "requirements-dev.txt": ("a==1\nb\n# c\n", [("a", "1"), ("b", None)]),
        "packages.lock.json": ('{"version": 1, "dependencies": {"net8.0": {"N": {"type": "Direct", "resolved": "1.2"}}}}', [("N", "1.2")]),
    }
    for name, (text, want) in cases.items():
        assert projects.packages_of(f"d/{name}", text) == want, name
    assert projects.packages_of("package.json", "{") == [] and projects.packages_of("x.py", "a") == [] and projects.packages_of(None, None) == []


def test_projects(spark):
    sln = 'Project("{F}") = "App", "src\\App\\App.csproj", "{G}"\nEndProject\nProject("{F}") = "Folder", "Folder", "{G}"\nProject("{F}") = "Out", "..\\Out\\Out.csproj", "{G}"\n'
    texts = spark.createDataFrame([("All.sln", sln), ("src/App/Sub/Sub.csproj", "<Project/>"), ("x.py", "")], "path string, text string")
    found = projects.projects(texts)
    assert {tuple(r) for r in found.collect()} == {("All.sln", "App", "src/App"), ("src/App/Sub/Sub.csproj", "Sub", "src/App/Sub")}
    files = spark.createDataFrame([(p,) for p in ("src/App/a.cs", "src/App/Sub/b.cs", "src/Application/c.cs", "d.cs")], "path string")
    assert [r.path for r in projects.project_files(files, found, "app").collect()] == ["src/App/a.cs"]
    assert [r.path for r in projects.project_files(files, found, "Sub").collect()] == ["src/App/Sub/b.cs"]


def test_text_issues(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, "a\rb"), (3, "a\nb\r\n"), (4, "\ufeffx\x00\ufffd"), (5, None), (6, "")], "doc_id int, text string")
    got = {(r.doc_id, r.kind, r.n) for r in issues.text_issues(df).collect()}
    assert got == {(1, "mixed_line_endings_three_way", 3), (2, "cr_only_line_endings", 1), (3, "mixed_line_endings", 2), (4, "bom", 1), (4, "null_byte", 1), (4, "replacement_char", 1)}


def test_registered_functions(spark):
    assert "name_fold" in registry.register(spark)
    row = spark.sql("select name_fold('Straße') a, name_fold('ABC') b, name_leaf('[dbo].[My T]') c, heading_slug(' A, b c ') d, plain_name('@class.@X') e, path_dir('a/b/c.py') f, path_leaf('a/b/c.py') g, resolve_links('docs/a.md', '../b.md#x') h").first()
    assert tuple(row) == ("strasse", "abc", "My T", "a-b-c", "class.X", "a/b/", "c.py", "b.md")
    df = spark.createDataFrame([(" A, b c ",)], "t string")
    assert df.select(names.heading_slug(F.col("t"))).first()[0] == row.d
