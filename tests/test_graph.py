import random

from pyspark.sql import functions as F

from skerry.operators import edges, graph, search, structure
from skerry.sources import projects, sinks


def components(edges_):
    """Strongly connected components with a cycle, by reachability."""
    nodes = {n for e in edges_ for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges_:
            reach[a] |= reach[b]
    out = set()
    for n in nodes:
        group = frozenset(m for m in nodes if m in reach[n] and n in reach[m])
        if len(group) > 1 or (n, n) in edges_:
            out.add(group)
    return out


def test_cycles(spark):
    rng = random.Random(8)
    for size, n in ((12, 16), (20, 40), (8, 4)):
        es = {(rng.randrange(size), rng.randrange(size)) for _ in range(n)}
        df = spark.createDataFrame(list(es) + [(1, None)], "src int, dst int")
        got: dict = {}
        for r in structure.cycles(df).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == components(es)
    assert structure.cycles(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).count() == 0


def _calls(spark, pairs):
    rows = [(i, 1, b, "call", i, 1, a, b.lower(), a.lower()) for i, (a, b) in enumerate(pairs)]
    refs = spark.createDataFrame(rows, "ref_id int, file_id int, symbol_name string, reference_kind string, line int, column_number int, container_name string, symbol_name_folded string, container_name_folded string")
    return refs, spark.createDataFrame([(1, "a.py", "python")], "file_id int, path string, lang string")


def test_impact(spark):
    refs, files = _calls(spark, [("Run", "Leaf"), ("Outer", "Bridge"), ("Bridge", "Target"), ("Target", "Outer"), ("Leaf", "Leaf"), ("Main", "Outer")])
    rows, why = graph.impact(refs, files, "Target", "python", 5)
    assert {(r.caller, r.depth) for r in rows.collect()} == {("bridge", 1), ("outer", 2), ("main", 3)} and why == "exhausted"
    assert graph.impact(refs, files, "Target", "python", 1)[1] == "depth"
    assert graph.impact(refs, files, "Target", "python", 5, max_rows=2)[1] == "budget"
    assert graph.impact(refs, files, "nothing", "python", 3)[0].count() == 0
    paths = {(r.caller, r.depth, r.path) for r in graph.impact_paths(refs, files, "Target", "python", 3).collect()}
    assert ("main", 3, "target <- bridge <- outer <- main") in paths and len(paths) == 3


def test_dispatch(spark):
    s = spark.createDataFrame([(1, "class", "A", "class A extends B implements I {"), (1, "class", "B", "class B : C"), (1, "class", "C", "class C"), (1, "class", "P", "class P(Q):")], "file_id int, kind string, name string, signature string")
    f = spark.createDataFrame([(1, "x", "java")], "file_id int, path string, lang string")
    got = {(r.type, r.base, r.depth) for r in edges.dispatch_targets(s, f).collect()}
    assert ("B", "C", 1) in got and ("P", "Q", 1) in got and ("A", "B", 1) in got and ("A", "C", 2) in got


def test_language_edges(spark):
    texts = spark.createDataFrame([(1, "p/a.py", "python", "from .b import x\nimport os\nfrom p.c import y\n"), (2, "docs/i.md", "markdown", "[a](../r.md) [b](x.md#q) [c](http://z)"), (3, "requirements.txt", None, "foo==1.2\n# c\nbar>=2\n"), (4, "w/package.json", "json", '{"dependencies": {"left": "^1.3.0"}}')], "file_id int, path string, lang string, text string")
    files = spark.createDataFrame([(1, "p/a.py", "python"), (5, "p/b.py", "python"), (6, "p/c/__init__.py", "python"), (7, "r.md", "markdown")], "file_id int, path string, lang string")
    assert {(r.module, r.target) for r in edges.import_edges(texts, files).collect()} == {(".b", "p/b.py"), ("os", None), ("p.c", "p/c/__init__.py")}
    assert [tuple(r) for r in edges.link_edges(texts, files).collect()] == [("docs/i.md", "r.md", 1)]
    assert {(r.package, r.version) for r in projects.manifest_packages(texts).collect()} == {("foo", "1.2"), ("bar", "2"), ("left", "^1.3.0")}


def test_metadata_edges(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "    [Obsolete]\n@Test\nx[Foo]\n[Twice]")], "chunk_id int, file_id int, start_line int, content string")
    syms = spark.createDataFrame([(2, "class", "ObsoleteAttribute"), (3, "class", "Obsolete"), (4, "class", "Test"), (5, "class", "Twice"), (6, "class", "Twice")], "file_id int, kind string, name string")
    files = spark.createDataFrame([(i, f"f{i}", "csharp") for i in range(1, 7)], "file_id int, path string, lang string")
    assert {(r.src, r.dst, r.name) for r in edges.metadata_edges(syms, files, chunks).collect()} == {(1, 2, "Obsolete"), (1, 4, "Test")}


def test_raw_queries(spark):
    texts = {1: "alpha beta gamma", 2: "beta alpha", 3: "alpha x x x x gamma", 4: "alphabet soup", 5: ""}
    chunks = spark.createDataFrame([(i, i, 1, t) for i, t in texts.items()], "chunk_id int, file_id int, start_line int, content string")
    run = lambda q: {r.chunk_id for r in search.raw_search(chunks, q).collect()}
    assert run("alpha") == {1, 2, 3} and run("alpha*") == {1, 2, 3, 4} and run('"alpha beta"') == {1}
    assert run("alpha NOT beta") == {3} and run("soup OR gamma") == {1, 3, 4} and run("alpha gamma") == {1, 3}
    assert run("NEAR(alpha gamma, 2)") == {1} and run("NEAR(gamma alpha, 4)") == {1, 3} and run('(beta OR soup) AND "alpha"') == {1, 2}
    for bad in ("path:alpha", "content:", " OR ".join(["a"] * 65), "(alpha", "AND", '"a', "NEAR(a", "a NOT"):
        try:
            run(bad)
        except search.QuerySyntaxError:
            continue
        raise AssertionError(bad)


def test_exports(spark):
    e = spark.createDataFrame([('a"b', "c<d", 2)], "src string, dst string, n int")
    assert sinks.dot_edges(e).first().value == '"a\\"b" -> "c<d" [weight=2];'
    assert sinks.graphml_edges(e).first().value == '<edge source="a&quot;b" target="c&lt;d"><data key="n">2</data></edge>'
    rows = spark.createDataFrame([("p", 3, 5, 2, "t")], "path string, line int, column int, length int, text string")
    assert '"line":2' in sinks.lsp_locations(rows).first().value and '"startLine":3' in sinks.sarif_results(rows, "r").first().value
    assert sinks.quickfix(rows).first().value == "p:3:5:t"


def test_dependencies_by_ambiguous_names(spark, monkeypatch):
    monkeypatch.setattr(structure, "AMBIGUOUS_FROM", 2)
    rng = random.Random(5)
    langs = {f: rng.choice(["go", "go", "java"]) for f in range(1, 25)}
    names = ["score", "scored", "run", "get", "a", "b", "c", "d"]
    defs = [(f, rng.choice(names[:5] if f % 3 else names)) for f in langs for _ in range(2)]
    uses = [(f, rng.choice(names), line) for f in langs for line in range(rng.randrange(6))]
    files = spark.createDataFrame([(f, f"p{f}", l) for f, l in langs.items()], "file_id bigint, path string, lang string")
    syms = spark.createDataFrame([(i, f, n, n, None) for i, (f, n) in enumerate(defs)], "symbol_id bigint, file_id bigint, name string, name_folded string, family_key string")
    refs = spark.createDataFrame([(i, f, n, "call", line, 1, n) for i, (f, n, line) in enumerate(uses)], "ref_id bigint, file_id bigint, symbol_name string, reference_kind string, line int, column_number int, symbol_name_folded string")
    pairs: dict = {}
    for f, n, _ in uses:
        for g in {g for g, m in defs if m == n and langs[g] == langs[f] and g != f}:
            pairs.setdefault((f, g), {}).setdefault(n, 0)
            pairs[(f, g)][n] += 1
    dependents: dict = {}
    for _, g in pairs:
        dependents[g] = dependents.get(g, 0) + 1
    assert {r.dst: r.dependents for r in structure.dependent_counts(refs, syms, files).collect()} == dependents
    score = {k: v for k, v in ((k, sum(c for n, c in by.items() if n.startswith("score"))) for k, by in pairs.items()) if v}
    assert {(r.src, r.dst): r.n for r in structure.dependencies_by_name(refs, syms, files, "score").collect()} == score
    noise: tuple = ()
    edges = {(int(r.src_path[1:]), int(r.dst_path[1:])): r.reference_count for r in structure.file_dependencies(refs, syms, files).collect()}
    assert edges == {k: sum(by.values()) for k, by in pairs.items()}
    ranked = sorted((-round(sum(by.values()) * sum(1 if n in noise else 10 for n in by) / (len(by) * 10), 4), f, g) for (f, g), by in pairs.items())
    for limit in (5, 40, 10_000):
        got = [(-r.score, r.src, r.dst) for r in structure.ranked_dependencies(refs, syms, files, limit).collect()]
        assert got == ranked[:limit]


def test_private_names_in_text_are_used(spark):
    files = spark.createDataFrame([(1, "a.cs", "csharp"), (2, "b.cs", "csharp"), (3, "c.cs", "csharp")], "file_id int, path string, lang string")
    part = "public partial class T {"
    symbols = spark.createDataFrame(
        [(1, 1, "class", "T", part, None, 1, "public"), (2, 2, "class", "T", part, None, 1, "public"), (3, 3, "class", "T", "class T {", None, 1, "public"), (4, 1, "method", "own", "", "T", 2, "private"), (5, 1, "method", "other", "", "T", 3, "private"), (6, 1, "method", "never", "", "T", 4, "private"), (7, 3, "method", "far", "", "U", 2, "private")],
        "symbol_id int, file_id int, kind string, name string, signature string, container_qualified_name string, line int, visibility string",
    ).withColumn("name_folded", F.lower("name"))
    refs = spark.createDataFrame([], "ref_id int, file_id int, target_symbol_id int, symbol_name_folded string, container_name_folded string")
    chunks = spark.createDataFrame([(1, 1, 1, part + "\n void own() {\n void other() {\n void never() {\n own();"), (2, 2, 1, part + "\n x = other;"), (3, 3, 1, "class T {\n void far() {\n never, T, farther")], "chunk_id int, file_id int, start_line int, content string")
    got = {r.symbol_id for r in structure.unused_beyond_text(symbols, refs, files, chunks).collect()}
    assert got == {1, 2, 3, 6, 7}
