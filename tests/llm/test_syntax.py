import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import lexstate as lx
from skerry.llm import syntax as sx
from skerry.llm.grammar import why_invalid

VALID = {
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1", "import x, { y as z } from './m';\nexport default class A extends B { #p = 1; static { go(); } get v() { return this.#p } async *gen() { yield* x } }",
        "const f = async ({ a, b = 2, ...c }, [d] = []) => { for await (const q of it) { await q } return a?.b?.[0] ?? `t${`in${1}`}` };\nif (/[/{]/.test(s)) a = b / c / d\nelse label: while (1) { break label }",
        "var o = { get a() { return 1 }, set a(v) {}, [k + 1]: 2, async m() {}, *g() {}, 'q': 1, 3: 4, ...r, s };\n[a, b] = [b, a];\n({ x: y } = z);\nx = a ? b : c ? d : e;\ni++\n++j",
        "switch (x) { case 1: case 2: y(); break; default: }\ntry { a() } catch { b() } finally { c() }\ndo x--; while (x > 0)\nfor (;;) {}\nfor (var i = 0, n = 9; i < n; i++) {}\nnew (a.b)(1)\nnew A\nlet async = 1, of = 2, get = 3",
        "x = function* () { yield }\ny = (1, 2)\nz = a => b => ({ c: a })\nw = !a instanceof B\nif (a) ; else ;\nthrow new Error(`a\n${b}`)",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\n@A(v = {1, 2}) public abstract class C<T extends Comparable<? super T>> extends D<T> implements E, F { static { } int[] a = {1, 2,}, b[]; C() { this(1); } <R> R m(final List<? extends R>... xs) throws X { return (R) xs[0]; } abstract void n(); }",
        "class A { void m() { for (var x : xs) for (int i = 0, j = 1; i < j; i++, j--) ; Runnable r = () -> {}; f = (a, b) -> a + b; g = A::new; h = int[]::new; List<String>[] q = null; x = y instanceof String s && s.isEmpty() ? 1 : 2; int v = switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; label: while (true) break label; synchronized (this) { } try (var z = o(); w) { } catch (A | B e) { } finally { } assert x : \"m\"; new Object() { int q; }.go(); } }",
        "enum E implements I { A(1) { void x() { } }, B; final int k; E(int... k) { } }\ninterface I { default void m() { } int X = 1; }\nrecord P<T>(T a, int b) { P { } static int c; }\n@interface Q { int v() default 1; }\nsealed interface S permits T { }",
        'class T { String s = """\n  a "quoted" {\n  """; char c = \'\\u0041\'; double d = 1e-3f + .5 + 0x1F; int x = a >>> 2 >> 1; boolean b = i < j && k > l; }',
    ],
    "csharp": [
        "using System;\nusing static A.B;\nusing X = A.B<int>;\nnamespace N.M;\n[A(1, B = 2)] public sealed partial class C<T> : D<T>, I where T : class, new() { public int P { get; private set; } = 1; public int Q => 2; this_is: ; }".replace(" this_is: ;", ""),
        "namespace N { struct S { public static S operator +(S a, S b) => a; public static implicit operator int(S s) { return 0; } event Action E; int this[int i] { get { return i; } } ~S() { } S(int x) : this() { } } enum E : byte { A = 1, B, } delegate void D<T>(ref T x); interface I { void M(); } record R(int A, string B) { } }",
        'class A { async Task<int> M() { var q = from x in xs where x > 1 orderby x descending select new { x, y = 2 }; await foreach (var z in s) { } var t = (1, b: 2); var (u, v) = t; if (o is string { Length: > 3 } w && w != null) return 1; int k = o switch { int i when i > 0 => 1, null => 2, _ => 3 }; string r = $"a{x:N2}{{}}{(b ? "y" : "n")}" + @"c:\\d""e" + """raw "x" """; int? n = a?.b?[0] ?? throw new X(); lock (this) { } using var d = e; foreach (int f in g) continue; Func<int, int> h = static (int p) => p + 1; list[^1] = arr[1..^2]; goto end; end: return default; } }',
        "#if DEBUG\nclass A { \n#else\nclass A { }\n#endif\n#region r\nclass B { int x = 1; }\n#endregion",
        "Console.WriteLine(1);\nvar x = new List<Dictionary<string, int>> { new() { [\"a\"] = 1 } };\nint F(int a) => a * 2;",
    ],
    "go": [
        'package a\nimport (\n\t"fmt"\n\tx "y/z"\n)\ntype T[K comparable, V any] struct {\n\tA, B int `tag`\n\t*E\n\tf func(int) (string, error)\n}\ntype I interface {\n\tM(x int) error\n\t~int | ~string\n}\nfunc (t *T[K, V]) M(a, b int, c ...string) (n int, err error) {\n\tdefer func() { recover() }()\n\tif x, ok := m[k]; ok && x > 1 {\n\t\treturn 1, nil\n\t} else if y := f(); y {\n\t}\n\treturn\n}',
        "package a\nvar (\n\tx = []int{1, 2, 3}\n\ty = map[string][]T{\"a\": {{1}, {2}}}\n)\nconst (\n\tA = iota\n\tB\n)\nfunc main() {\n\tfor i := 0; i < 10; i++ {\n\t}\n\tfor k, v := range m {\n\t\tgo f(k, v)\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t}\nL:\n\tfor range ch {\n\t\tcontinue L\n\t}\n\ta, b = b, a\n\tp.q[1:2]++\n\tx := T{A: 1}.M(func(i int) bool { return i > 0 })\n\t_ = Map[int, string](x)\n}",
        "package a // c\n\n/* {\n */\nvar s = `raw {\n` + \"q\\n\" + string('{')\n",
    ],
    "json": ["{}", "[1, -2.5e3, \"a\\u00e9\", true, null]", ' {"a": {"b": []}} ', '"x"'],
    "python": ["", "def f(a, *, b=1):\n    return [x async for x in y]\n", "match x:\n    case {'a': 1}: pass\n"],
}
BROKEN = {
    "javascript": ["function f() {", "let x = ;", "a b c", "class A { m( { }", "x = `a${b`", "if (a", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z", "def f(x):\n    return x", "return 1", "x = 'a\nb'", "1 = 2", "const x;", '{ "a": 1, "b": 2 }', "package a;"],
    "java": ["class A {", "class A { void m() { x } }", "class A { int x = ; }", "public void m() { }", "using System;", "class A { void m() { a + b; } }", "class A { } }", "=======\nclass A { }", "class A { String s = \"x; }", "class A { void m() { return int; } }"],
    "csharp": ["class A {", "class A { void M() { x; } }", "class A { int X { foo; } }", "import java.util.List;", "class A { void M() { var x = ; } }", "#if A\nclass B { }", "class A { string s = $\"{x\"; }", "package a\n", "class A {\n<<<<<<< HEAD\n}", "class A { void M() { return int; } }"],
    "go": ["func main() { }", "package a\nfunc f() {", "package a\nvar x int = \n", "package a\nx := 1", "package a\nfunc f() { a + b }", "package a\nimport \"x\nfunc f() {}", "package a\ntype T struct {\n\ta int,\n}", "package a\n=======\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}"],
    "json": ["", "{", "{'a': 1}", "[1, 2,]", '{"a": NaN}', "{} {}", "// c\n{}"],
    "python": ["def f(:", "x = (1,", "print 'a'", "if a:\nb"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_grammars(lang):
    for text in VALID[lang]:
        assert why_invalid(lang, text) is None, (text, why_invalid(lang, text))
    for text in BROKEN[lang]:
        assert why_invalid(lang, text) is not None, text


PIECES = ["{", "}", "(", ")", "x = 1;", "// a {", "/* b", "*/", '"s {"', "`r", "`", "'c'", '"""', "'''", "# {", "\\", " "]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(sx.LANGUAGES)), st.lists(st.lists(st.sampled_from(PIECES), max_size=4).map(" ".join), max_size=12), st.integers(1, 5), st.integers(1, 5))
def test_maps_compose(lang, lines, a, b):
    whole = lx.scan(lang, "".join(x + "\n" for x in lines))

    def cut(width):
        parts = [lx.state_map(lang, "".join(x + "\n" for x in lines[i : i + width])) for i in range(0, max(len(lines), 1), width)]
        left = parts[0]
        for p in parts[1:]:
            left = lx.compose(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = lx.compose(p, right)
        assert left == right
        return left[lx.CODE]

    one, two = cut(a), cut(b)
    assert (one.exit, one.closes, one.opens) == (two.exit, two.closes, two.opens) == (whole.exit, whole.closes, whole.opens)
    assert lx.balanced(one) == lx.balanced(two) == lx.balanced(whole)


def chunks_of(file_id, text, start=0):
    lines = text.split("\n")
    out = []
    for k, at in enumerate(range(0, max(len(lines) - 10, 1), 70)):
        part = lines[at : at + 80]
        out.append((start + k, file_id, k, at + 1, None, "\n".join(part)))
    return out


def test_files(spark, monkeypatch):
    rng = random.Random(1)
    good = "class A {\n" + "\n".join(f"    int f{i}() {{ return {i}; }}" for i in range(400)) + "\n}"
    texts = {1: ("java", good), 2: ("JAVA", good[:-1]), 3: ("python", "x = 1\n" * 100), 4: ("go", VALID["go"][0]), 5: ("json", "{}"), 6: ("markdown", "{{{"), 7: (None, "{"), 8: ("csharp", good.replace("int f7()", "int f7(")), 9: ("Python", "def f(:")}
    rows = [c for f, (_, t) in texts.items() for c in chunks_of(f, t, 100 * f)]
    rows += rows[:6] + [(5000, None, 0, 1, 1, "}"), (5001, 10, 0, 1, 1, None), (5002, 77, 0, 1, 1, "{")]
    rng.shuffle(rows)
    files = spark.createDataFrame([(f, f"r{f % 2}/a/f{f}", l) for f, (l, _) in texts.items()] + [(1, "r1/a/f1", None), (10, "r0/x", "json"), (11, "r0/y", "java"), (None, "q", "go")], "file_id bigint, path string, lang string").selectExpr("*", "'c' as block")
    chunks = spark.createDataFrame(rows, "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string").selectExpr("*", "'java' as lang", "1 as why")
    assert sorted(r.file_id for r in sx.invalid_files(files, chunks).collect()) == [2, 8, 9, 10]
    verdicts = {r.file_id: r.valid for r in sx.syntax_verdicts(files, chunks).collect()}
    assert verdicts == {1: True, 2: False, 3: True, 4: True, 5: True, 8: False, 9: False, 10: False}
    symbols = spark.createDataFrame([(1, "class"), (2, None)], "file_id bigint, kind string")
    rates = {(r.repo, r.lang): (r.files, r.invalid, r.invalid_without_symbols) for r in sx.invalid_rates(files, chunks, symbols).collect()}
    assert rates[("r0", "java")] == (1, 1, 1) and rates[("r1", "java")] == (1, 0, 0)
    assert sx.invalid_files(files, chunks.limit(0)).count() == 0
    assert sx.invalid_files(files.limit(0), chunks).count() == 0


def test_a_file_of_many_blocks(spark):
    body = "\n".join("int f() { /* {\n */ return 1; }" for _ in range(200))
    texts = {1: "class A {\n" + body + "\n}", 2: "class A {\n" + body, 3: "class A {\n" + body + "\n}\n}", 4: "class A {\n}", 5: "class A {\n" + "\n" * 120 + "}"}
    rows = [c for f, t in texts.items() for c in chunks_of(f, t, 1000 * f)]
    rows.append((9000, 6, 0, 1, None, texts[1]))  # a file of one chunk
    files = spark.createDataFrame([(f, "r/f", "java") for f in [*texts, 6]], "file_id bigint, path string, lang string")
    chunks = spark.createDataFrame(rows, "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string")
    got = {r.file_id: r.valid for r in sx.syntax_verdicts(files, chunks, block_lines=50).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_verdict_does_not_depend_on_size(spark):
    rows = ",\n".join(f'{{"k{i}": [{i}]}}' for i in range(300))
    py = "\n".join(f"def f{i}():\n    return {i}" for i in range(150))
    js = "\n".join(f"function f{i}() {{ return {i}; }}" for i in range(300))
    texts = {
        1: ("json", f"[{rows}]"), 2: ("json", f"[{rows}]".replace('},\n{"k250"', '}\n{"k250"')), 3: ("python", py), 4: ("python", py.replace("    return 140", "  x = 1\n    return 140")),
        5: ("javascript", js + "\nvar r = 1 / 2; // (\nvar q = /[)]/;"), 6: ("javascript", js.replace("return 290;", "return return;")), 7: ("java", "class A {\n" + "int a;\n" * 300 + "}"), 8: ("java", "class A {\n" + "int a;\n" * 300 + "int int;\n}"),
    }
    files = spark.createDataFrame([(f, "r/f", lang) for f, (lang, _) in texts.items()] + [(9, "r/g", "json")], "file_id bigint, path string, lang string")
    chunk_rows = [c for f, (_, t) in texts.items() for c in chunks_of(f, t, 1000 * f)] + [(9000, 9, 0, 120, None, "[1]"), (9001, 9, 0, 10, None, "")]
    chunks = spark.createDataFrame(chunk_rows, "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string")
    small, whole = ({r.file_id: r.valid for r in sx.syntax_verdicts(files, chunks, block_lines=n).collect()} for n in (50, 10_000))
    assert small == whole == {f: f % 2 == 1 for f in range(1, 10)}


def test_deep_nesting():
    deep = 30_000
    assert why_invalid("json", "[" * deep + "]" * deep) is None
    assert why_invalid("json", '{"a": ' * deep + "1" + "}" * deep) is None
    for text in ("[" * deep + "1 2" + "]" * deep, "[" * deep + "1," + "]" * deep, "[" * deep + "]" * (deep - 1) + "}", "[" * deep + "NaN" + "]" * deep, "[" * deep + "]" * deep + "]"):
        assert why_invalid("json", text) is not None
    assert why_invalid("java", "class A { int a = " + "(" * deep + "1" + ")" * deep + "; }") is None
    assert why_invalid("java", "class A { int a = " + "(" * deep + "1 2" + ")" * deep + "; }") is not None


MISLEADING = {
    "python": ["x = f\"{d[\"(\"]}\"\n", "x = f'{d['{']}' + f'{a}'\n", 'y = f"""{a["("]}"""\n', "z = rf'{p['[']}'\n"],
    "javascript": ["var a = b / c; // (\nvar r = /[(\"]/;\n", "var t = `${f(\"`(\")}`;\n", "x = a / 2 / b('/');\n"],
    "csharp": ["#if A\nclass A {\n#else\nclass B {\n#endif\n}\n", "var s = $\"{d[\"(\"]}\";\n", 'var r = """" a """ ( """";\n', "#region it's (\n#endregion\n"],
    "java": ['String s = "\\\\u0022(";\n'.replace("\\\\", "\\")],
}


@pytest.mark.parametrize("lang", sorted(MISLEADING))
def test_maps_know_what_misleads_them(lang):
    for text in MISLEADING[lang]:
        assert not lx.surely_invalid(lx.scan(lang, text)), text
        assert not lx.surely_invalid(lx.compose(lx.state_map(lang, "\n", True), lx.state_map(lang, text))[lx.CODE])


def test_maps_decide_in_every_language():
    for lang in sx.LANGUAGES:
        for text in ("[" * 30_000, "]", "[(]"):
            assert sx.judge(lang, [text]) == sx.UNBALANCED
        for good in VALID[lang]:
            assert not lx.surely_invalid(lx.scan(lang, good)), (lang, good)
