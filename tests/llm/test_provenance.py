from skerry.llm import provenance as pv


def test_line_kinds():
    assert pv.is_minified_line("!function(a){a.b=a.b||[]}(c);if(d){e(f,!1)}else{f=1};" * 6)
    assert not pv.is_minified_line("// " + "a;b{}" * 100)
    assert not pv.is_minified_line('x = "' + "some words of a long text " * 20 + '"')
    assert pv.is_data_line("12, 34, 56, 78,") and pv.is_data_line("window.x = '" + "0a1b2c3d" * 20) is False
    assert pv.is_data_line("'0a1b2c3d4e5f60718293a4b5',") and pv.is_data_line("31246,stack raw,40174")
    assert not pv.is_data_line("call(1, 2, 3)") and not pv.is_data_line("return [a, b, c]")


def test_banners():
    said = lambda lines: pv.banner(pv.leading_comment(lines)[0])
    assert said(["// Licensed under X", "", "// Code generated by t from a. DO NOT EDIT.", "package a"]) == "generated"
    assert said(["/*! lib 1.2.3 -- bundled copy, local patches: none */", "x"]) == "vendored"
    assert said(["import a", "// Code generated by t. DO NOT EDIT."]) is None
    assert said(["# auto-generated names are checked below"]) is None
    assert said(["BANNER = '<auto-generated/>'"]) is None


def _chunks(rows):
    return [(i, f, 0, s, None, t) for i, (f, s, t) in enumerate(rows)]


CHUNK = "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string"
FILE = "file_id bigint, path string, checksum string, indexed_at timestamp, generated boolean"


def test_origins(spark):
    code = "\n".join(f"x{i} = f(y, {i})" for i in range(60))
    files = {
        1: "a/src/x.py", 2: "a/vendor/p/x.py", 3: "a/src/vendors/x.py", 4: "a/gen/x.go", 5: "a/src/x_pb2.py", 6: "a/src/min_max.js", 7: "b/src/m.js", 8: "b/src/d.py", 9: "b/libs/q-1.2/x.cs",
        10: "b/src/long.js", 11: "a/src/FooGrpc.java", 12: "b/src/tooled.cs", 13: None, 14: "a/src/empty.min.js", 15: "b/lib/pk/x.js", 16: "b/lib/pk/y.js", 17: "c/deep/er/pk/x.js", 18: "c/deep/er/pk/y.js",
    }
    text = {i: code for i in files if i != 14}
    text[7] = "!function(a){a.b=a.b||[]}(c);if(d){e(f,!1)}else{f=1};" * 30
    text[8] = "T = [\n" + "    123, 456, 789, 1011,\n" * 80 + "]"
    text[10] = "// " + "words of a comment " * 300 + "\n" + code
    text[12] = "// <auto-generated> by t </auto-generated>\n" + code
    rows = _chunks([(i, 1, t) for i, t in text.items()])
    sums = {15: "aa", 16: "bb", 17: "AA", 18: "bb"}
    df = spark.createDataFrame([(i, p, sums.get(i, f"s{i}"), None, True) for i, p in files.items()] + [(1, "a/src/x.py", "s1", None, False), (None, "a/vendor/z", "q", None, True)], FILE).selectExpr("*", "1 as minified", "'x' as banner")
    chunks = spark.createDataFrame(rows + rows[:5], CHUNK).selectExpr("*", "'x' as rest")
    got = {r.file_id: r.origin for r in pv.file_origins(df, chunks).collect()}
    want = dict.fromkeys(files, None) | {2: "vendored", 4: "generated", 5: "generated", 7: "minified", 8: "data", 9: "vendored", 11: "generated", 12: "generated", 14: "minified", 15: "vendored", 16: "vendored", 17: "vendored", 18: "vendored"}
    assert got == want
    assert {r.dir for r in pv.shared_subtrees(df).collect()} == {"b/lib", "b/lib/pk", "c/deep/er", "c/deep/er/pk"}
    assert pv.not_hand_written(df.limit(0), chunks).count() == 0
    assert pv.not_hand_written(df, chunks.limit(0)).count() == 10


def test_overlaps_count_once(spark):
    lines = [f"{i}, {i}, {i}," for i in range(1, 201)]
    rows = [(1, 1, "\n".join(lines[:80])), (1, 71, "\n".join(lines[70:150])), (1, 141, "\n".join(lines[140:]))]
    got = pv.file_layouts(spark.createDataFrame(_chunks(rows + rows[1:2]), CHUNK)).collect()[0]
    assert got.chars == got.data == sum(map(len, lines))


def test_banner_after_a_long_licence(spark):
    licence = [f" * words {i} of a licence" for i in range(300)]
    note = "// Code generated by t from a. DO NOT EDIT."
    texts = {
        1: ["/*", *licence, " */", note, "x = 1"], 2: ["/*", *licence, " */", "x = 1", note], 3: [*(f"// {x}" for x in licence), note, "x"], 4: ["x", *(f"// {x}" for x in licence), note],
        5: ["/*", *licence[:75], " */", note], 6: [*(f"// {x}" for x in licence[:69]), note, *["y = 2"] * 90],
        7: [*(f"// {x}" for x in licence[:70]), *["y = 2"] * 70, note, *["y = 2"] * 90],
    }
    windows = [(f, at + 1, "\n".join(t[at : at + 80])) for f, t in texts.items() for at in range(0, max(len(t) - 10, 1), 70)]
    whole = [(f + 10, 1, "\n".join(t)) for f, t in texts.items()]
    got = {r.file_id: r.banner for r in pv.file_layouts(spark.createDataFrame(_chunks(windows + whole), CHUNK)).collect()}
    want = {1: "generated", 2: None, 3: "generated", 4: None, 5: "generated", 6: "generated", 7: None}
    assert got == want | {f + 10: v for f, v in want.items()}
