import re

from pyspark.sql import functions as F

from skerry.functions import names
from skerry.operators import lines


def _chunks(spark, texts):
    rows = []
    for f, t in texts.items():
        ls = t.split("\n")
        for k, at in enumerate(range(0, max(len(ls) - 10, 1), 70)):
            rows.append((100 * f + k, f, k, at + 1, None, "\n".join(ls[at : at + 80])))
    rows += rows[:2] + [(9999, 9, 0, 1, 1, None)]
    return spark.createDataFrame(rows, "chunk_id int, file_id int, chunk_index int, start_line int, end_line int, content string")


def test_lines_once(spark):
    texts = {1: "\n".join(f"l{i}" for i in range(300)), 2: "one", 3: ""}
    got: dict = {}
    for r in lines.file_lines(_chunks(spark, texts)).collect():
        assert got.setdefault((r.file_id, r.line), r.text) == r.text
    assert got == {(f, i): x for f, t in texts.items() for i, x in enumerate(t.split("\n"), 1)}
    assert lines.file_lines(_chunks(spark, texts)).count() == len(got)


def test_positions(spark):
    df = spark.createDataFrame([("aaaa",), ("banana",), ("",), ("a.b.a.b",), ("日本日本",)], "t string")
    for q in ("aa", "ana", "a.b", "本", "na"):
        got = {r.t: r.p for r in df.where(F.contains("t", F.lit(q))).select("t", lines.positions(F.col("t"), q).alias("p")).collect()}
        want = {t: [m.start() + 1 for m in re.finditer(f"(?={re.escape(q)})", t)] for t in ("aaaa", "banana", "", "a.b.a.b", "日本日本") if q in t}
        assert got == want, q


def test_windows_over_lines(spark):
    text = "a {\n  x\n}\nb { y }\nc {\n\n\n\n\n\n\n\n\n}\n" + "d {\nz }"
    got = [(r.line, r.column, r.end_line) for r in lines.find_windows(lines.file_lines(_chunks(spark, {1: text})), r"\{[^{}]*\}", window_lines=4).orderBy("line").collect()]
    assert got == [(1, 3, 3), (4, 3, 4), (15, 3, 16)]


def test_names(spark):
    df = spark.createDataFrame([("Straße",), ("ＡＢＣ",), ("Plain_Name",), (None,), ("",)], "n string")
    assert [r.f for r in df.select(names.fold_name(F.col("n")).alias("f")).collect()] == ["strasse", "abc", "plain_name", None, ""]
    df = spark.createDataFrame([("[dbo].[My Table]",), ('"a"."b"',), ("x.y.z",), ("`q`",)], "n string")
    assert [(r.a, r.b, r.c) for r in df.select(names.normalized_name(F.col("n")).alias("a"), names.leaf_name(F.col("n")).alias("b"), names.segment_count(F.col("n")).alias("c")).collect()] == [("dbo.My Table", "My Table", 2), ("a.b", "b", 2), ("x.y.z", "z", 3), ("q", "q", 1)]
    df = spark.createDataFrame([("f(a, g(b, c), [d, e])",), ("f()",), ("f",), ("f('a, b', 2)",)], "t string")
    assert [r.n for r in df.select(names.argument_count(F.col("t")).alias("n")).collect()] == [3, 0, None, 2]


def test_every_file_is_read(spark):
    texts = {f: f"first {f}\nlast" for f in (1, 200, 201, 5000)} | {7: "\n".join(map(str, range(300)))}
    got = {r.file_id: r.text for r in lines.file_texts(_chunks(spark, texts), 200).collect()}
    assert got == texts | {7: "\n".join(map(str, range(200)))}


def test_read_query_keeps_no_files_back(spark, tmp_path):
    from skerry.plans import registry

    texts = {1: "a", 201: "b\nc", 5000: "d"}
    _chunks(spark, texts).selectExpr("cast(chunk_id as bigint) chunk_id", "cast(file_id as bigint) file_id", "chunk_index", "start_line", "end_line", "content").write.parquet(str(tmp_path / "chunks.parquet"))
    assert {r.file_id: r.text for r in registry.QUERIES["L09_file_read"](spark, str(tmp_path)).collect()} == texts


def test_long_tokens_and_budget(spark):
    import pytest

    from skerry.operators import search

    chunks = _chunks(spark, {1: "x" * 520 + "needle" + "y" * 520, 2: "needle", 3: "a needle b\nneedle", 4: "z" * 600})
    assert {r.file_id for r in search.long_token_hits(chunks, "NEEDLE").collect()} == {1}
    hits = search.line_hits(chunks, "needle")
    assert search.within_budget(hits, 4).count() == 4
    with pytest.raises(search.GuardBudgetError):
        search.within_budget(hits, 3)


def test_stored_index_against_the_scan(spark, tmp_path):
    from skerry.operators import search
    from skerry.operators.index import SearchIndex, texts_of

    texts = {1: "Alpha beta\nbeta gamma", 2: "alpha " * 50, 3: "be tabeta", 4: "", 5: "ALPHA\nbet", 6: "日本語 beta", 7: "\n".join(f"beta {k}" for k in range(200))}
    chunks = _chunks(spark, texts)
    index = SearchIndex(spark, f"file://{tmp_path}/ix").write(chunks)
    for query, prefix in (("beta", False), ("alpha beta", False), ("bet", True), ("al be", True), ("none", False), ("", False)):
        rows = lambda df: {(r.chunk_id, r.file_id, round(r.bm25, 5)) for r in df.collect()}
        assert rows(index.search(query, prefix)) == rows(search.search_all(chunks, query, prefix)), query
    for query in ("beta", "a b", "ETA", "日本", "語 be", "ta", "zzz", "beta\nbeta"):
        rows = lambda df: sorted((r.file_id, r.line, r.text) for r in df.select("file_id", "line", "text").collect())
        assert rows(index.literal_lines(chunks, query)) == rows(lines.literal_lines(chunks, query)), query
    assert index.terms("be").count() == 3
    files = spark.createDataFrame([(f, f"d/{f}.py") for f in texts], "file_id int, path string")
    symbols = spark.createDataFrame([(1, "beta", 2, 2), (7, "BETA gamma", 100, 100)], "file_id int, name string, start_line int, line int")
    for query in ("beta", "beta gamma", "alpha beta"):
        rows = lambda df: [tuple(r) for r in df.orderBy("rank").collect()]
        assert rows(index.ranked(query, chunks, files, symbols, 5)) == rows(search.search_ranked(chunks, files, symbols, query, 5)), query
    assert {r.content for r in texts_of(index.search("gamma"), chunks).collect()} == {texts[1]}


def test_no_content_is_exchanged(spark, tmp_path, monkeypatch):
    import io
    import re as _re
    from contextlib import redirect_stdout

    from skerry.operators import search

    monkeypatch.setattr("skerry.runtime.SPLITS_PER_CORE", 0)  # as for a scan of many splits
    root = f"file://{tmp_path}/c"
    _chunks(spark, {1: "Alpha beta"}).write.parquet(root)
    chunks = spark.read.parquet(root)
    for df in (search.search_all(chunks, "alpha beta"), search.exact_substring(chunks, "a"), search.phrase_first(chunks, "a b"), lines.literal_lines(chunks, "beta"), search.named_queries(chunks, {"a": "b"})):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        for part in _re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", out.getvalue()):
            assert "content#" not in part


def test_excerpts_hold_ranges_and_not_their_lines(spark, monkeypatch):
    from skerry.runtime import cut_lineage, measured_side

    seen = []
    texts = {1: "\n".join(f"l{i}" for i in range(1, 301)), 2: "a\nb"}
    asked = {(1, 2, 2_000_000_000): (1, 300), (1, 60, 160): (59, 161), (1, 80, 80): (79, 81), (2, 1, 1): (1, 2), (1, 300, 310): (299, 300), (1, 40, 20): None, (2, 9, 12): None, (3, 1, 2): None}
    ranges = spark.createDataFrame([k for k in asked for _ in range(2)], "file_id int, start_line int, end_line int")
    want = {k: "\n".join(texts[k[0]].split("\n")[v[0] - 1 : v[1]]) for k, v in asked.items() if v}
    for side in (measured_side, cut_lineage):  # few ranges, and more than are broadcast
        monkeypatch.setattr(lines, "measured_side", lambda df, side=side: seen.append(df) or side(df))
        got = lines.excerpts(_chunks(spark, texts), ranges, 1, 1).collect()
        assert {(r.file_id, r.start_line, r.end_line): r.excerpt for r in got} == want and len(got) == len(want)
    assert all(kind in ("int", "bigint") for df in seen for _, kind in df.dtypes)


def test_guards_on_more_candidates_than_the_budget(spark, tmp_path):
    from skerry.operators import search
    from skerry.plans import registry

    few = _chunks(spark, {1: "if a\nneedle\nb\nneedle", 2: "needle if\nc", 3: "needle\nif\nneedle", 4: "if"})
    for budget in (0, 4, 5, 200):
        for require, want in ((True, {(1, 2), (1, 4), (3, 3)}), (False, {(2, 1), (3, 1)})):
            got = search.guarded_whole(search.line_hits(few, "needle"), few, "if", 3, budget, "before", require).collect()
            assert {(r.file_id, r.line) for r in got} == want and len(got) == len(want), budget
    text = "\n".join(["if"] + ["ledger"] * 100_001)
    many = spark.createDataFrame([(1, 1, 0, 1, 100_002, text), (1, 1, 0, 1, 100_002, text), (2, 2, 0, 1, 2, "ledger\nif")], "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string")
    many.write.parquet(str(tmp_path / "chunks.parquet"))
    assert sorted((r.file_id, r.line) for r in registry.QUERIES["X14_budget"](spark, str(tmp_path)).collect()) == [(1, n) for n in range(2, 10)]
