import pytest
from conftest import DATA, compare

from skerry import schema
from skerry.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    if name in registry.SQL:
        compare(df, duck, registry.SQL[name])
    else:
        assert df.columns
        df.collect()


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def save(root, name, ddl, df):
    """A table of a data folder; columns that ``df`` lacks are null."""
    kinds = [part.split() for part in ddl.split(", ")]
    df.selectExpr(*(f"cast({c if c in df.columns else 'null'} as {kind}) as {c}" for c, kind in kinds)).write.parquet(str(root / f"{name}.parquet"))


def test_positions_of_all_files(spark, tmp_path):
    refs = spark.createDataFrame([(i, f, "n", 29, 10, 6) for i, f in ((1, 5), (2, 100), (3, 101), (4, 9000))], "ref_id bigint, file_id bigint, symbol_name string, line int, column_number int, span_length int")
    save(tmp_path, "refs", schema.REFS, refs)
    assert {r.ref_id for r in registry.QUERIES["G20_positions"](spark, str(tmp_path)).collect()} == {1, 2, 3, 4}


def test_walks_go_to_the_default_depth(spark, tmp_path):
    calls = [(f"c{k}", f"c{k - 1}" if k > 1 else "get") for k in range(1, 8)] + [(f"d{k}", "get") for k in range(60)]
    refs = spark.createDataFrame([(i, 1, b, "call", i, 1, a, b, a) for i, (a, b) in enumerate(calls)], "ref_id int, file_id int, symbol_name string, reference_kind string, line int, column_number int, container_name string, symbol_name_folded string, container_name_folded string")
    save(tmp_path, "refs", schema.REFS, refs)
    save(tmp_path, "files", schema.FILES, spark.createDataFrame([(1, "a.py", "python")], "file_id int, path string, lang string"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    want = {(f"c{k}", k) for k in range(1, 6)} | {(f"d{k}", 1) for k in range(60)}
    assert {(r.caller, r.depth) for r in run("G14_impact")} == want
    assert {(r.caller, r.depth) for r in run("G15_paths")} == want
    assert {(r.depth, r.callers, r.ended) for r in run("G17_budget")} == {(1, 61, "depth")} | {(k, 1, "depth") for k in range(2, 6)}


def test_excerpts_code_and_arity_leave_nothing_out(spark, tmp_path):
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    text = ["ledger = 1", "x = ledger.get('x')", "# ledger", "s = 'ledger'", "t = 'ledger' + ledger", 'u = "#" + ledger', 'v = "# ledger"', 'w = """ledger'] + [f"l{k}" for k in range(9, 70)]
    chunks = spark.createDataFrame([(1, 1, 0, 1, "\n".join(text))], "chunk_id int, file_id int, chunk_index int, start_line int, content string")
    save(tmp_path, "chunks", schema.CHUNKS, chunks)
    save(tmp_path, "files", schema.FILES, spark.createDataFrame([(1, "a.py", "python")], "file_id int, path string, lang string"))
    signatures = {
        "class A": 0, "class A<T>": 1, "struct B<K, V> : C<K>": 2, "class A<T extends Map<K, V>, U>": 2, "class F<T extends (a, b) => void, U>": 2, "class D : E<X, Y>": 0, "public class P<[In(1, 2)] T>(List<int> a)": 1, "class N<>": 0,
    }
    symbols = [(i, 1, "class", s, 2, 60) for i, s in enumerate(signatures)] + [(100, 1, "class", None, 5, 6)]
    save(tmp_path, "symbols", schema.SYMBOLS, spark.createDataFrame(symbols, "symbol_id int, file_id int, kind string, signature string, start_line int, end_line int"))
    assert {r.line for r in run("X16_code_only")} == {1, 2, 5, 6}
    assert {r.symbol_id: r.arity for r in run("N08_type_arity")} == dict(enumerate(signatures.values()))
    assert {(r.start_line, r.end_line): r.excerpt for r in run("L08_excerpts")} == {(2, 60): "\n".join(text[:61]), (5, 6): "\n".join(text[3:7])}
