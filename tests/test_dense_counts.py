import random
from collections import Counter

from pyspark.sql import functions as F

from skerry.operators import dense_counts as dc


def test_counts_with_hot_keys(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["", "é", None, *map(str, range(300))]), rng.choice([None, 1, 5, 2**40])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, w bigint").repartition(5).withColumn("name", F.lit("clash")).withColumn("block", F.lit(0))
    got = {r.key: (r.n, r.s) for r in dc.dense_counts([(df, F.col("k"), None, "n"), (df, F.col("k"), F.col("w"), "s")], key="key").collect()}
    n, s = Counter(), Counter()
    for k, w in rows:
        if k is not None:
            n[k] += 1
            s[k] += w or 0
    assert got == {k: (n[k], s[k]) for k in n}


def test_one_side_and_empty(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("z", 3)], "k string, w int")
    got = {tuple(r) for r in dc.dense_counts([(a, F.col("k"), None, "n"), (b, F.col("k"), F.col("w"), "s")]).collect()}
    assert got == {("x", 2, 0), ("y", 1, 0), ("z", 0, 3)}
    assert dc.dense_counts([(a.limit(0), F.col("k"), None, "n")]).count() == 0


def test_split_flushes(spark):
    acc, dc.SLOTS_PER_SPLIT = dc.SLOTS_PER_SPLIT, 10
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"name": [str(i % 25) for i in range(100)], "weight": pa.array([1] * 100, pa.int64()), "block": pa.array([0] * 100, pa.int32()), "measure": pa.array([0] * 100, pa.int32())})
        out = list(dc._encode_split(iter([batch.slice(0, 50), batch.slice(50)])))
        total = Counter()
        for b in out:
            for names, sums in zip(b.column("names").to_pylist(), b.column("sums").to_pylist()):
                total.update(dict(zip(names, sums)))
        assert len(out) == 2 and total == Counter({str(i): 4 for i in range(25)})
    finally:
        dc.SLOTS_PER_SPLIT = acc


def test_mismatches(spark):
    refs = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 1), (1, "a", 2, None), (1, None, 1, 1), (2, "b", 1, 1)], "file_id bigint, symbol_name string, line int, column_number int")
    cols = "file_id bigint, lang string, raw_symbol_name string, symbol_name string, symbol_segment_count int, allow_leaf_fallback int, reference_count bigint, reference_score double"
    stored = spark.createDataFrame([(1, "l", "a", "a", 1, 0, 2, 1.0), (1, "l", "a", "a", 1, 0, 2, 1.0), (2, "l", "b", "b", 1, 0, None, 1.0), (3, "l", "c", "c", 1, 0, 0, 0.0), (3, "l", "d", "d", 1, 0, 4, 0.0)], cols)
    assert sorted(r.symbol_name for r in dc.count_mismatches(refs, stored).collect()) == ["b", "d"]
