import random

from pyspark.sql import functions as F

from skerry.operators import copy_diff as cd


def brute(left, right):
    out = set()
    keys = {r[0] for r in left} | {r[0] for r in right}
    for k in keys:
        a = {r[1:] for r in left if r[0] == k}
        b = {r[1:] for r in right if r[0] == k}
        name = None if k is None else str(k)
        if not b:
            out.add((name, "only_left"))
        elif not a:
            out.add((name, "only_right"))
        else:
            (x,), (y,) = a, b
            out |= {(name, c) for c, p, q in zip("xy", x, y) if p != q}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = {k: (k, rng.choice([None, "", "a", "é"]), rng.choice([None, 0, 1])) for k in [None, *range(400)]}
    left = [rows[k] for k in rows if rng.random() < 0.9]
    right = [(k, x, y) if rng.random() < 0.8 else (k, rng.choice([None, "", "b"]), rng.choice([None, 1, 7])) for k, x, y in rows.values() if rng.random() < 0.9]
    schema = "k bigint, x string, y int"
    a = spark.createDataFrame(left + left[:100] + [left[5]] * 500, schema).withColumn("side", F.lit("clash")).withColumn("key", F.lit(1))
    b = spark.createDataFrame(right + right[50:150], schema).repartition(4)
    got = [tuple(r) for r in cd.diff_copies(a, b, "k", ["x", "y"], "t").collect()]
    assert len(got) == len(set(got))
    assert {(k, d) for area, k, d in got if area == "t"} == brute(left, right)


def test_hot_key_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(cd, "_HELD_ROWS", 50)
    a = spark.range(2000).select(F.lit(7).cast("bigint").alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([(1, 1), (9, 1)], "k bigint, x bigint"))
    b = a.where("x < 1999 or k <> 7").unionByName(spark.createDataFrame([(10, 1)], "k bigint, x bigint")).where("k <> 1")
    got = {(r.row_key, r.diff) for r in cd.diff_copies(a, b, "k", ["x"], "t").collect()}
    assert got == {("7", "x"), ("1", "only_left"), ("10", "only_right")}


def test_hot_key_is_spread_over_tasks(spark):
    n = 6000
    hot = spark.range(0, n, 1, 8).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("x"), (F.col("id") % 2).alias("y"), F.lit("c").alias("z"))
    few = spark.createDataFrame([(k, k, 0, "c") for k in range(200)], "k bigint, x bigint, y bigint, z string")
    other = spark.createDataFrame([(k, k, 0, "c" if k % 50 else "d") for k in range(200)], "k bigint, x bigint, y bigint, z string")
    left, right = hot.unionByName(few), hot.where(f"x <> {n - 1}").unionByName(other)
    sizes = [r["count"] for r in cd._ranged(left, right, "k", ["x", "y", "z"], "t").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3
    got = {(r.row_key, r.diff) for r in cd.diff_copies(left, right, "k", ["x", "y", "z"], "t").collect()}
    assert got == {(None, "x"), (None, "y")} | {(str(k), "z") for k in range(0, 200, 50)}


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "p")], "k bigint, x string")
    assert [tuple(r) for r in cd.diff_copies(a, a.limit(0), "k", ["x"], "t").collect()] == [("t", "1", "only_left")]
    assert cd.diff_copies(a.limit(0), a.limit(0), "k", ["x"], "t").count() == 0
    assert cd.diff_copies(a, a, "k", ["x"], "t").count() == 0


def test_several_rows_of_a_key(spark, monkeypatch):
    rng = random.Random(4)
    pick = lambda k: {(k, rng.choice([None, "a", "b", "c"][: 1 + k % 4 if k else 4]), rng.choice([None, 1.0, float("nan")])) for _ in range(rng.randrange(1, 5))}
    keys = [None, *range(60)]
    left = [(1000, "a", 0.0), (1000, "c", 0.0)] + [r for k in keys for r in pick(k)]
    right = [(1000, "a", 0.0), (1000, "b", 0.0), (1000, "c", 0.0)] + [r for k in keys for r in pick(k)]
    same = lambda p, q: p == q or (p != p and q != q)
    want = {(None if k is None else str(k), c) for k in [*keys, 1000] for i, c in ((1, "x"), (2, "y")) if any(not same(p[i], q[i]) for p in left if p[0] == k for q in right if q[0] == k)}
    assert ("1000", "x") in want and ("1000", "y") not in want
    schema = "k bigint, x string, y double"
    for held in (20_000, 1):
        monkeypatch.setattr(cd, "_HELD_ROWS", held)
        got = [(r.row_key, r.diff) for r in cd.diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", ["x", "y"], "t").collect()]
        assert len(got) == len(set(got)) and set(got) == want
