import math

import numpy as np

from skerry.llm import mixing as mx


def test_distribution():
    for mean in (0.0, 0.3, 2.5, 20.0):
        d = mx.distribution(mean, 6)
        want = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(6)])
        assert np.allclose(d, want)
    assert (mx.distribution(math.inf, 3) == 0).all()


def test_mean_meets_the_target():
    rng = np.random.default_rng(1)
    s = mx._Source("a", 1.0, 3, rng.integers(0, 50, mx.CELLS).astype(float))
    for rate in (0.01, 0.5, 1.0, 2.0, 2.9):
        assert abs(s.drawn(s.mean_for(rate * s.tokens)) - rate * s.tokens) < 0.002 * s.tokens
    assert math.isinf(s.mean_for(3 * s.tokens))


def _tables(spark):
    docs = [(i, "word " * (1 + i % 30), ["big", "mid", "small", None, "other", ""][0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i % 10 == 8 else 3 + i % 3]) for i in range(1500)]
    docs += [(9001, None, "big"), (9002, "", "mid")]
    mix = spark.createDataFrame([("big", 1.0, 1), ("mid", 2.0, 3), ("small", 1.0, 4), ("small", 1.0, 4), ("absent", 5.0, 2), (None, 1.0, 1), ("null_weight", None, 1)], "source string, weight double, max_repeats int")
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "0.5 as u", "7 as repeats"), mix


def test_shares_and_caps(spark):
    docs, mix = _tables(spark)
    rows = {r.source: r for r in mx.mix_shares(docs, mix).collect()}
    assert set(rows) == {"big", "mid", "small", "absent"}
    for s, want in (("big", 0.25), ("mid", 0.5), ("small", 0.25)):
        assert abs(rows[s].share - want) < 0.02 and rows[s].most_repeats <= rows[s].max_repeats
    assert rows["absent"].share == 0 and rows["absent"].weight_share == 0
    mixed = mx.mix_documents(docs, mix).collect()
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    per_doc: dict = {}
    for r in mixed:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + 1
    caps = {"big": 1, "mid": 3, "small": 4}
    assert all(per_doc[r.doc_id] <= caps[r.source] for r in mixed)
    drawn = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in caps}
    assert abs(drawn["mid"] / sum(drawn.values()) - 0.5) < 0.05
    assert {(r.doc_id, r.copy) for r in mx.mix_documents(docs.repartition(7), mix).collect()} == {(r.doc_id, r.copy) for r in mixed}


def test_given_size_saturates(spark):
    docs, mix = _tables(spark)
    rows = {r.source: r for r in mx.mix_shares(docs, mix, total_tokens=1e9).collect()}
    assert all(rows[s].drawn_tokens == rows[s].max_repeats * rows[s].available_tokens for s in ("big", "mid", "small"))


def test_empty(spark):
    docs, mix = _tables(spark)
    assert all(r.drawn_tokens == 0 for r in mx.mix_shares(docs.limit(0), mix).collect())
    assert mx.mix_documents(docs, mix.limit(0)).count() == 0


def test_no_cap_cuts_nothing(spark):
    d = mx.distribution(200.0, None)
    assert d[-1] == 1.0 and len(d) > 250 and (np.diff(d) >= 0).all()
    s = mx._Source("a", 1.0, None, np.full(mx.CELLS, 10.0))
    assert abs(s.drawn(s.mean_for(300 * s.tokens)) - 300 * s.tokens) < 0.01 * s.tokens
    docs = spark.createDataFrame([(i, "word " * 3, "free" if i % 50 == 0 else "big") for i in range(2000)], "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("free", 9.0, None), ("big", 1.0, 2)], "source string, weight double, max_repeats int")
    rows = {r.source: r for r in mx.mix_shares(docs, mix).collect()}
    assert rows["free"].max_repeats is None and abs(rows["free"].share - 0.9) < 0.03 and rows["free"].most_repeats > 300
    assert rows["big"].drawn_tokens == 2 * rows["big"].available_tokens
    rows = {r.source: r for r in mx.mix_shares(docs, mix.withColumn("max_repeats", mx.F.lit(None).cast("int"))).collect()}
    assert abs(sum(r.drawn_tokens for r in rows.values()) - 2000 * 4) < 600


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    docs, mix = _tables(spark)
    want = {(r.doc_id, r.copy) for r in mx.mix_documents(docs, mix).collect()}
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", 1)
    assert {(r.doc_id, r.copy) for r in mx.mix_documents(docs, mix).collect()} == want
