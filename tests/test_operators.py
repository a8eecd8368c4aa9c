import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import keyed as K
from tallyloom.operators import stats
from tallyloom.operators.ranges import running_sums
from tallyloom.plans import claims as CL
from tallyloom.plans.measures import dynamics


def test_running_sums_with_a_hot_group_ties_and_nulls(spark):
    rows = [("hot", i % 7, i, 1) for i in range(900)] + [("b", i, i, 2) for i in range(50)] + [(None, 1, 1, 5), ("b", None, 99, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, id int, v int")
    got = {(r.g, r.o, r.id): r.s for r in running_sums(df, ["g"], ["o", "id"], {"v": "s"}, partitions=6).collect()}
    assert len(got) == len(rows)
    want, sums = {}, Counter()
    for g, o, i, v in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2])):
        sums[g] += v or 0
        want[(g, o, i)] = sums[g]
    assert got == want


def test_running_sums_of_nothing(spark):
    assert running_sums(spark.createDataFrame([], "g string, o int, v int"), ["g"], ["o"], {"v": "s"}).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 9), st.integers(0, 20)), min_size=1))
def test_apportionment(total, cells):
    weights, caps = {k: w for k, (w, _) in cells.items()}, {k: c for k, (_, c) in cells.items()}
    q = K.capped_apportion(total, weights, caps)
    assert sum(q.values()) == min(total, sum(caps.values()))
    assert all(0 <= q[k] <= caps[k] for k in q)


def test_apportionment_cases():
    assert K.capped_apportion(10, {"a": 1, "b": 1}, {"a": 2, "b": 20}) == {"a": 2, "b": 8}
    # each round gives whole shares of what is left to all that have room
    assert K.capped_apportion(10, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 9, "c": 9}) == {"a": 1, "b": 6, "c": 3}
    assert K.capped_apportion(3, {"a": 0, "b": 0}, {"a": 2, "b": 2}) == {"a": 2, "b": 1}
    assert K.capped_apportion(99, {"a": 1, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        K.assert_unique(df, ["k"])
    with pytest.raises(ValueError, match="missing"):
        K.assert_covered(df, spark.createDataFrame([(1,)], "k int"), ["k"])
    once = K.keep_first(df, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, K.keep_first(once, ["k"], [F.col("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_incremental_apply_keeps_or_retries_failures(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, "ok"), (2, "error")], "k int, s string")
    fn = lambda df: df.withColumn("s", F.lit("new"))
    assert dict(map(tuple, K.incremental_apply(items, done, ["k"], fn).collect())) == {1: "ok", 2: "error", 3: "new"}
    assert dict(map(tuple, K.incremental_apply(items, done, ["k"], fn, F.col("s") == "ok").collect())) == {1: "ok", 2: "new", 3: "new"}


def claims(spark, rows):
    return spark.createDataFrame([("d", k, v, s) for k, (v, s) in enumerate(rows)], "doc_id string, claim_idx int, verdict string, stance string")


@pytest.mark.parametrize(
    "rows,label,rank",
    [
        ([("false", "asserted"), ("true", "quoted")], "false", 0),
        ([("false", "quoted")], "unverified", None),
        ([("false", "quoted"), ("true", "quoted")], "true", 4),
        ([("unverified", "asserted")], "unverified", None),
    ],
)
def test_six_class_label(spark, rows, label, rank):
    r = CL.rollup_six(claims(spark, rows)).first()
    assert (r.final_label, r.ordinal) == (label, rank)


@pytest.mark.parametrize("rows,label", [([("false", "quoted")], "unverified"), ([("false", "asserted"), ("true", "asserted")], "misinformation")])
def test_three_class_label(spark, rows, label):
    assert CL.rollup_three(claims(spark, rows)).first().final_label == label


def test_cascade(spark):
    a = spark.createDataFrame([("x", "unverified", None), ("y", "unverified", None), ("z", "false", 0), ("n", "no_checkworthy_claim", None)], "doc_id string, final_label string, ordinal int")
    b = spark.createDataFrame([("x", "true"), ("z", "true")], "doc_id string, final_label string")
    got = {r.doc_id: (r.final_label, r.ordinal, r.label_source) for r in CL.cascade(a, b).collect()}
    assert got == {
        "x": ("true", None, "model1_fallback"), "y": ("unverified", None, "model3_unverified_no_model1_row"),
        "z": ("false", 0, "model3"), "n": ("no_checkworthy_claim", None, "model3"),
    }


def test_volatility(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 0.0), ("b", 1, 0.0), ("b", 2, 1.0), ("c", 1, 5.0)], "d string, i int, x double")
    got = {r.d: (r.x_sd, r.x_volatility) for r in dynamics(df, ["x"], ["d"], "i").collect()}
    assert got["a"][1] == pytest.approx(math.sqrt(2), abs=1e-8)
    assert got["b"] == (pytest.approx(0.70710678, abs=1e-8), None)
    assert got["c"] == (None, None)
    shifted = {r.d: r.x_volatility for r in dynamics(df.withColumn("x", F.col("x") + 7), ["x"], ["d"], "i").collect()}
    assert shifted["a"] == pytest.approx(got["a"][1])


def test_agreement_golden(spark):
    rows = [(1, 1)] * 32 + [(0, 1)] * 22 + [(1, 0)] * 3 + [(0, 0)] * 29
    r = CL.agreement(spark.createDataFrame([(g, p, 1) for g, p in rows], "g int, p int, one int"), "g", "p", ["one"]).first()
    assert (round(r.agreement, 4), round(r.kappa, 4)) == (0.7093, 0.445)


def test_metrics_without_positives_are_zero(spark):
    r = CL.classification_metrics(spark.createDataFrame([("ok", "ok", "v"), ("ok", "abstain", "v")], "g string, p string, v string"), "g", "p", ["v"]).first()
    assert (r.n_scored, r.n_excluded, r.accuracy, r.precision, r.recall, r.f1, r.macro_f1) == (1, 1, 1.0, 0.0, 0.0, 0.0, 0.5)


def test_t_p_values():
    assert stats.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_p_value(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1.0)


def _toy(spark, n=400):
    rng = np.random.default_rng(4)
    x1, x2, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 12, n)
    y = 1 + 2 * x1 - 0.5 * x2 + 0.3 * g + rng.normal(size=n) * (1 + abs(x1))
    return x1, x2, g, y, spark.createDataFrame([(float(a), float(b), int(c), float(d)) for a, b, c, d in zip(x1, x2, g, y)], "x1 double, x2 double, g int, y double")


def test_least_squares_against_numpy(spark):
    x1, x2, _, y, df = _toy(spark)
    x = np.column_stack([np.ones_like(y), x1, x2])
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv) * len(y) / (len(y) - 3))
    fit = stats.ols(df.withColumn("copy", 2 * F.col("x1")), "y", ["x1", "x2", "copy"])
    assert fit["dropped"] == ["copy"]
    for k, name in enumerate(["(intercept)", "x1", "x2"]):
        assert fit["terms"][name]["estimate"] == pytest.approx(beta[k])
        assert fit["terms"][name]["se"] == pytest.approx(se[k])
    assert fit["r2"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))


def test_fixed_effects_equal_dummies(spark):
    x1, x2, g, y, df = _toy(spark)
    dummies = (g[:, None] == np.unique(g)[None, :]).astype(float)
    beta = np.linalg.lstsq(np.column_stack([x1, x2, dummies]), y, rcond=None)[0]
    lone = df.unionByName(spark.createDataFrame([(9.0, 9.0, 77, 9.0)], df.schema))
    fit = stats.ols(lone, "y", ["x1", "x2"], ["g"])
    assert fit["n"] == len(y)  # the level with one row is left out
    assert fit["terms"]["x1"]["estimate"] == pytest.approx(beta[0])
    assert fit["terms"]["x2"]["estimate"] == pytest.approx(beta[1])


def test_gini(spark):
    r = stats.concentration(spark.createDataFrame([("a", 0.0), ("b", -3.0), ("c", 10.0)], "k string, v double"), "k", "v").first()
    assert r.gini == pytest.approx(2 / 3, abs=1e-8)


def test_joins_with_contracts(spark):
    left = spark.createDataFrame([(" A/x ", 1), ("b/y", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a/X", 7, "r")], "k string, w int, v2 string")
    assert sorted((r.v, r.w) for r in K.join_normalised(left, right, "k").collect() if r.w) == [(1, 7)]
    assert K.join_normalised(left, right, "k").count() == 3
    twice = right.unionByName(spark.createDataFrame([("A/x", 8, "q")], right.schema))
    with pytest.raises(Exception, match="repeat"):
        K.join_normalised(left, twice, "k").collect()
    with pytest.raises(Exception, match="repeat"):  # also where right has no other column
        K.join_unique(left, spark.createDataFrame([("b/y",), ("b/y",)], "k string"), ["k"], "inner").select("v").collect()
    assert K.join_unique(left, right.limit(0), ["k"]).count() == 3


def test_suffixes_one_hot_order_and_schema(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "k int, x int, y int"), spark.createDataFrame([(1, 5, 6)], "k int, x int, z int")
    assert K.join_suffixed(a, b, ["k"]).first().asDict() == {"k": 1, "x_f": 2, "y": 3, "x_u": 5, "z": 6}
    rows = spark.createDataFrame([(1,), (3,), (None,)], "n int").select(*K.one_hot(F.col("n"), [1, 2], "n")).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 0)]
    df = spark.createDataFrame([("ok",), ("x",), (None,), ("misinfo",)], "p string").select(K.mapped_order(F.col("p"), ["misinfo", "ok"]).alias("o"))
    assert [r.o for r in df.collect()] == [1, 2, 2, 0]
    missing: list = []
    got = K.conform(spark.createDataFrame([("7", "x")], "n string, other string"), [("n", "int"), ("gone", "double")], missing)
    assert got.dtypes == [("n", "int")] and missing == ["gone"]


def test_flags_are_dropped_where_positions_do_not_fit(spark):
    scored = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)], "d string, i int")
    flags = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, True), ("b", 2, True)], "d string, i int, f boolean")
    got = {(r.d, r.i): r.f for r in K.aligned_flags(scored, flags, "d", "i", "f").collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("b", 0): False, ("b", 1): False, ("c", 0): False}


def test_sample_each_takes_the_lowest_hashes_of_a_hot_stratum(spark):
    import hashlib

    df = spark.createDataFrame([("hot" if k % 3 else "b", k) for k in range(600)], "s string, k int")
    got: dict = {}
    for r in K.sample_each(df, ["s"], ["k"], 20, 7).collect():
        got.setdefault(r.s, set()).add(r.k)
    h = lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest()
    assert got == {s: set(sorted((k for k in range(600) if (k % 3 != 0) == (s == "hot")), key=h)[:20]) for s in ("hot", "b")}
    quota = df.withColumn("q", F.when(F.col("s") == "hot", 3).otherwise(0))
    assert Counter(r.s for r in K.sample_each(quota, ["s"], ["k"], F.col("q"), 7).collect()) == {"hot": 3}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30))
def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: (r.m, r.q) for r in stats.quantiles(df, "v", {"m": 0.5, "q": 0.9}, ["g"]).collect()}
    want = {g: [v for h, v in rows if h == g and v is not None] for g in "ab"}
    assert got == {g: (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9))) for g, v in want.items() if v}


def test_intervals_use_the_same_distribution_as_p(spark):
    assert stats.t_quantile(0.05, 10) == pytest.approx(2.228139, abs=1e-5)
    x1, x2, g, y, df = _toy(spark, 12)
    for e in stats.ols(df, "y", ["x1"])["terms"].values():
        assert (e["low"] > 0 or e["high"] < 0) == (e["p"] < 0.05)
        assert (e["high"] - e["low"]) / 2 == pytest.approx(stats.t_quantile(0.05, 10) * e["se"])


def test_two_effects_equal_dummies_and_singletons_fall_in_a_chain(spark):
    x1, x2, g, y, df = _toy(spark)
    h = np.arange(len(y)) % 7
    both = spark.createDataFrame([(float(a), int(b), int(c), float(d)) for a, b, c, d in zip(x1, g, h, y)], "x1 double, g int, h int, y double")
    d = np.column_stack([x1, g[:, None] == np.unique(g)[None, :], h[:, None] == np.unique(h)[None, :]]).astype(float)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert stats.ols(both, "y", ["x1"], ["g", "h"])["terms"]["x1"]["estimate"] == pytest.approx(beta[0], abs=1e-8)
    # each row taken away leaves another level with one row, more than twenty times
    chain = spark.createDataFrame([(k, k + 1) for k in range(26)], "g int, h int").select("g", F.floor(F.col("h") / 1).alias("h"))
    links = [(k // 2, (k + 1) // 2) for k in range(30)]
    assert stats._drop_singletons(spark.createDataFrame(links, "g int, h int"), ["g", "h"]).count() == 0
    assert stats._drop_singletons(chain, ["g", "h"]).count() == 0


def test_lexicon_and_window_means(spark):
    from tallyloom.plans import posts

    tokens = spark.createDataFrame([(1, "good"), (1, "good"), (1, "x"), (2, "x"), (3, None)], "doc_id int, w string")
    lexicon = spark.createDataFrame([("good", 0.9), ("bad", 0.1)], "w string, v double")
    got = {r.doc_id: (r.n_tokens, r.n_matched, r.v) for r in posts.lexicon_means(tokens, lexicon, ["v"]).collect()}
    assert got == {1: (3, 2, 0.9), 2: (1, 0, None), 3: (0, 0, None)}
    docs = spark.createDataFrame([(1, "a " * 10), (2, ""), (3, None), (4, "b " * 50)], "doc_id int, text string")
    got = {r.doc_id: (r.n_windows, r.score) for r in posts.window_means(docs, lambda ts: F.size(ts).cast("double"), 4, 5).collect()}
    assert got == {1: (3, 3.3333), 2: (0, None), 3: (0, None), 4: (5, 4.0)}
