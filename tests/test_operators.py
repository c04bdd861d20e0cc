"""Mini tables for operators, and invariants."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import aggregates as A
from assayer.operators import decisions as D
from assayer.operators import incremental as I
from assayer.operators import joins as J
from assayer.operators import rows as R
from assayer.operators import selection as W
from assayer.operators import statistics as S
from assayer.operators.ranking import average_rank, hash_order


def test_best_of_k_ties_nulls_and_order(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 0, None), ("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "q string, i int, s double")
    want = {("a", 1), ("c", 0)}
    assert {(r.q, r.i) for r in W.best_of_k(df, ["q"], "s", ["i"]).collect()} == want
    assert {(r.q, r.i) for r in W.best_of_k(df.repartition(3), ["q"], "s", ["i"]).collect()} == want


def test_extreme_pairs_margin_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0), ("b", 1, 2.9), ("c", 0, 5.0)], "q string, i int, s double")
    assert [(r.q, r.chosen_i, r.rejected_i) for r in W.extreme_pairs(df, ["q"], "s", ["i"], 2.0).collect()] == [("a", 1, 0)]


def test_nested_buckets_are_nested(spark):
    df = spark.createDataFrame([(i, 7.3 * i / 20, 0.03) for i in range(21)], "k int, c double, d double")
    got = W.nested_buckets(df, "c", "d").collect()
    two, three = ({r.k for r in got if r.bucket == b} for b in (2, 3))
    assert three <= two and two


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in R.fixed_split(df, "k", 60, "s").collect()}
    assert len(got) == 500 and sum(v == "eval" for v in got.values()) == 60
    order = [r.k for r in df.orderBy(hash_order("s", F.col("k"))).collect()]
    assert {k for k, v in got.items() if v == "eval"} == set(order[:60])
    assert R.tail_holdout(df, "k", 600, 100, "s").filter("held_out").count() == 400


def test_guards(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(ValueError, match="leak"):
        R.require_none(R.leaks(df, df.filter("k = 'a'"), "k"), "leak")
    R.require_none(R.leaks(df, df.filter("k = 'x'"), "k"), "leak")
    row = R.coverage(df, spark.createDataFrame([("b",), ("b",), ("z",)], "k string"), "k").first()
    assert tuple(row) == (1, 1, 1)


def test_votes_keep_unknown_apart_from_zero(spark):
    votes = spark.createDataFrame([("a", 4.0), ("a", None), ("b", None), ("c", 0.0), ("c", 2.0)], "k string, s double")
    got = {r.k: (r.clean_score, r.n) for r in A.vote_aggregate(votes, ["k"], "s").collect()}
    assert got == {"a": (4.0, 1), "b": (None, 0), "c": (1.0, 2)}


def test_eval_summary_denominators_and_empty(spark):
    schema = "clean_score double, clean_n int, rule_pass boolean, in_pool boolean, answer_comparable boolean, format_ok boolean"
    rows = [(4.0, 3, True, True, True, True), (None, 0, True, None, None, True), (2.0, 3, False, False, True, False), (3.0, 3, False, True, False, True)]
    r = A.eval_summary(spark.createDataFrame(rows, schema)).first()
    assert (r.n, r.n_valid, r.n_pool, r.n_comparable) == (4, 3, 3, 2)
    assert (r.clean_mean, r.rule_pass_rate, r.in_pool_comparable_rate) == (3.0, 0.5, 0.5)
    assert A.eval_summary(spark.createDataFrame([], schema)).first().n == 0


def test_ensemble_counts_repeats_unless_strict(spark):
    votes = spark.createDataFrame([("a", 1, ["x", "x"]), ("a", 2, ["y"]), ("a", 2, [])], "k string, r int, t array<string>")
    assert A.judge_ensemble(votes, "k", "r", "t").first().traces == "x"
    assert A.judge_ensemble(votes, "k", "r", "t", strict_majority=True).first().traces == ""


def test_funnel_is_monotone(spark):
    df = spark.range(100)
    r = A.funnel(df, {"a": F.col("id") % 2 == 0, "b": F.col("id") % 3 == 0, "c": F.lit(None).cast("boolean")}).first()
    assert tuple(r) == (100, 50, 17, 0)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0), (4, None)], "k int, x double")
    assert [r.r for r in average_rank(df.filter("x is not null"), "x", "r").orderBy("k").collect()] == [1.5, 1.5, 3.0]
    flat = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert S.pearson(flat, "x", "y").first().r is None
    assert S.auc(df, "x", F.lit(True)).first().auc == 0.5
    both = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert S.auc(both, "s", F.col("y") == 1).first().auc == 0.75


def test_bootstrap_contains_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "k int, x double")
    ci = S.bootstrap_ci(df, "x", "k", b=200).first()
    assert ci.low < 2.97 < ci.high and ci.high - ci.low < 0.8


def test_levels(spark):
    lv = spark.createDataFrame([(0, 7.3, 1.9), (1, 4.6, 0.5), (2, 2.6, 0.6), (3, 2.4, 0.1), (4, 2.3, 0.1)], "l int, m double, s double")
    gaps = S.adjacent_gaps(lv, "l", "m", "s")
    assert [r.separable for r in gaps.orderBy("l").collect()] == [True, True, False, False]
    assert [tuple(r) for r in S.flat_runs(gaps, "l").collect()] == [(2, 2)]


def test_pairing_needs_both_sides(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0)], "k string, m string, v double")
    assert [tuple(r) for r in J.paired(df, ["k"], "m", "x", "y", "v").collect()] == [("a", 1.0, 2.0)]


def test_zip_of_versions_raises(spark):
    a = spark.createDataFrame([(0, "v3")], "i int, version string")
    with pytest.raises(Exception, match="versions differ"):
        J.zip_runs(a, a.withColumn("version", F.lit("v4")), "i", "version").collect()


def test_near_duplicates(spark):
    a = spark.createDataFrame([(1, "how do I declare value added tax this month"), (2, "what is the weather like in spring"), (3, "how do I declare value added tax this month?")], "k int, t string")
    b = spark.createDataFrame([("How do I declare value added tax this month",)], "o string")
    assert {r.k for r in J.near_duplicates(a, b, "t", "o").collect()} == {1, 3}


def test_early_stop_is_chunk_aligned(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = I.gather_prefix(df, "k", F.col("k") % 5 == 0, 20, "s")
    n = got.count()
    assert n % I.CHUNK == 0 and got.filter("k % 5 = 0").count() >= 20
    assert got.filter(F.col("position") <= n - I.CHUNK).filter("k % 5 = 0").count() < 20
    assert I.gather_prefix(df, "k", F.lit(False), 5, "s").count() == 1000


def test_budget_and_top_up(spark):
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i // 4} 00:00:00", 10.0) for i in range(12)], "i int, ts string, c double").withColumn("ts", F.to_timestamp("ts"))
    out = {r.i: r.state for r in I.budget_fence(e, ["ts", "i"], F.col("c"), 100.0).collect()}
    assert [out[i] for i in (0, 7, 8, 9, 11)] == ["ok", "warn", "warn", "stop", "stop"]
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    votes = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None)], "k string, score double")
    assert sorted((r.k, r.vote) for r in I.top_up(items, votes, "k", 2).collect()) == [("b", 1), ("b", 2)]


def test_decisions(spark):
    v = lambda d: spark.range(1).select(D.stage_verdict(F.lit(d), F.lit(500)).alias("v")).first().v
    assert (v(0.155), v(0.1), v(-0.2)) == ("TRUE_GAIN", "NEUTRAL", "REGRESSION")
    assert D.recommended_k(0.5477) == 1 and D.recommended_k(3.0) == 16
    assert I.stage_range(["a", "b", "c"], start="b", manual=("c",)) == ["b"]


def test_first_success(spark):
    df = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("b", 0, False), ("b", 1, False)], "q string, i int, ok boolean")
    got = {r.q: (r.first_ok, r.n_judged) for r in W.first_success(df, ["q"], "i", F.lit(True), F.col("ok"), 5).collect()}
    assert got == {"a": (1, 2), "b": (None, 2)}
