"""Replies of judges and services."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import judge
from assayer.plans import base


def states(spark, f, said, text="The quick brown fox jumps over it"):
    rows = [(i, s if isinstance(s, str) or s is None else json.dumps(s), text) for i, s in enumerate(said)]
    return [r.e for r in spark.createDataFrame(rows, "i int, raw string, text string").select("i", f(F.col("raw"), F.col("text")).alias("e")).orderBy("i").collect()]


def test_verdicts_need_evidence(spark):
    good, bad = {"span": "quick  brown"}, {"quote": "never said"}
    said = [
        {"evidence": [good], "verdict": "traced"}, {"evidence": [bad], "verdict": "traced"}, {"evidence": [good], "verdict": "clean"}, {"evidence": [bad], "verdict": "clean"}, {"verdict": "clean", "evidence": []},
        {"evidence": {"span": "x"}, "verdict": "clean"}, {"evidence": {}, "verdict": "clean"}, {"verdict": "clean"}, {"evidence": [], "verdict": True}, None, "", "no braces", "{bad}", {"evidence": [{"span": "", "quote": "ｑｕｉｃｋ brown"}], "verdict": "traced"}, {"evidence": [{"span": "quick"}], "verdict": "traced"},
    ]
    got = states(spark, judge.evidence, said)
    assert [e.state for e in got] == ["ok", "weakened", "conflict", "ok", "verdict_first", "not_a_list", "ok", "ok", "invalid_verdict", "no_json", "no_json", "no_json", "no_json", "ok", "weakened"]
    assert [e.verdict for e in got[:3]] == ['"traced"', '"clean"', '"clean"'] and got[1].confidence == "low" and got[0].confidence == "high"
    assert (got[1].n_evidence, got[1].n_valid, got[1].n_invalid) == (1, 0, 1)


def test_scores_need_evidence(spark):
    good, bad = {"span": "quick brown"}, {"span": "never said"}
    said = [
        {"evidence": [good, bad], "score": 0.5}, {"evidence": [good, bad, bad], "score": 0.5}, {"evidence": [good], "score": 0.9}, {"evidence": [], "score": 0.59}, {"evidence": [], "score": 0.6}, {"evidence": [good]},
        {"score": 0.1, "evidence": [good]}, {"evidence": [good], "score": "0.25"}, {"evidence": "x", "score": 1}, {"evidence": [3, good], "score": 0.5}, {"evidence": [3, 4, good], "score": 0.5},
    ]
    got = states(spark, judge.evidence_score, said)
    assert [e.state for e in got] == ["ok", "mostly_invalid", "high_conflict", "low_unproven", "ok", "bad_score", "score_first", "ok", "not_a_list", "mostly_invalid", "mostly_invalid"]
    assert got[0].score == 0.5 and got[7].score == 0.25 and got[1].score is None


def test_error_bodies_raise(spark):
    one = lambda body: spark.createDataFrame([(body,)], "b string").select(judge.reply_text("b").alias("t")).first().t
    assert one('{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert one('{"data":{"text":"hi"}, "error": null}') == "hi"
    for body in ('{"error": {"code": 1}, "text": "x"}', '{"success": false, "text": "x"}', '{"err": "it failed", "text": "x"}', "[1]", "text", None, '{"a": 1}'):
        with pytest.raises(Exception, match="reply"):
            one(body)


def test_copy_levels(spark):
    got = spark.createDataFrame([(0, 0), (0, 4), (1, 1), (3, 9), (7, 9), (9, 9)], "k int, n int").select(judge.copy_level(F.col("k"), F.col("n")).alias("l")).collect()
    assert [r.l for r in got] == [0, 0, 5, 3, 4, 5]


def test_names_of_queries_are_unique():
    with pytest.raises(ValueError, match="headroom"):

        @base.query("X")
        def headroom(spark, sf_dir):
            return None

    assert "best_of_k_headroom" in base.QUERIES
