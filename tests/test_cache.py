"""The score cache over runs."""

import os
import shutil

from pyspark.sql import functions as F

from assayer.operators.cache import ScoreCache

SCORED = "key long, version string, k int, n int, clean_score double"


def test_a_second_run_scores_only_new_keys(spark, tmp_path):
    asked = spark.createDataFrame([(i, v) for i in range(40) for v in ("v1", "v2")], "key long, version string")
    first = ScoreCache(spark, f"file://{tmp_path}/c", buckets=4)
    assert first.read().count() == 0 and first.to_score(asked).count() == 80
    first.put(spark.createDataFrame([(i, "v1", 16, 16, i / 2) for i in range(20)] + [(30, "v1", 16, 15, 1.0), (31, "v1", 8, 8, 1.0), (32, "v1", 16, 16, None), (3, "v1", 16, 16, 99.0)], SCORED))
    second = ScoreCache(spark, f"file://{tmp_path}/c", buckets=4)
    left = {(r.key, r.version) for r in second.to_score(asked).collect()}
    assert left == {(i, v) for i in range(40) for v in ("v1", "v2")} - {(i, "v1") for i in range(20)}
    second.put(spark.createDataFrame([(i, "v1", 16, 16, -1.0) for i in range(10, 30)], SCORED))
    got = {(r.key, r.version): r.clean_score for r in ScoreCache(spark, f"file://{tmp_path}/c", buckets=4).read().collect()}
    assert got == {(str(i), "v1"): i / 2 if i < 20 else -1.0 for i in range(30)}
    assert len(second.runs()) == 2


def test_a_lost_run_is_not_there(spark, tmp_path):
    cache = ScoreCache(spark, f"file://{tmp_path}/c")
    for i in range(2):
        cache.put(spark.createDataFrame([(i, "v", 16, 16, 1.0)], SCORED))
    os.remove(f"{tmp_path}/c/run={cache.runs()[1]}/_SUCCESS")
    assert [r.key for r in cache.read().collect()] == ["0"]
    cache.put(spark.createDataFrame([(1, "v", 16, 16, 2.0)], SCORED))
    assert {r.key: r.clean_score for r in cache.read().collect()} == {"0": 1.0, "1": 2.0}


def test_of_two_writers_the_earlier_counts(spark, tmp_path):
    cache = ScoreCache(spark, f"file://{tmp_path}/c")
    cache.put(spark.createDataFrame([(1, "v", 16, 16, 1.0)], SCORED))
    run = cache.runs()[0]
    shutil.copytree(f"{tmp_path}/c/run={run}", f"{tmp_path}/c/run=000000-zzzz")  # another writer that began at the same time
    cache.put(spark.createDataFrame([(1, "v", 16, 16, 5.0), (2, "v", 16, 16, 5.0)], SCORED))
    assert {r.key: r.clean_score for r in cache.read().collect()} == {"1": 1.0, "2": 5.0}


def test_keys_of_other_types(spark, tmp_path):
    cache = ScoreCache(spark, f"file://{tmp_path}/c", buckets=8)
    cache.put(spark.range(200).select(F.col("id").alias("key"), F.lit("v").alias("version"), F.lit(16).alias("k"), F.lit(16).alias("n"), F.lit(1.0).alias("clean_score")))
    asked = spark.createDataFrame([(5, "v"), (7, "v"), (999, "v")], "key long, version string")
    assert {int(r.key) for r in cache.known(asked).collect()} == {5, 7}
