"""The stateful meter against the batch fence, over restarts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import incremental as I
from assayer.streaming.metered import Meter, metered, run_metered
from assayer.streaming.progress import file_stream

SCHEMA = "tag string, at long, cost double, score double, fine boolean"


def rows(lo, hi):
    return [("ab"[i % 3 == 0], i, 0.5 + i % 4, i / 10, i % 5 == 0) for i in range(lo, hi)]


def meter(spark, source, folder, **own):
    c = F.col
    stream = metered(file_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, 1), "tag", "at", c("cost"), c("score"), F.lit(-1.0), c("fine"), **own)
    return run_metered(spark, stream, f"{folder}/out", f"{folder}/checkpoint")


def test_restart_goes_on_and_totals_equal_the_batch_fence(spark, tmp_path):
    write = lambda lo, hi: spark.createDataFrame(rows(lo, hi), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write(0, 40)
    meter(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", limit=100.0, first=4)
    write(40, 90)
    write(90, 130)
    out = meter(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", limit=100.0, first=4)
    got = {(r.tag, r.at): r for r in out.collect()}
    assert len(got) == 130 and all(r.taken for r in got.values())
    whole = spark.createDataFrame(rows(0, 130), SCHEMA)
    for tag in "ab":
        batch = I.budget_fence(whole.filter(F.col("tag") == tag).withColumn("day", F.lit("2024-01-01")), ["at"], F.col("cost"), 100.0, day="day").collect()
        for r in batch:
            own = got[tag, r.at]
            assert own.running == pytest.approx(r.running) and own.state == r.state
        calls = sorted((r for r in got.values() if r.tag == tag), key=lambda r: r.at)
        assert [r.call for r in calls] == list(range(len(calls)))
        assert all(r.score == -1.0 for r in calls[:4]) and all(r.score == r.at / 10 for r in calls[4:])
    assert {r.state for r in got.values()} == {"ok", "warn", "stop"}


def test_runs_end_with_the_chunk_of_the_last_success(spark, tmp_path):
    for lo, hi in ((0, 25), (25, 61), (61, 120)):
        spark.createDataFrame([("a", i, 1.0, 0.0, i % 4 == 0) for i in range(lo, hi)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = meter(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", limit=1e9, target=10, chunk=8)
    taken = sorted(r.at for r in out.collect() if r.taken)
    assert taken == list(range(40)) and out.count() == 120  # the tenth success is at 36
    assert out.agg(F.max("running")).first()[0] == 40.0


@pytest.mark.parametrize("cut", [1, 3, 7, 50])
def test_meter_in_pieces(cut):
    """However rows are dealt over micro-batches, the meter says the same."""
    rng = np.random.default_rng(1)
    got = pd.DataFrame({"meter_order": range(50), "meter_cost": rng.random(50), "meter_score": rng.random(50), "meter_rule": 9.0, "meter_ok": rng.random(50) < 0.3})
    m = Meter(12.0, 0.8, 5, 4, 6)
    whole, end = m.advance(got, 0, 0.0, 0, 0, False)
    state, parts = (0, 0.0, 0, 0, False), []
    for at in range(0, 50, cut):
        part, state = m.advance(got[at : at + cut], *state)
        parts.append(part)
    both = pd.concat(parts)
    assert (both.taken == whole.taken).all() and np.allclose(both.running, whole.running) and (both.state == whole.state).all()
    assert (state[0], state[2], state[4]) == (end[0], end[2], end[4]) and state[1] == pytest.approx(end[1])
    n = int(whole.taken.sum())
    assert n % 6 == 0 and got["meter_ok"][: n - 6].sum() < 4 <= got["meter_ok"][:n].sum()


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert meter(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", limit=1.0).count() == 0
