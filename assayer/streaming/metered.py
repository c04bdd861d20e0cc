"""Metered scoring as a stateful stream: running cost against a budget, a warm-up of calls, and an end at enough successes.

One processor for each key (a budget, a run, a tag) keeps five numbers in the state store: calls, cost, successes,
successes before the chunk that is open, and whether the run has ended. A restart goes on from the last commit,
so that what was spent before counts.

Within a micro-batch the rows of a key are taken in the order asked for; micro-batches come in the order of their files.
A key's rows of one micro-batch are held together, so `maxFilesPerTrigger` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "calls bigint, cost double, ok bigint, before bigint, ended boolean"
OK, WARN, STOP = "ok", "warn", "stop"


class Meter(StatefulProcessor):
    """State of a key, and what it makes of its rows (order, cost, score, rule, ok)."""

    def __init__(self, limit: float, warn: float, first: int, target: int | None, chunk: int):
        self.limit, self.warn, self.first, self.target, self.chunk = limit, warn, first, target, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("meter", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("meter_order", kind="stable")
        known = self.state.get() if self.state.exists() else (0, 0.0, 0, 0, False)
        out, state = self.advance(got, *known)
        self.state.update(state)
        out.insert(0, "meter_key", key[0])
        yield out

    def advance(self, got: pd.DataFrame, calls: int, cost: float, ok: int, before: int, ended: bool) -> tuple[pd.DataFrame, tuple]:
        """Output rows and the new state. Rows after the end of a run neither cost nor count."""
        n = len(got)
        good = got["meter_ok"].to_numpy(bool)
        taken = 0 if ended else n
        if not ended and self.target is not None:
            # a chunk is taken while there were too few successes before it
            at = 0
            while at < n:
                left = self.chunk - (calls + at) % self.chunk
                if left == self.chunk:
                    before = ok + int(good[:at].sum())
                    if before >= self.target:
                        taken, ended = at, True
                        break
                at += left
        number = calls + np.arange(n)
        running = cost + np.cumsum(np.where(np.arange(n) < taken, got["meter_cost"].to_numpy(float), 0.0))
        score = np.where(number < self.first, got["meter_rule"].to_numpy(float), got["meter_score"].to_numpy(float))
        state = np.select([running >= self.limit, running >= self.warn * self.limit], [STOP, WARN], OK)
        out = pd.DataFrame({"meter_order": got["meter_order"], "call": number, "running": running, "state": state, "score": score, "taken": np.arange(n) < taken})
        new = calls + taken, float(running[taken - 1]) if taken else cost, ok + int(good[:taken].sum()), before, ended
        return out, new

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State stores of queries that start inside are RocksDB ones, as value states need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def metered(
    stream: DataFrame, key: str, order: str, cost: Column, score: Column, rule: Column, ok: Column, limit: float, warn: float = 0.8, first: int = 0, target: int | None = None, chunk: int = 48
) -> DataFrame:
    """key, order, call (from 0 on), running (cost), state (ok, warn, stop), score, taken for each row of a stream.

    The first calls have the rule's score. A run ends with the chunk in which its `target`-th success is; later rows
    are not taken. state is stop from the row on that reaches the limit.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rows = stream.select(F.col(key).alias("meter_key"), F.col(order).alias("meter_order"), zero(cost).alias("meter_cost"), score.cast("double").alias("meter_score"), rule.cast("double").alias("meter_rule"), F.coalesce(ok, F.lit(False)).alias("meter_ok"))
    fields = [T.StructField("meter_key", stream.schema[key].dataType), T.StructField("meter_order", stream.schema[order].dataType)]
    fields += [T.StructField(n, t) for n, t in (("call", T.LongType()), ("running", T.DoubleType()), ("state", T.StringType()), ("score", T.DoubleType()), ("taken", T.BooleanType()))]
    out = rows.groupBy("meter_key").transformWithStateInPandas(Meter(limit, warn, first, target, chunk), T.StructType(fields), "Append", "None")
    return out.withColumnsRenamed({"meter_key": key, "meter_order": order})


def run_metered(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Takes all that is there and ends; a later call goes on with the state and takes what is new. Returns all rows so far."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocksdb(spark):
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields])).parquet(f"{out}/batch=*")
