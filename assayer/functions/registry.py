"""Extension points: named column builders, scorers, SQL functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUILDERS: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    """Names a column builder (a reward, a gate)."""

    def keep(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in _BUILDERS:
            raise ValueError(f"{name} is taken")
        _BUILDERS[name] = f
        return f

    return keep


def builder(name: str) -> Callable[..., Column]:
    return _BUILDERS[name]


class Scorer(Protocol):
    """Whatever scores (reference, text) k times: its result is a table of votes."""

    def votes(self, df: DataFrame, key: str, k: int) -> DataFrame: ...


class HashScorer:
    """A deterministic stand-in for a judge: votes 0 to 10 from a hash; some fail (null)."""

    def __init__(self, seed: str = "scorer", fail_one_in: int = 16):
        self.seed, self.fail = seed, fail_one_in

    def votes(self, df: DataFrame, key: str, k: int) -> DataFrame:
        rows = df.select(key).withColumn("vote", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(self.seed), F.col(key).cast("string"), F.col("vote").cast("string"))), 1, 8), 16, 10).cast("long")
        return rows.withColumn("score", F.when(h % self.fail != 0, (h % 101) / 10.0))


def register_sql(spark: SparkSession, marks: dict[str, list[str]] | None = None) -> None:
    """SQL names for functions that Spark has no built-in for. marks: other marks for rag_spans, without the list of documents."""
    from . import text
    from .rules import rag_spans

    for name, f in (("nfkc", text.nfkc), ("longest_share", text.longest_share), ("match_ratio", text.match_ratio)):
        spark.udf.register(name, f)
    spark.udtf.register("rag_spans", rag_spans(marks, dump=marks is None))
