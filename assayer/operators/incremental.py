"""Resumable work in batch form: chunks, early stop, budgets, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_rank

CHUNK = 48


def gather_prefix(df: DataFrame, key: str, ok: Column, target: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """What an incremental run in chunks would have processed when `target` successes were reached.

    Rows in hash order up to the end of the chunk that holds the target-th success (all
    rows if there are fewer). The place is found by top-k, not by a running sum.
    """
    ranked = hash_rank(df.withColumn("__ok", F.coalesce(ok, F.lit(False))), F.col(key), seed, [F.col(key)], "position")
    hit = ranked.filter("__ok").select("position").orderBy("position").limit(target).agg(F.count("*").alias("k"), F.max("position").alias("at"))
    cut = hit.select(F.when(F.col("k") >= target, F.ceil(F.col("at") / chunk) * chunk).alias("cut"))
    return ranked.crossJoin(F.broadcast(cut)).filter(F.col("cut").isNull() | (F.col("position") <= F.col("cut"))).drop("cut", "__ok")  # one row


def budget_fence(usage: DataFrame, order: list[str], cost: Column, limit: float, warn: float = 0.8, day: str | None = None) -> DataFrame:
    """Running cost, state ok / warn / stop, and rows up to the first stop.

    Running sums are taken in two steps (within `day`, then over days), so that no task sums over all rows.
    """
    costs = usage.withColumn("cost", cost).withColumn("__day", F.to_date(day or order[0]))
    days = costs.groupBy("__day").agg(F.sum("cost").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # days are few
    inner = F.sum("cost").over(Window.partitionBy("__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = costs.join(F.broadcast(days.select("__day", before.alias("__before"))), "__day").withColumn("running", inner + F.col("__before"))
    state = F.when(F.col("running") >= limit, "stop").when(F.col("running") >= warn * limit, "warn").otherwise("ok")
    return out.withColumn("state", state).drop("__day", "__before")


def top_up(items: DataFrame, votes: DataFrame, key: str, target: int) -> DataFrame:
    """One row (key, vote) for each vote that is still missing."""
    have = votes.filter(F.col("score").isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    need = items.select(key).join(have, key, "left").withColumn("m", F.greatest(F.lit(0), F.lit(target) - F.coalesce("n", F.lit(0))).cast("int"))
    return need.filter("m > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("m"))).alias("vote"))


def sane_progress(progress: DataFrame, expected: DataFrame, key: str, k: int = 3, input_hash: str | None = None) -> DataFrame:
    """Complete, known and in-scope progress rows; none at all if any is bound to another input."""
    rows = progress
    if input_hash is not None:
        bound = progress.agg(F.coalesce(F.bool_or(F.col("input_hash") != input_hash), F.lit(False)).alias("other"))
        rows = rows.crossJoin(F.broadcast(bound)).filter(~F.col("other")).drop("other")  # one row
    return rows.filter((F.col("n") == k) & F.col("clean_score").isNotNull()).join(expected.select(key).distinct(), key, "left_semi")


def stale_schema(df: DataFrame, required: set[str]) -> set[str]:
    """Required columns that a table lacks."""
    return required - set(df.columns)


def stage_manifest(stages: DataFrame, expected: DataFrame) -> DataFrame:
    """stage, state: missing, incomplete or complete by number of rows; a file alone is not completion."""
    out = expected.join(stages, "stage", "left")
    return out.select("stage", F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") < F.col("n_expected"), "incomplete").otherwise("complete").alias("state"))


def warm_up(score: Column, rule: Column, call: Column, first: int) -> Column:
    """The first calls use the rule alone."""
    return F.when(call < first, rule).otherwise(score)


def stage_range(stages: list[str], start: str | None = None, end: str | None = None, skip: tuple[str, ...] = (), only: str | None = None, manual: tuple[str, ...] = ()) -> list[str]:
    """Stages to run; manual ones only when asked for by name."""
    if only:
        return [s for s in stages if s == only]
    lo, hi = (stages.index(start) if start else 0), (stages.index(end) + 1 if end else len(stages))
    return [s for s in stages[lo:hi] if s not in skip and s not in manual]
