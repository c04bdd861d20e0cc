"""Go / no-go rules over summaries of one row, as columns, so that they compose with any plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import eval_se


def prune(new: DataFrame, parent: DataFrame, floor: float, tolerance: float, k: int = 3) -> DataFrame:
    """Whether a node is too bad: below the floor, or below its parent by more than the tolerance and 3 SE of a difference."""
    both = new.select(F.col("clean_mean").alias("m"), F.col("n")).crossJoin(parent.select(F.col("clean_mean").alias("p")))  # one row each
    se = eval_se(F.col("n"), F.lit(k)) * math.sqrt(2)
    drop = F.col("p") - F.col("m")
    reason = F.when(F.col("m") < floor, "below_floor").when((drop > tolerance) & (drop > 3 * se), "worse_than_parent").otherwise("keep")
    return both.select(drop.alias("drop"), (reason != "keep").alias("prune"), reason.alias("reason"))


def stage_verdict(delta: Column, n: Column, k: int = 3) -> Column:
    """TRUE_GAIN or REGRESSION beyond 3 SE of one mean."""
    se = eval_se(n, F.lit(k))
    return F.when(delta > 3 * se, "TRUE_GAIN").when(delta < -3 * se, "REGRESSION").otherwise("NEUTRAL")


def project_pass(verdict: Column, in_pool_rate: Column, least: float = 0.85) -> Column:
    return (verdict == "TRUE_GAIN") & (in_pool_rate >= least)


def paired_go(ci_low: Column, d_grounded: Column, d_accuracy: Column) -> Column:
    return (ci_low > 0) & (d_grounded >= -0.01) & (d_accuracy >= -0.01)


def goodhart(mean_gain: Column) -> Column:
    """The score rises through deleting marks alone."""
    return mean_gain >= 0.04


def rewrite_ceiling(gain: Column, d_accuracy: Column, least: float = 0.05) -> Column:
    return F.when((gain >= least) & (d_accuracy >= -0.01), "GO").otherwise("NO_GO")


def headroom_verdict(x: Column, y: Column) -> Column:
    """Rescue rate x and rewrite rate y against 0.45 and 0.60."""
    return F.when(x >= 0.60, "SELF_SAMPLING").when((x >= 0.45) | (y >= 0.60), "MIXED").otherwise("REWRITE_OR_STOP")


def kept_direction(df: DataFrame, old: Column, new: Column, bar: float = 0.70) -> DataFrame:
    """Share of pairs whose margin keeps its sign when judged again, and the verdict."""
    out = df.agg(F.count("*").alias("n"), F.count_if(F.signum(old) == F.signum(new)).alias("kept"))
    return out.withColumn("verdict", F.when(F.col("kept") >= F.col("n") * bar, "STABLE").otherwise("UNSTABLE"))


def stable_pairs(df: DataFrame, margins: list[Column], least: float) -> DataFrame:
    """Pairs whose margin reaches a least value in every judging."""
    for m in margins:
        df = df.filter(m >= least)
    return df


def pair_audit(df: DataFrame, margin: Column, strong: float) -> DataFrame:
    from ..functions.stats import safe_ratio

    n = F.count("*")
    return df.agg(n.alias("n"), safe_ratio(F.count_if(margin > 0), n).alias("win_rate"), safe_ratio(F.count_if(margin >= strong), n).alias("strong_rate"), safe_ratio(F.count_if(margin < 0), n).alias("loss_rate"))


def escalation(df: DataFrame, k: str, go: Column) -> DataFrame:
    """The smallest k with a GO, null without one."""
    return df.agg(F.min(F.when(go, F.col(k))).alias("chosen_k"))


def recommended_k(sigma: float, ks: tuple[int, ...] = (1, 2, 4, 8, 16)) -> int:
    """The smallest k with sigma / sqrt(k) below 1, else the largest."""
    return next((k for k in ks if sigma / math.sqrt(k) < 1), ks[-1])
