"""Statistics over tables: correlation, AUC, agreement, bootstrap, resolution."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr, mcnemar, safe_ratio
from ..sources.shared import written
from .aggregates import over_sets
from .ranking import rank_values


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*_pearson(x, y))


def _pearson(x: str, y: str) -> list[Column]:
    return [F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), corr(F.col(x), F.col(y)).alias("r")]


def pearson_sets(df: DataFrame, x: str, y: str, by: str, out: str = "grp") -> DataFrame:
    """out, n, r over all rows (`all`) and for each value of `by`, in one pass."""
    return over_sets(df, by, out, _pearson(x, y))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson over average ranks of the complete pairs, from counts by pair of values: rows are read once and never joined."""
    keys = by or []
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__n"))
    pairs = written(both, "pair-counts")
    for c in ("__x", "__y"):
        counts = written(pairs.groupBy(*keys, c).agg(F.sum("__n").alias("__m")), "value-counts")
        pairs = pairs.join(rank_values(counts, c, "__m", f"{c}r", keys).drop("__m"), [*keys, c])
    n, a, b = F.sum("__n"), F.col("__xr"), F.col("__yr")
    mean = (n + 1) / 2.0
    spread = lambda u, v: F.sum(F.col("__n") * u * v) - n * mean * mean
    sums = pairs.groupBy(*keys).agg(F.coalesce(n, F.lit(0)).alias("n"), spread(a, b).alias("__ab"), spread(a, a).alias("__aa"), spread(b, b).alias("__bb"))
    varied = (F.col("__aa") > 0) & (F.col("__bb") > 0)
    return sums.select(*keys, "n", F.when(varied, F.col("__ab") / (F.sqrt("__aa") * F.sqrt("__bb"))).alias("rho"))


def auc(df: DataFrame, score: str, label: Column, undefined: float | None = 0.5) -> DataFrame:
    """Rank-sum AUC from counts by score; ties count half. Without both classes the value is `undefined` (0.5; the pairwise form has 0)."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("__n"), F.sum(label.cast("int")).alias("__pos"), F.count(label).alias("__known"))
    ranked = rank_values(written(counts, "score-counts"), "__s", "__n", "__r")
    out = ranked.agg(F.sum("__pos").alias("n_pos"), F.sum(F.col("__known") - F.col("__pos")).alias("n_neg"), F.sum(F.col("__r") * F.col("__pos")).alias("s"))
    value = F.try_divide(F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)))
    return out.select("n_pos", "n_neg", F.coalesce(value, F.lit(undefined)).alias("auc"))


#: Modulus of the uniform numbers of resamples.
PRIME = (1 << 31) - 1


def bootstrap_ci(df: DataFrame, value: str, key: str, b: int = 2000, alpha: float = 0.05, seed: int = 13) -> DataFrame:
    """Percentile interval of the mean from b Poisson resamples whose weights come from hashes: deterministic and distributed.

    Weights: a uniform number against the Poisson(1) distribution up to 6. The md5 of (seed, key), taken
    once a row, gives two numbers x and y, and x + i * y modulo a prime is the uniform number of resample i:
    any two resamples are independent, which is what quantiles over resamples need. A task adds up b weights and b weighted
    sums over its rows and sends these alone, so that what is shuffled doesn't grow with the rows.
    """
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(6):
        total += p
        cdf.append(total)
        p /= k + 1
    bounds = np.array(cdf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums, steps = np.zeros(b), np.zeros(b), np.arange(b, dtype=np.int64)
        for batch in batches:
            v, x, y = (batch.column(c).to_numpy() for c in ("v", "x", "y"))
            for at in range(0, len(v), 512):
                part = slice(at, at + 512)
                w = np.searchsorted(bounds, (x[part, None] + steps * y[part, None]) % PRIME / float(PRIME), side="right")
                weights += w.sum(axis=0)
                sums += v[part] @ w
        yield pa.record_batch([pa.array(steps), pa.array(weights), pa.array(sums)], names=["i", "w", "s"])

    md5 = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    part = lambda at: F.conv(F.substring(md5, at, 8), 16, 10).cast("long")
    per = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), part(1).alias("x"), part(9).alias("y")).mapInArrow(run, "i long, w double, s double")
    means = per.groupBy("i").agg(F.try_divide(F.sum("s"), F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    place = F.row_number().over(Window.orderBy("m")) - 1  # b rows
    lo, hi = int(alpha / 2 * (b - 1)), int((1 - alpha / 2) * (b - 1))
    return means.withColumn("p", place).agg(F.max(F.when(F.col("p") == lo, F.col("m"))).alias("low"), F.max(F.when(F.col("p") == hi, F.col("m"))).alias("high"))


def paired_readout(pairs: DataFrame, key: str, goal: Column, guards: dict[str, Column], b: int = 2000, tolerance: float = 0.01) -> DataFrame:
    """One row: n, mean of `goal` (a paired difference) with its interval, means of the guards, and go.

    go: the interval lies above zero and no guard falls by more than `tolerance`. A missing difference counts as 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = pairs.select(F.col(key).alias("key"), zero(goal).alias("goal"), *[zero(c).alias(f"g{i}") for i, c in enumerate(guards.values())])
    means = d.agg(F.count("*").alias("n"), F.avg("goal").alias("delta"), *[F.avg(f"g{i}").alias(k) for i, k in enumerate(guards)])
    out = means.crossJoin(F.broadcast(bootstrap_ci(d, "goal", "key", b)))  # one row each
    held = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"`{k}`") >= -tolerance, F.lit(False)) for k in guards], F.coalesce(F.col("low") > 0, F.lit(False)))
    return out.withColumn("go", held)


def mcnemar_table(pairs: DataFrame, base: Column, candidate: Column) -> DataFrame:
    """base_only, candidate_only and the statistic, over paired booleans."""
    out = pairs.agg(F.count_if(base & ~candidate).alias("base_only"), F.count_if(~base & candidate).alias("candidate_only"))
    return out.withColumn("chi2", mcnemar(F.col("base_only"), F.col("candidate_only")))


def improved_worsened(pairs: DataFrame, base: str, candidate: str, lower_is_better: bool = True) -> DataFrame:
    better = F.col(candidate) < F.col(base) if lower_is_better else F.col(candidate) > F.col(base)
    worse = F.col(candidate) > F.col(base) if lower_is_better else F.col(candidate) < F.col(base)
    out = pairs.agg(F.count_if(better).alias("improved"), F.count_if(worse).alias("worsened"), F.count_if(F.col(base) == F.col(candidate)).alias("tied"))
    return out.withColumn("net", F.col("improved") - F.col("worsened"))


def judge_noise(votes: DataFrame, key: str, vote: str, score: str, label: Column) -> DataFrame:
    """Spread within items, and test-retest over the first two votes: r, mean difference, flip rate."""
    each = votes.groupBy(key).agg(
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"), F.max(F.when(F.col(vote) == 0, F.col(score))).alias("a"), F.max(F.when(F.col(vote) == 1, F.col(score))).alias("b"),
        F.max(F.when(F.col(vote) == 0, label)).alias("la"), F.max(F.when(F.col(vote) == 1, label)).alias("lb"),
    )
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    return each.agg(F.count("*").alias("n"), F.count_if(two).alias("n_two"), F.avg("sd").alias("within_sd"), corr(F.when(two, F.col("a")), F.when(two, F.col("b"))).alias("retest_r"), F.avg(F.when(two, F.abs(F.col("a") - F.col("b")))).alias("mean_abs"), F.avg(F.when(two, (F.col("la") != F.col("lb")).cast("int"))).alias("flip_rate"))


def adjacent_gaps(levels: DataFrame, level: str, mean: str, sd: str) -> DataFrame:
    """Gap to the next level, whether one-sd bands are apart by it and it is 1 at least. Levels are few."""
    w = Window.orderBy(level)
    gap = F.col(mean) - F.lead(mean).over(w)
    apart = (F.abs(gap) >= 1.0) & (F.abs(gap) > F.col(sd) + F.lead(sd).over(w))
    return levels.withColumn("gap", gap).withColumn("separable", apart).filter(F.col("gap").isNotNull())


def flat_runs(gaps: DataFrame, level: str) -> DataFrame:
    """Maximal runs of adjacent levels that can't be told apart: first and last level of each."""
    island = F.sum(F.col("separable").cast("int")).over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    marked = gaps.withColumn("island", island).filter(~F.col("separable"))
    return marked.groupBy("island").agg(F.min(level).alias("first_level"), F.count("*").alias("n_gaps")).drop("island")


def separability(levels: DataFrame, level: str, mean: str, sd: str) -> DataFrame:
    """|difference| / (sd + sd) for each two levels, 99 without spread. Levels are few: a non-equi join of tiny tables."""
    a, b = (levels.select(F.col(level).alias(f"level_{x}"), F.col(mean).alias(f"m{x}"), F.col(sd).alias(f"s{x}")) for x in "ab")
    both = a.join(F.broadcast(b), F.col("level_a") < F.col("level_b"))
    total = F.col("sa") + F.col("sb")
    return both.select("level_a", "level_b", F.when(total <= 1e-9, F.lit(99.0)).otherwise(F.abs(F.col("ma") - F.col("mb")) / F.greatest(total, F.lit(1e-12))).alias("separation"))


def pooled_distance(levels: DataFrame, level: str, mean: str, sd: str) -> DataFrame:
    """Older distance: over the root mean square of the two sds; verdict at 2 and 3."""
    a, b = (levels.select(F.col(level).alias(f"level_{x}"), F.col(mean).alias(f"m{x}"), F.col(sd).alias(f"s{x}")) for x in "ab")
    d = F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.nullif(F.sqrt((F.pow("sa", F.lit(2)) + F.pow("sb", F.lit(2))) / 2), F.lit(0.0)))
    out = a.join(F.broadcast(b), F.col("level_b") == F.col("level_a") + 1).select("level_a", "level_b", d.alias("distance"))
    return out.withColumn("verdict", F.when(F.col("distance") >= 3, "separable").when(F.col("distance") >= 2, "weak").otherwise("not_separable"))


def agreement(df: DataFrame, local: str, judge: str, local_gate: Column, judge_gate: Column) -> DataFrame:
    """Rank correlation and share of equal gates; trusted from 0.6 and 0.85 on."""
    rho = spearman(df, local, judge)
    gates = df.agg(safe_ratio(F.count_if(local_gate == judge_gate), F.count("*")).alias("gate_agreement"))
    return rho.crossJoin(gates).withColumn("trusted", (F.col("rho") >= 0.6) & (F.col("gate_agreement") >= 0.85))  # one row each


def grid_search(df: DataFrame, grid: DataFrame, prediction: Column, label: Column) -> DataFrame:
    """Accuracy of a predicate for each row of a small grid (broadcast), best first, then smaller parameters."""
    params = grid.columns
    return df.crossJoin(F.broadcast(grid)).groupBy(*params).agg(safe_ratio(F.count_if(prediction == label), F.count("*")).alias("accuracy")).orderBy(F.desc("accuracy"), *params)


def balanced_accuracy(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Mean of the two class recalls; a class without rows counts 0."""
    out = df.agg(safe_ratio(F.count_if(predicted & actual), F.count_if(actual)).alias("recall_pos"), safe_ratio(F.count_if(~predicted & ~actual), F.count_if(~actual)).alias("recall_neg"))
    return out.withColumn("balanced_accuracy", (F.col("recall_pos") + F.col("recall_neg")) / 2)
