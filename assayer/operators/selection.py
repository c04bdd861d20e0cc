"""Best of K, pairs, buckets and caps. Ties always go to the smaller index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import confident_cleaner
from .ranking import first_by, hash_rank, sum_before, top_by


def best_of_k(df: DataFrame, keys: list[str], score: str, index: list[str]) -> DataFrame:
    """The row with the highest score of each key; null scores drop out."""
    return first_by(df.filter(F.col(score).isNotNull()), keys, [F.desc(score), *map(F.col, index)])


def composite(accuracy: Column, human: Column) -> Column:
    return accuracy * (0.5 + 0.5 * human)


def top_n(df: DataFrame, keys: list[str], score: Column, index: list[str], n: int, floor: Column | None = None) -> DataFrame:
    """The n best rows of each key, of those above a floor; `rank` counts from 1."""
    df = df.filter(floor) if floor is not None else df
    return top_by(df.withColumn("__s", score), keys, [F.desc("__s"), *map(F.col, index)], n, "rank").drop("__s")


def extreme_pairs(df: DataFrame, keys: list[str], score: str, index: list[str], margin: float, low: str | None = None) -> DataFrame:
    """Best against worst (by `low`, the score itself by default) of each key, where the margin is met and they differ.

    One aggregation: both ends are structs, so nothing is joined and no text is moved.
    """
    low = low or score
    values = [F.col(c) for c in index]
    best = F.min(F.struct((-F.col(score)).alias("s"), *values))
    worst = F.min(F.struct(F.col(low).alias("s"), *values))
    out = df.filter(F.col(score).isNotNull() & F.col(low).isNotNull()).groupBy(*keys).agg(best.alias("b"), worst.alias("w"))
    differ = F.struct(*[F.col(f"b.{c}") for c in index]) != F.struct(*[F.col(f"w.{c}") for c in index])
    cols = [F.col(f"{a}.{c}").alias(f"{n}_{c}") for a, n in (("b", "chosen"), ("w", "rejected")) for c in index]
    return out.withColumns({"chosen_score": -F.col("b.s"), "rejected_score": F.col("w.s")}).filter(differ & (F.col("chosen_score") - F.col("rejected_score") >= margin)).select(*keys, *cols, "chosen_score", "rejected_score")


def ranked_pairs(df: DataFrame, keys: list[str], index: list[str], chosen: Column, chosen_order: list[Column], fits, rejected_order: list[Column]) -> DataFrame:
    """Chosen: first row that satisfies a predicate. Rejected: first other row that fits that chosen one.

    `fits` takes functions c(name) and r(name) for columns of the two sides.
    """
    best = first_by(df.filter(chosen), keys, chosen_order)
    best = best.select(*keys, *[F.col(c).alias(f"chosen_{c}") for c in best.columns if c not in keys])
    both = df.join(best, keys)
    c, r = (lambda n: F.col(f"chosen_{n}")), F.col
    other = F.struct(*[c(i) for i in index]) != F.struct(*[r(i) for i in index])
    return first_by(both.filter(other & fits(c, r)), keys, rejected_order)


def nested_buckets(df: DataFrame, clean: str, dirty: str, sigmas: tuple[float, ...] = (2.0, 3.0)) -> DataFrame:
    """One row for each bucket (a number of sigmas) that a row's margin passes: each is a subset of the one before."""
    flags = [F.when(confident_cleaner(F.col(clean), F.col(dirty), s), F.lit(int(s))) for s in sigmas]
    return df.withColumn("bucket", F.explode(F.array_compact(F.array(*flags))))


def first_success(df: DataFrame, keys: list[str], index: str, eligible: Column, ok: Column, cap: int) -> DataFrame:
    """Early stop at the first success among the first `cap` eligible candidates.

    first_ok: its 0-based place, null without success; n_judged: how many were looked at.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    placed = df.filter(eligible).withColumn("__p", F.row_number().over(w) - 1).filter(F.col("__p") < cap)
    out = placed.groupBy(*keys).agg(F.min(F.when(ok, F.col("__p"))).alias("first_ok"), F.count("*").alias("n_eligible"))
    return out.withColumn("n_judged", F.least(F.col("n_eligible"), F.coalesce(F.col("first_ok") + 1, F.col("n_eligible"))))


def capped_lineage(df: DataFrame, repaired: Column, key: str, seed: str, share: float = 0.25) -> DataFrame:
    """All rows that were not repaired, and of the repaired ones floor(share * all the others) in hash order."""
    tagged = df.withColumn("__rep", repaired)
    limit = tagged.agg(F.floor(F.count_if(~F.col("__rep")) * share).alias("__cap"))
    some = hash_rank(tagged.filter("__rep"), F.col(key), seed, [F.col(key)], "__r").crossJoin(F.broadcast(limit)).filter("__r <= __cap").drop("__r", "__cap")  # one row
    return tagged.filter("not __rep").unionByName(some).drop("__rep")


def capped_union(base: DataFrame, seeds: DataFrame, order: list[Column], share: float = 0.05) -> DataFrame:
    """Base rows and at most max(1, share of them) seeds."""
    n = max(1, int(base.count() * share))
    return base.unionByName(seeds.orderBy(*order).limit(n))


def anchors(df: DataFrame, good: Column, good_order: list[Column], bad_order: list[Column], n: int) -> DataFrame:
    """n good and n bad examples, each side in its own order (top-k, no total sort)."""
    pick = lambda d, order, name: d.orderBy(*order).limit(n).withColumn("anchor", F.lit(name))
    return pick(df.filter(good), good_order, "good").unionByName(pick(df.filter(~good), bad_order, "bad"))


def group_advantage(df: DataFrame, keys: list[str], reward: str, eps: float = 1e-4) -> DataFrame:
    """(r - mean) / (sd + eps) within a group; groups without spread drop out."""
    group = Window.partitionBy(*keys)  # a group is the K candidates of a query
    placed = df.withColumns({"__m": F.avg(reward).over(group), "__s": F.stddev_samp(reward).over(group)}).filter(F.col("__s") >= eps)
    return placed.withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def nearest_rank(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """One row: the value at place round((n - 1) p), half to even, for each p. Ranks come from counts by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    placed = sum_before(counts, value, "c", "lo").withColumn("hi", F.col("lo") + F.col("c")).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # one row
    at = lambda p: F.bround((F.col("n") - 1) * p)
    return placed.agg(*[F.max(F.when((at(p) < F.col("hi")) & (at(p) >= F.col("hi") - F.col("c")), F.col(value))).alias(f"p{int(p * 100)}") for p in quantiles])


def seed_tiers(df: DataFrame, passed: Column, path_ok: Column, burden: Column, d_burden: Column) -> DataFrame:
    """tier: T1 anchors, T3 negatives only, else the reason for skipping."""
    tier = (
        F.when(passed & path_ok & (burden >= 1) & (d_burden >= 1), "T1").when(~passed & (burden >= 1), "T3")
        .when(passed & ~path_ok, "skip_path").when(passed & (burden < 1), "skip_source_clean").when(passed, "skip_no_gain").otherwise("skip_failed_clean")
    )
    return df.withColumn("tier", tier)


def replay_filter(df: DataFrame, order: str, ok: Column, n: int, reason: Column) -> DataFrame:
    """(outcome, n_rows): rows in order up to the n-th pass; kept rows and reasons of those killed on the way.

    The place of the n-th pass is found by top-k among passing rows; all else is a filter and counts.
    """
    tagged = df.withColumn("__ok", ok).withColumn("__why", reason)
    cut = tagged.filter("__ok").select(order).orderBy(order).limit(n).agg(F.count("*").alias("k"), F.max(order).alias("last"))
    near = tagged.crossJoin(F.broadcast(cut)).filter((F.col("k") < n) | (F.col(order) <= F.col("last")))  # one row
    return near.groupBy(F.when(F.col("__ok"), "kept").otherwise(F.col("__why")).alias("outcome")).agg(F.count("*").alias("n_rows"))


def segment_weights(text: Column, mark: str, before: float = 0.02, after: float = 0.1) -> Column:
    """Weight of each character: `before` up to and with the mark, `after` behind it; all `before` without a mark."""
    at = F.locate(mark, text)
    end = F.when(at == 0, F.length(text)).otherwise(at + len(mark) - 1)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(i <= end, before).otherwise(after))).otherwise(F.array().cast("array<double>"))
