"""Aggregates whose denominators and null rules matter. Nulls are unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import mean0, safe_ratio, stdev0


def vote_aggregate(votes: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean, sample deviation and number of the valid votes; a null mean where none is valid."""
    return votes.groupBy(*keys).agg(F.avg(score).alias("clean_score"), stdev0(F.col(score)).alias("sd"), F.count(score).alias("n"))


def eval_summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Three-part summary; each rate has its own denominator.

    Input: clean_score, clean_n, rule_pass, in_pool (null: no pool), answer_comparable, format_ok.
    """
    c = F.col
    valid, pooled = c("clean_n") > 0, c("in_pool").isNotNull()
    comparable = pooled & F.coalesce(c("answer_comparable"), F.lit(False))
    part = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    out = scores.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), part(valid).alias("n_valid"), part(pooled).alias("n_pool"), part(comparable).alias("n_comparable"), part(~c("format_ok")).alias("n_format_fail"),
        F.avg(F.when(valid, c("clean_score"))).alias("clean_mean"), part(c("rule_pass")).alias("__rule"), part(c("in_pool")).alias("__in"), part(comparable & c("in_pool")).alias("__inc"),
    )
    return out.select(*(keys or []), "n", "n_valid", "n_pool", "n_comparable", "n_format_fail", "clean_mean", safe_ratio(c("__rule"), c("n")).alias("rule_pass_rate"), safe_ratio(c("__in"), c("n_pool")).alias("in_pool_rate"), safe_ratio(c("__inc"), c("n_comparable")).alias("in_pool_comparable_rate"))


def eval_two_versions(scores: DataFrame) -> DataFrame:
    """The summary over all rows and over rows of good format, by `version`."""
    flagged = scores.withColumn("version", F.explode(F.when(F.col("format_ok"), F.array(F.lit("all"), F.lit("format_ok"))).otherwise(F.array(F.lit("all")))))
    return eval_summary(flagged, ["version"])


def judge_ensemble(votes: DataFrame, key: str, rank: str, traces: str, strict_majority: bool = False) -> DataFrame:
    """Ordinal label (mean rank, rounded half to even), and traces that more than half of the votes name.

    A trace that one vote repeats counts each time unless `strict_majority` is set.
    """
    named = F.explode(F.array_distinct(traces) if strict_majority else F.col(traces))
    base = votes.groupBy(key).agg(F.bround(F.avg(rank)).cast("int").alias("label_rank"), F.count("*").alias("n_votes"))
    counts = votes.select(key, named.alias("trace")).groupBy(key, "trace").agg(F.count("*").alias("c"))
    kept = counts.join(base, key).filter(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("n_votes") / 2) + 1)).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("trace")), ",").alias("traces"))
    return base.join(kept, key, "left").withColumn("traces", F.coalesce("traces", F.lit("")))


def histogram(df: DataFrame, array: Column, out: str = "reason") -> DataFrame:
    return df.select(F.explode(array).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def funnel(df: DataFrame, gates: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Counts of rows that pass each gate and all gates before it."""
    passed, out = F.lit(True), [F.count("*").alias("n_input")]
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        out.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*(keys or [])).agg(*out)


def over_sets(df: DataFrame, by: str, out: str, agg: list[Column]) -> DataFrame:
    """Aggregates over all rows, as `all`, and for each value of a column, in one pass (grouping sets)."""
    sets = df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("__all"), *agg)
    return sets.withColumn(out, F.when(F.col("__all") == 1, "all").otherwise(F.col(by).cast("string"))).drop("__all", *([by] if by != out else []))


def any_of_k(df: DataFrame, keys: list[str], ok: Column, split: str | None = None) -> DataFrame:
    """Share of keys with any success and mean successes a key, over all and by split."""
    each = df.groupBy(*keys, *([split] if split else [])).agg(F.max(ok.cast("int")).alias("any_ok"), F.sum(ok.cast("int")).alias("n_ok"))
    agg = [F.count("*").alias("n"), F.avg("any_ok").alias("rescue_rate"), F.avg("n_ok").alias("mean_ok")]
    return over_sets(each, split, "split", agg) if split else each.agg(*agg).withColumn("split", F.lit("all"))


def pool_density(df: DataFrame, keys: list[str], clean: Column, dirty: Column, go_at: float = 0.5) -> DataFrame:
    """Share of keys with a clean candidate, and with both kinds; GO from a share of both on."""
    each = df.groupBy(*keys).agg(F.max(clean.cast("int")).alias("c"), F.max(dirty.cast("int")).alias("d"))
    both = F.avg(F.col("c") * F.col("d"))
    return each.agg(F.count("*").alias("n"), F.avg("c").alias("p_clean"), both.alias("p_both"), F.when(both >= go_at, "GO").otherwise("NO_GO").alias("decision"))


def headroom(candidates: DataFrame, baseline: DataFrame, key: str, score: str, base_score: str) -> DataFrame:
    """Mean gain of the best candidate over the baseline."""
    best = candidates.groupBy(key).agg(F.max(score).alias("best"))
    return best.join(baseline, key).agg(F.count("*").alias("n"), mean0(F.col("best") - F.col(base_score)).alias("headroom"))


def resolution_curve(df: DataFrame, level: str, score: str) -> DataFrame:
    return df.groupBy(level).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), stdev0(F.col(score)).alias("sd"), F.min(score).alias("low"), F.max(score).alias("high"))


def variance_components(votes: DataFrame, key: str, score: str, k: int = 16) -> DataFrame:
    """Within: mean of population variances; between: variance of means less within / k, 0 at least; pooled: root of within."""
    each = votes.groupBy(key).agg(F.avg(score).alias("m"), F.var_pop(score).alias("v"))
    out = each.agg(F.count("*").alias("n"), F.avg("v").alias("within"), F.var_pop("m").alias("vm"))
    return out.select("n", "within", F.greatest(F.lit(0.0), F.col("vm") - F.col("within") / k).alias("between"), F.sqrt("within").alias("pooled_rms"))


def cost_meter(usage: DataFrame, tag: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Calls, tokens and cost by tag."""
    from ..functions.stats import cost

    out = usage.groupBy(tag).agg(F.count("*").alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    return out.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out")))


def phrase_shift(old: DataFrame, new: DataFrame, item: str, top: int = 6) -> DataFrame:
    """The items most frequent in the new rows with their shares in both and the shift."""
    share = lambda d, name: d.groupBy(item).agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("t")))).select(item, F.col("n").alias(f"n_{name}"), safe_ratio(F.col("n"), F.col("t")).alias(f"share_{name}"))  # noqa: E731  one row
    best = share(new, "new").orderBy(F.desc("n_new"), item).limit(top)
    return best.join(share(old, "old"), item, "left").select(item, "n_new", F.coalesce("n_old", F.lit(0)).alias("n_old"), (F.col("share_new") - F.coalesce("share_old", F.lit(0.0))).alias("shift"))
