"""Filters, deduplication, splits, samples and guards over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text0
from .ranking import first_by, hash_order, hash_rank, top_by

# Satisfaction labels.
BAD, GOOD = ("不满意", "非常不满意", "bad"), ("满意", "非常满意", "已解决", "good")


def drop_blank(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns all hold more than white space."""
    for c in cols:
        df = df.filter(strip(text0(c)) != "")
    return df


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(df, keys, order)


def merge_by_priority(sources: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of sources; a key that several have comes from the first."""
    tagged = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return first_by(out, [key], [F.col("source_rank"), *order])


def union_with_origin(named: dict[str, DataFrame], out: str = "origin") -> DataFrame:
    """Bag union with a column that names the source."""
    parts = [d.withColumn(out, F.lit(k)) for k, d in named.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


def clean_array(c: Column) -> Column:
    """Entries stripped, blanks dropped, each once in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: strip(text0(x))), lambda x: x != ""))


def normal_key(c: Column | str) -> Column:
    """White space and punctuation removed, lower case."""
    return F.lower(F.regexp_replace(text0(c), r"(?U)[\s\p{P}]+", ""))


def fixed_split(df: DataFrame, key: str, n: int, seed: str, names: tuple[str, str] = ("eval", "train"), out: str = "split") -> DataFrame:
    """The first n rows in hash order are the first part."""
    ranked = hash_rank(df, F.col(key), seed, [F.col(key)], "__r")
    return ranked.withColumn(out, F.when(F.col("__r") <= n, names[0]).otherwise(names[1])).drop("__r")


def ratio_split(df: DataFrame, key: str, ratio: float, seed: str, names: tuple[str, str] = ("train", "eval"), out: str = "split") -> DataFrame:
    """The first floor(rows * ratio) rows in hash order are the first part."""
    total = df.agg(F.floor(F.count("*") * ratio).alias("__cut"))
    ranked = hash_rank(df, F.col(key), seed, [F.col(key)], "__r").crossJoin(F.broadcast(total))  # one row
    return ranked.withColumn(out, F.when(F.col("__r") <= F.col("__cut"), names[0]).otherwise(names[1])).drop("__r", "__cut")


def systematic_holdout(df: DataFrame, key: str, fraction: float, out: str = "held_out") -> DataFrame:
    """Every round(1 / fraction)-th row by key (a hex id), from the first on."""
    every = max(1, round(1 / fraction))
    return hash_rank(df, F.col(key), None, None, "__r").withColumn(out, (F.col("__r") - 1) % every == 0).drop("__r")


def positional_holdout(df: DataFrame, position: str, every: int = 10, out: str = "held_out") -> DataFrame:
    """Every n-th position, from position 0 on, without sorting."""
    return df.withColumn(out, F.col(position) % every == 0)


def tail_holdout(df: DataFrame, key: str, size: int, min_train: int, seed: str, out: str = "held_out") -> DataFrame:
    """The last min(size, max(0, rows - min_train)) rows in hash order."""
    total = df.agg(F.count("*").alias("__n"))
    ranked = hash_rank(df, F.col(key), seed, [F.col(key)], "__r").crossJoin(F.broadcast(total))  # one row
    return ranked.withColumn(out, F.col("__r") > F.col("__n") - F.least(F.lit(size), F.greatest(F.lit(0), F.col("__n") - min_train))).drop("__r", "__n")


def stratified_sample(df: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group in hash order."""
    return top_by(df, by, [hash_order(seed, F.col(key)), F.col(key)], n)


def sample_with_index(df: DataFrame, position: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of all in hash order; they keep their position in the input."""
    return hash_rank(df, F.col(key), seed, [F.col(key)], "__r").filter(F.col("__r") <= n).drop("__r")


def leaks(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of train whose key the held-out set has."""
    return train.join(held.select(key).distinct(), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows without a partner; with what is done already as the other side, a resume filter."""
    keys = [key] if isinstance(key, str) else key
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def require_none(df: DataFrame, what: str) -> None:
    """Raises if there is any row."""
    n = df.limit(1).count()
    if n:
        raise ValueError(f"{what}: {df.count()} rows")


def control_runs(runs: DataFrame, expected: DataFrame, run: str, key: str, votes: str, score: str, k: int = 3) -> DataFrame:
    """run, n_keys, n_missing, n_extra, n_bad, comparable: whether each run has just the expected keys, each with k votes and a score."""
    asked = expected.select(key).distinct()
    total = asked.agg(F.count("*").alias("__all"))
    each = runs.groupBy(run, key).agg(F.bool_and(F.coalesce((F.col(votes) == k) & F.col(score).isNotNull(), F.lit(False))).alias("__good"))
    known = each.join(asked.withColumn("__known", F.lit(True)), key, "left")
    counts = known.groupBy(run).agg(F.count("*").alias("n_keys"), F.count("__known").alias("__found"), F.count_if(~F.col("__good")).alias("n_bad"))
    out = counts.crossJoin(F.broadcast(total)).select(run, "n_keys", (F.col("__all") - F.col("__found")).alias("n_missing"), (F.col("n_keys") - F.col("__found")).alias("n_extra"), "n_bad")  # one row
    return out.withColumn("comparable", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_bad") == 0))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: n_missing, n_extra, n_duplicate keys."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    repeated = found.groupBy(key).agg((F.count("*") - 1).alias("more"))
    return (
        a.join(b, key, "left_anti").agg(F.count("*").alias("n_missing"))
        .crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("n_extra")))
        .crossJoin(repeated.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n_duplicate")))
    )  # fmt: skip  # one row each


def quality_gate(satisfaction: Column, resolution: Column) -> Column:
    """No bad label, and one good label at least."""
    good = F.coalesce(resolution.isin(*GOOD), F.lit(False)) | F.coalesce(satisfaction.isin(*GOOD), F.lit(False))
    return ~F.coalesce(satisfaction.isin(*BAD), F.lit(False)) & good


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row (key, violation) for each check that doesn't hold; a null check is a violation."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return df.select(key, F.explode(failed).alias("violation"))


def limit0(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; 0 means all."""
    return df.limit(n) if n else df

