"""Orders and ranks that stay distributed.

A global rank never puts all rows into one partition: rows are dealt into ordered
buckets (a monotone column, such as the first hex digits of a hash), ranked inside
their bucket, and shifted by the number of rows in the buckets before. Only the
bucket counts, a table of bounded size, are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Hex digits of a hash that name a bucket: 4,096 buckets.
BUCKET_DIGITS = 3
#: Ranges of values of a numeric column.
RANGES = 256
#: Distinct values that one task orders.
ONE_TASK = 100_000


def content_id(*parts: Column, digits: int = 12, sha: int = 1, sep: str = "\n") -> Column:
    """Content-addressed id: leading hex digits of SHA-1 (or SHA-2 of so many bits) of the joined parts."""
    joined = F.concat_ws(sep, *parts)
    return F.substring(F.sha1(joined) if sha == 1 else F.sha2(joined, sha), 1, digits)


def hash_order(seed: str | int, key: Column) -> Column:
    """Stands for a seeded shuffle: order by this; the same in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def side(seed: str | int, key: Column) -> Column:
    """0 or 1 by the last hex digit of the hash."""
    return (F.conv(F.substring(hash_order(seed, key), 32, 1), 16, 10).cast("int") % 2).cast("int")


def global_rank(df: DataFrame, order: list[Column], bucket: Column, out: str = "rank") -> DataFrame:
    """Adds a 1-based rank over all rows. `bucket` must be monotone in the first order column and have few values."""
    df = df.withColumn("__b", bucket)
    counts = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each bucket: a proven bound (buckets are few by contract)
    offsets = F.broadcast(counts.select("__b", F.coalesce(before, F.lit(0)).alias("__off")))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return df.join(offsets, "__b").withColumn(out, (inner + F.col("__off")).cast("long")).drop("__b", "__off")


def hash_rank(df: DataFrame, key: Column, seed: str | int | None = None, tie: list[Column] | None = None, out: str = "rank") -> DataFrame:
    """Global rank in hash order (or, without a seed, in the order of a hex id)."""
    h = key if seed is None else hash_order(seed, key)
    df = df.withColumn("__h", h)
    return global_rank(df, [F.col("__h"), *(tie or [])], F.substring("__h", 1, BUCKET_DIGITS), out).drop("__h")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order given (which should be total)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """The first n rows of each key; `out` keeps the rank."""
    name = out or "__rn"
    got = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)
    return got if out else got.drop(name)


def sum_before(df: DataFrame, col: str, n: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds the sum of `n` over rows with a smaller value of `col`; rows differ in (by, col), nulls come first.

    Values are cut at RANGES percentiles, summed within each range, and shifted by the sums of the ranges before: no
    task gets all values, of one key neither.
    """
    keys = by or []
    cut = df.agg(F.percentile_approx(col, [i / RANGES for i in range(1, RANGES)]).alias("cut")).first()["cut"] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cut))])
    placed = df.withColumn("__range", F.size(F.filter(bounds, lambda b: b < F.col(col))) if cut else F.lit(0))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy(*keys, "__range").agg(F.sum(n).alias("__s")).withColumn("__off", F.coalesce(before, F.lit(0))).drop("__s")
    inner = F.sum(n).over(Window.partitionBy(*keys, "__range").orderBy(col).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("__in", F.coalesce(inner, F.lit(0))).join(offsets, [*keys, "__range"]).withColumn(out, F.col("__in") + F.col("__off")).drop("__in", "__off", "__range")


def rank_values(counts: DataFrame, col: str, n: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds to counts by value (rows differ in (by, col)) the mean rank of the rows behind each: ties share theirs.

    `counts` should be a written table, as it is looked at more than once. Up to ONE_TASK rows are ordered in one task, more in ranges.
    """
    keys = by or []
    if counts.count() <= ONE_TASK:
        sums = F.sum(n).over(Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.withColumn("__before", F.coalesce(sums, F.lit(0)))
    else:
        placed = sum_before(counts, col, n, "__before", keys)
    return placed.withColumn(out, F.col("__before") + (F.col(n) + 1) / 2.0).drop("__before")


def average_rank(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """1-based rank with ties sharing their mean rank, from counts by (numeric) value: no row is sorted twice."""
    keys = by or []
    counts = written(df.groupBy(*keys, col).agg(F.count("*").alias("__n")), "value-counts")
    return df.join(rank_values(counts, col, "__n", out, keys).drop("__n"), [*keys, col])
