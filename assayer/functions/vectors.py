"""Vectors as arrays of floats: native expressions, and a search of whole tables by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 64 << 20
#: Most similarities that are held at once: of some queries and some rows of a batch.
TILE = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalise(a), normalise(b))


def drag(lengths: Column, sims: Column, theta: float = 0.86) -> Column:
    """struct<drag, copy_share>: length-weighted mean of similarities, and the length share of sentences at or above theta."""
    total = F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.zip_with(lengths, sims, lambda n, s: n * s), F.lit(0.0), lambda s, x: s + x)
    above = F.aggregate(F.zip_with(lengths, sims, lambda n, s: F.when(s >= theta, n.cast("double")).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.struct((weighted / F.greatest(F.lit(1.0), total)).alias("drag"), (above / F.greatest(F.lit(1.0), total)).alias("copy_share"))


def _rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of unit rows; zero vectors stay."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=m, where=n > 0)


def best_cosine(df: DataFrame, asked: Column, key: str, vector: str) -> DataFrame:
    """key, best: for each row that `asked` picks the largest cosine with any other row (another key) of df.

    Queries come in blocks of BLOCK_BYTES, which bounds the broadcast; each block passes once over all vectors (of one
    length), as matrix products of TILE similarities, and each task sends one row a query. Rows without a key or vector are left out.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).filter("k is not null and v is not null")
    queries = df.filter(asked).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).filter("k is not null and v is not null")
    size = queries.agg(F.sum(F.size("v").cast("long") * 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).toArrow()  # BLOCK_BYTES
        shared = spark.sparkContext.broadcast((own.column("k").to_numpy(), _rows(own.column("v").combine_chunks())))
        found = rows.mapInArrow(_searcher(shared), "k long, best double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("k").alias(key)).agg(F.max("best").alias("best"))


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries = shared.value
        best = np.full(len(keys), -np.inf)
        for b in batches:
            if not b.num_rows or not len(keys):
                continue
            own, rows = b.column("k").to_numpy(), _rows(b.column("v"))
            tall = max(1, TILE // len(own))
            for at in range(0, len(keys), tall):
                some = slice(at, at + tall)
                near = queries[some] @ rows.T
                near[keys[some, None] == own[None, :]] = -np.inf
                best[some] = np.maximum(best[some], near.max(axis=1))
        some = np.isfinite(best)
        yield pa.record_batch([pa.array(keys[some], pa.int64()), pa.array(best[some])], names=["k", "best"])

    return search


def combine(weights: dict[str, float]) -> Column:
    """Weighted sum of named signals; null signals count as 0."""
    return sum((w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
