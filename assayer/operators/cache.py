"""A score cache that outlives a run: a folder of committed runs, each partitioned by a hash of the key.

A run adds the complete scores that the cache has not; nothing is changed in place, so a run that is
lost half-way is not there (a reader takes runs with Spark's own success mark), and what was
committed before stays. Of scores that two runs added at once the earlier run's counts. Requests
are joined on bucket and key, so that dynamic pruning reads the buckets they need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import committed
from .ranking import first_by
from .rows import missing

BUCKETS = 64
#: Only scores of this many votes and more are kept, and only if all votes are there.
LEAST_VOTES = 16
SCHEMA = "key string, version string, k int, n int, clean_score double"


class ScoreCache:
    """Scores by key and version in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("key").cast("string"), F.col("version").cast("string")), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[str]:
        """Names of the committed runs, in order: a number, and what tells runs apart that began at the same time."""
        return sorted(p.rsplit("=", 1)[1] for p in committed(self.spark, f"{self.folder}/run=*"))

    def read(self) -> DataFrame:
        """key, version, k, n, clean_score, bucket; the first committed score of a key."""
        schema = f"{SCHEMA}, bucket int"
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, run string").option("basePath", self.folder)
        rows = reader.parquet(*[f"{self.folder}/run={r}" for r in runs])
        return first_by(rows, ["bucket", "key", "version"], [F.col("run"), F.col("clean_score")]).drop("run")

    def known(self, requests: DataFrame) -> DataFrame:
        """The cached scores of requests (key, version)."""
        return requests.select("key", "version").distinct().withColumn("bucket", self._bucket()).join(self.read(), ["bucket", "key", "version"]).drop("bucket")

    def to_score(self, requests: DataFrame) -> DataFrame:
        """Requests that the cache can't answer."""
        return missing(requests, self.known(requests), ["key", "version"])

    def put(self, scored: DataFrame) -> None:
        """Commits the complete new scores as one run; nothing is written where there are none."""
        good = scored.filter((F.col("k") >= LEAST_VOTES) & (F.col("n") == F.col("k")) & F.col("clean_score").isNotNull())
        new = missing(first_by(good, ["key", "version"], [F.col("clean_score")]), self.known(good), ["key", "version"])
        number = max((int(r.split("-")[0]) for r in self.runs()), default=-1) + 1
        cols = [F.col("key").cast("string"), F.col("version").cast("string"), F.col("k").cast("int"), F.col("n").cast("int"), F.col("clean_score").cast("double")]
        new.select(*cols, self._bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/run={number:06d}-{uuid.uuid4().hex[:12]}")
