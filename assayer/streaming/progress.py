"""Chunked, resumable scoring and live counts as Structured Streaming queries.

The checkpoint makes a restart go on where the last commit was; writing each batch
under its number makes a repeated batch replace itself instead of counting twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import committed


def file_stream(spark: SparkSession, source: str, schema, files_per_batch: int) -> DataFrame:
    """A stream over a folder of Parquet files, or over a single one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source)


def gather(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, ok: str, target: int, files_per_batch: int = 1) -> int:
    """Scores files batch by batch until `target` rows are ok; returns the number of rows written.

    Batches are whole files, so the overshoot is one batch at most. The success count is read
    from what is committed, never kept in memory across batches.
    """
    stream = file_stream(spark, source, schema, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = None
    while done(spark, out, ok)[1] < target:
        before = done(spark, out, ok)[0]
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            while query.isActive and done(spark, out, ok)[0] == before and not _idle(query):
                query.awaitTermination(0.2)
        finally:
            query.stop()
        if done(spark, out, ok)[0] == before:
            break  # nothing is left
    return done(spark, out, ok)[0]


def _idle(query) -> bool:
    """Whether the source has nothing more."""
    p = query.lastProgress
    return p is not None and p["numInputRows"] == 0 and not query.status["isDataAvailable"]


def done(spark: SparkSession, out: str, ok: str) -> tuple[int, int]:
    """Rows and successes committed so far."""
    paths = committed(spark, f"{out}/batch=*")
    if not paths:
        return 0, 0
    row = spark.read.parquet(*paths).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("k")).first()
    return row["n"], row["k"]


def run_available(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Processes all files there are, then ends; a second call takes only what is new."""
    stream = file_stream(spark, source, schema, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def live_counts(stream: DataFrame, by: str):
    """Counts by stage, for a query in complete mode."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def latest_counts(spark: SparkSession, counts: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The whole counts after the last batch: each batch writes a table of its own, and the latest complete one counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    paths = committed(spark, f"{out}/batch=*")
    latest = max(paths, key=lambda p: int(p.rsplit("=", 1)[1]), default=None)
    return spark.read.schema(counts.schema).parquet(latest) if latest else spark.createDataFrame([], counts.schema)


def windowed_counts(stream: DataFrame, ts: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time window with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count("*").alias("n"))
