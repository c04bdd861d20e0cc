"""Text files as numbered lines, and JSON lines that name the file and line of what is torn.

A file may be split over tasks: a line's number is its place in its block plus the lines of the file's blocks before it.
Counts by block are all that is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written
from .tables import CORRUPT, exists


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 on), value of each line of the text files at a path."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "lines")  # places hold only within one reading
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def scan(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines with their file and line, and the lines (file, line, value) that are torn. Blank lines are neither; a missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"file string, line long, {schema}"), spark.createDataFrame([], "file string, line long, value string")
    lines = numbered(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("__p", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    torn = F.col(f"__p.{CORRUPT}").isNotNull()
    names = [c.name for c in spark.createDataFrame([], schema).schema]
    return parsed.filter(~torn).select("file", "line", *[F.col(f"__p.`{c}`").alias(c) for c in names]), parsed.filter(torn).select("file", "line", "value")


def scan_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As scan, but the first torn line raises with its file and number."""
    rows, torn = scan(spark, path, schema)
    bad = torn.orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}, line {bad[0]['line']}: {bad[0]['value'][:80]}")
    return rows


def latest_matching(spark: SparkSession, path: str, pattern: str, tail: int = 131072) -> DataFrame:
    """file, line, value: the last line of each file that matches among the lines that lie in its last `tail` characters."""
    lines = numbered(spark, path)
    size = F.length("value") + 1
    # lines that begin before the tail are told by what follows them, summed in blocks of a thousand lines
    coarse = lines.withColumn("part", F.floor((F.col("line") - 1) / 1000)).withColumn("size", size)
    parts = coarse.groupBy("file", "part").agg(F.sum("size").alias("s"))
    after = F.coalesce(F.sum("s").over(Window.partitionBy("file").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = parts.select("file", "part", after.alias("after")).filter(F.col("after") < tail)
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("file", "part").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    kept = coarse.join(near, ["file", "part"]).withColumn("from_end", F.col("after") + inner).filter((F.col("from_end") <= tail) & F.col("value").rlike(pattern))
    return kept.groupBy("file").agg(F.max_by(F.struct("line", "value"), "line").alias("x")).select("file", "x.line", "x.value")
