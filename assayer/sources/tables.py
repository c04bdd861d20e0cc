"""Table sources and sinks. All paths are Spark paths; nothing is opened on the driver but small reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sheets import read_xlsx

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a glob pattern that Spark has written in full, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "tolerant") -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped and a missing path is an empty table.

    mode: tolerant drops torn lines, strict raises when one is met.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", {"tolerant": "DROPMALFORMED", "strict": "FAILFAST"}[mode]).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Atomic by Spark's commit protocol; an empty table is valid. mode append adds files."""
    df.write.mode(mode).json(path)


def read_table(spark: SparkSession, path: str, keep: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A sheet as CSV, or as xlsx by its ending: required columns are checked, `keep` (column=value) filters, texts are trimmed, nulls and repeats go."""
    if path.lower().endswith(".xlsx"):
        df = read_xlsx(spark, path)
    else:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if keep:
        col, value = keep.split("=", 1)
        df = df.filter(F.trim(F.col(f"`{col}`")) == value)
    df = df.select(*[F.regexp_replace(F.col(f"`{c}`"), r"(?U)^\s+|\s+$", "").alias(c) for c in df.columns])
    return df.dropna(subset=list(required) or None).dropDuplicates(list(required) or None)


def fingerprint(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """path, bytes, sha256, n_rows (lines) of each file below a path.

    Spark lists the files; a task reads its files in chunks, so that one of any size is never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                fs, at = pa.fs.FileSystem.from_uri(name)
                h, lines, last = hashlib.sha256(), 0, b"\n"
                with fs.open_input_stream(at) as data:
                    while part := data.read(chunk):
                        h.update(part)
                        lines, last = lines + part.count(b"\n"), part[-1:]
                yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([h.hexdigest()]), pa.array([lines + (last != b"\n")], pa.int64())], names=["path", "bytes", "sha256", "n_rows"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.mapInArrow(run, "path string, bytes long, sha256 string, n_rows long")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and a hash that doesn't depend on their order."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("fingerprint"))


def metrics_from_report(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row of numbers that patterns (with one group) find in a text file; a pattern without a match raises."""
    text = spark.read.text(path, wholetext=True)
    found = {k: F.regexp_extract("value", p, 1) for k, p in patterns.items()}
    out = text.select(*[F.when(v != "", v.try_cast("double")).otherwise(F.raise_error(F.lit(f"metric not found: {k}")).cast("double")).alias(k) for k, v in found.items()])
    return out


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path with the largest number behind `checkpoint-`."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1).try_cast("long")
    return paths.withColumn("step", step).filter(F.col("step").isNotNull()).agg(F.max_by(path, "step").alias("path"), F.max("step").alias("step"))


def training_log(states: DataFrame, log: str = "log_history") -> DataFrame:
    """(key, step, value) of an array of maps; values that aren't numbers go, an absent step is the entry's index."""
    rows = states.select(F.posexplode(log).alias("idx", "entry"))
    step = F.coalesce(F.col("entry")["step"].try_cast("long"), F.col("idx").cast("long"))
    pairs = rows.select(step.alias("step"), F.explode("entry").alias("key", "raw"))
    return pairs.filter(F.col("key") != "step").select("key", "step", F.col("raw").try_cast("double").alias("value")).filter(F.col("value").isNotNull())


def downsample(df: DataFrame, order: str, value: str, points: int = 60, levels: int = 8) -> DataFrame:
    """Evenly spaced points of a series in the order of a number, as levels between its least and largest value."""
    from ..operators.ranking import BUCKET_DIGITS, global_rank

    seen = df.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    every, lo = max(1, -(-seen["n"] // points)), float(seen["lo"] or 0)
    width = max((float(seen["hi"] or 0) - lo) / 16**BUCKET_DIGITS, 1e-300)
    bucket = F.coalesce(F.floor((F.col(order).cast("double") - lo) / width), F.lit(-1))  # rows without a place come first
    kept = global_rank(df, [F.col(order)], bucket, "i").filter((F.col("i") - 1) % every == 0)
    ends = kept.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    unit = F.try_divide(F.col(value) - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return kept.crossJoin(F.broadcast(ends)).select(order, value, F.least(F.lit(levels - 1), F.floor(F.coalesce(unit, F.lit(0.0)) * levels)).cast("int").alias("level"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; one of more than `limit` rows raises."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join(["---"] * len(df.columns)) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
