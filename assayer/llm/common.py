"""What the operators of this folder share: tables, shared storage, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Bounds of an Arrow batch for Python stages over whole texts.
TEXT_ROWS_PER_BATCH = 1024
TEXT_BYTES_PER_BATCH = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def set_apart(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but `own` under names (in_0, in_1, ...) that clash with no operator's, and the name of each column there."""
    names = {c: c if c in own else f"in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named_back(names: dict[str, str], *but: str) -> list[Column]:
    """The columns of set_apart in their order and under their own names, without `but`."""
    return [F.col(v).alias(c) for c, v in names.items() if c not in but]


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS_PER_BATCH) -> None:
    """Bound the Arrow batches that Python stages of this session get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES_PER_BATCH))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage as checkpoint() does: a lost executor costs nothing that
    came before, and each consumer reads only the columns that it needs.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
