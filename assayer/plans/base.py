"""Registry of queries, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPS: dict[str, str] = {}


def query(ops: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, which must be new, with the operators that it covers."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"a query is named {f.__name__} already")
        QUERIES[f.__name__], OPS[f.__name__] = f, ops
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


INDEX = ["ln", "pk", "sk"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as K candidates of a query: qid, index (ln, pk, sk), score, pen, qty, tax, flag, status."""
    names = {"l_orderkey": "qid", "l_linenumber": "ln", "l_partkey": "pk", "l_suppkey": "sk", "l_extendedprice": "score", "l_discount": "pen", "l_quantity": "qty", "l_tax": "tax", "l_returnflag": "flag", "l_linestatus": "status"}
    return table(spark, sf_dir, "lineitem").select(*[F.col(a).alias(b) for a, b in names.items()])


C = "c AS (SELECT l_orderkey AS qid, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS score, l_discount AS pen, l_quantity AS qty, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"


def r6(c: Column) -> Column:
    """Six places: sums of doubles depend on the order of their terms."""
    return F.round(c.cast("double"), 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
