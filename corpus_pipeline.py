"""The corpus pipeline: toxicity, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of their documents, whatever they are; a stage needs doc_id and text, and
sets n_chars where there is one.

Defined results: rows with a null id are rows like others; rows that share an id but
not a text are different documents; null and empty texts are clean and have no tokens,
and of several one of each kind of emptiness stays, as of other copies; no row goes but
for what its stage found; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, nearcopies, pii, toxicity
from assayer.llm.common import load, named_back, set_apart
from assayer.llm.queries import fold, vocabulary
from assayer.sources.shared import shared_path

#: Documents that score at least this much are rejected.
TOXIC_FROM = 0.7
#: Words of a shingle, and share of common shingles from which documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below TOXIC_FROM; the model learns from the labels of all folds but one."""
    docs, names = set_apart(docs, "doc_id", "text")
    model = toxicity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"), F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC_FROM).select(*named_back(names))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return nearcopies.near_copies(docs, shingle=SHINGLE, similarity=SIMILARITY).filter("stays").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data give way to the name of their kind in brackets."""
    docs, names = set_apart(docs, "doc_id", "text")
    found = pii.redact(pii.with_spans(docs))
    if "n_chars" in names:
        own = F.col(names["n_chars"])
        found = found.withColumn(names["n_chars"], F.when(F.size("pii_spans") > 0, F.length("text").cast(docs.schema[names["n_chars"]].dataType)).otherwise(own))
    return found.select(*named_back(names))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their number, and hashes of the ids and of what they decode to."""
    return bpe.encode(docs, vocabulary(), tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: No stage but the leaks and the personal data can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
