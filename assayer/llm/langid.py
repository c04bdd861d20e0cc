"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 4-grams per language on a bounded, deterministic sample
of the labelled rows; the smoothed log-probability matrix (2**HASH_BITS x languages)
is broadcast once, and scoring is sparse in numpy: each n-gram of a text picks its row
of the matrix and the rows are summed per text.

Text is lower-cased, every run of non-letters counts as one blank, and grams of blanks
alone are not counted.

Defined results: null texts and texts without a letter get `und` with score 0; without
any training row all texts get `und`; repeated rows give repeated results; ties go to
the language that sorts first; rows without a language are not learned from. Columns of
the input beside the text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import small_batches

HASH_BITS = 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Bound of the training sample: so many rows of each language are expected to be drawn.
ROWS_PER_LANGUAGE = 4000
#: Code points that are hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Grams of a batch that are scored at once.
GRAMS = 1 << 19
#: Languages that may be learned: with as many the broadcast matrix has 256 MB.
MOST_LANGUAGES = 1000


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, order by order and piece by piece."""
    p = chars.points(text)
    p = chars.lowered()[p]
    letter = chars.classes()[p] == chars.LETTER
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of non-letters
    p = np.where(letter, p, np.uint32(32))[keep]
    p = np.concatenate([np.array([32], np.uint32), p, np.array([32], np.uint32)]).astype(np.uint64)
    blank = p == 32
    for start in range(0, len(p), PIECE):
        yield from _grams(p[start : start + PIECE + max(ORDERS) - 1], blank[start : start + PIECE + max(ORDERS) - 1], min(PIECE, len(p) - start))


def _grams(p: np.ndarray, blank: np.ndarray, n: int) -> Iterator[np.ndarray]:
    h = np.zeros(len(p), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        m = len(p) - order + 1
        if m <= 0:
            return
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) + p[order - 1 :] + np.uint64(order)
        if order in ORDERS:
            own = h[: min(m, n)]
            if order == 1:
                own = own[~blank[: len(own)]]
            yield ((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(1 << HASH_BITS, np.int64))
            for h in grams(text or ""):
                own += np.bincount(h, minlength=1 << HASH_BITS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "gram", "n"])


def sample(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of each language, drawn by a hash of the text and (where there is one) doc_id: the same rows on every run."""
    drawn = F.pmod(F.xxhash64("text", *[c for c in ("doc_id",) if c in df.columns], F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = {r["lang"]: min(1.0, rows / r["n"]) for r in df.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(share) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if all(v >= 1 for v in share.values()):
        return df
    keep = F.lit(False)
    for lang, v in share.items():
        keep = keep | ((F.col("lang") == lang) & (drawn < v))
    return df.filter(keep)


def fit(df: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix from columns text and lang.

    The sample is bounded by `rows_per_language` rows (in expectation) per language.
    """
    small_batches(df.sparkSession)
    known = df.select("text", "lang", *[c for c in ("doc_id",) if c in df.columns]).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = sample(known, rows_per_language).select("text", "lang").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    m = np.full((len(langs), 1 << HASH_BITS), SMOOTHING)
    if len(langs):
        m[np.searchsorted(langs, counted["lang"]), counted["gram"]] += counted["n"]
    return langs, np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32)


def score_texts(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], list[float]]:
    """Prediction and posterior of each text; prior uniform over the languages.

    A batch is a sparse matrix of texts by grams: the grams' rows of the matrix are picked for GRAMS grams at a time,
    summed by text between its bounds, and added to what a text that goes on has so far.
    """
    total = np.zeros((len(texts), len(langs)))
    seen = np.zeros(len(texts), np.int64)
    rows = np.ascontiguousarray(logp.T)
    held: list[np.ndarray] = []
    of: list[int] = []

    def add() -> None:
        n = np.array([len(h) for h in held])
        np.add.at(total, of, np.add.reduceat(rows[np.concatenate(held)], np.cumsum(n) - n, axis=0, dtype=np.float64))
        held.clear()
        of.clear()

    size = 0
    for i, text in enumerate(texts) if len(langs) else ():
        for h in grams(text or ""):
            if len(h):
                held.append(h)
                of.append(i)
                seen[i] += len(h)
                size += len(h)
            if size >= GRAMS:
                add()
                size = 0
    if held:
        add()
    if not len(langs):
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    prob = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
    return [langs[k] if n else "und" for k, n in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen > 0, prob, 0.0).tolist()


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """doc_id (and `keep` columns), lang_pred, score; the matrix (at most 2**HASH_BITS x languages floats) is broadcast."""
    spark = df.sparkSession
    small_batches(spark)
    langs, logp = model
    shared = spark.sparkContext.broadcast((langs, logp))
    df = df.select("doc_id", *(keep or []), F.col(text).alias("__text"))
    names = [c for c in df.columns if c != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text") + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_langs, own = shared.value
        for b in batches:
            pred, prob = score_texts(b.column("__text").to_pylist(), own_langs, own)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(prob, pa.float64())], names=[*names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
