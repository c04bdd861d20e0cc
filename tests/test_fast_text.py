"""Cheaper ways to the same masks, normal forms and counts, and products of bounded size."""

import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import patterns as P
from assayer.functions import text as X
from assayer.functions import vectors


def test_normal_form_skips_latin_text(spark):
    """The pattern tells at once that ASCII and Latin-1 letters are normal; all else is as before."""
    assert X._MAY_CHANGE in X.normal(F.col("t"))._jc.toString()
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1100, 0x1200), *range(0x3000, 0x3100), *range(0xFF00, 0x10000), 0x1D11E, 0x1D400, 0x2F800, 0x2FA1D]]
    assert all(unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c)) for c in [*range(0xA0), *range(0xC0, 0x100)])
    rows = spark.createDataFrame([(a + b,) for a in letters[::3] + letters[-4:] for b in ("", "e", "́", "ﬁ")], "t string").select("t", X.normal("t").alias("n")).collect()
    assert [r.n for r in rows] == [unicodedata.normalize("NFKC", r.t) for r in rows]


def test_masks_agree_with_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["财税〔2020〕12号", "财税 公告", "《中华人民共和国税法》第3条", "《", "固定资产", "固定资产—办公楼", "研发费用加计扣除", "plain text", " ", "。", "2020年1月", "5%", "A10000", "公告2019年第1号", "号", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [*X.MASKS, *[p for p, _ in X.DEGENERATION_STEPS]]:
        rows = df.select(X._replaced(F.col("t"), pattern, "□").alias("a"), F.regexp_replace("t", "(?U)" + pattern, "□").alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
    assert P.DOC_TOKEN_FROZEN in X.MASKS and P.ACCOUNT_TERM in X.MASKS


def test_gram_counts_are_one_arrow_stage(spark):
    """repeat_penalty, distinct2 and the measure of degeneration build no arrays of grams in the engine."""
    df = spark.createDataFrame([("ab" * 60,), ("a b",), ("",), (None,), ("x" * 79,), ("x" * 80,)], "t string")
    for c in (X.repeat_penalty("t"), X.distinct2("t"), X.degeneration(F.col("t"))["max_8gram"], X.gram_overlap(F.col("t"), F.col("t"))):
        plan = df.select(c.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert "array_join" not in plan and "ArrowEvalPython" in plan
    assert [r.p for r in df.select(X.repeat_penalty("t").alias("p")).collect()] == [0.8, 0.0, 0.0, 0.0, 0.0, 0.8]
    assert [r.d for r in df.select(X.distinct2("t").alias("d")).collect()] == pytest.approx([2 / 119, 1.0, 0.0, 0.0, 1 / 78, 1 / 79])


def test_best_cosine_holds_one_tile(monkeypatch):
    """Many queries against a batch: never more similarities at once than a tile, with the same best ones."""
    import pyarrow as pa

    monkeypatch.setattr(vectors, "TILE", 1000)
    rng = np.random.default_rng(1)
    queries, rows = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(500, 4)), rng.normal(size=(300, 4))))
    tallest = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            tallest.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ other

    shared = type("", (), {"value": (np.arange(500), queries.view(Watched))})
    batch = pa.record_batch([pa.array(np.arange(300)), pa.array(rows.tolist())], names=["k", "v"])
    out = next(vectors._searcher(shared)(iter([batch])))
    near = queries @ rows.T
    near[np.arange(300), np.arange(300)] = -np.inf
    assert max(tallest) <= 1000 and np.allclose(out.column("best").to_numpy(), near.max(axis=1)) and sys.getsizeof(out)


def test_pages_come_in_bounded_batches(spark, tmp_path):
    """html_paragraphs parses at most 1,024 pages or 4 MB at once, however many a partition has."""
    from assayer import plans
    from assayer.sources import html

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = [(i, f"<p>page {i}</p>") for i in range(3000)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = plans.queries()["html_paragraphs"](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"
    assert {r.page_id: r.n_chars for r in out.collect()} == {i: len(html.paragraphs_of(t)) for i, t in pages}
