"""The whole job: inputs on which a cut would change the result, against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer import plans
from assayer.functions import patterns, rules, vectors
from assayer.operators import joins, ranking


def most(s, n):
    return max(Counter(s[i : i + n] for i in range(len(s) - n + 1)).values(), default=0)


def long_texts():
    plain = " ".join(f"w{i}x{i * i % 977}" for i in range(700))
    late = plain + " " + "what is repeated here comes late; " * 6
    return [None, "", "a", "short text", plain, late, late + late, "é😀 " * 1500]


@pytest.fixture(scope="module")
def late_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("late"))
    rows = [(i, t) for i, t in enumerate(long_texts())]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_ngram_measures_take_the_whole_text(spark, late_dir):
    got = {r.doc_id: r for r in plans.queries()["ngram_stats"](spark, late_dir).collect()}
    penalty = {r.doc_id: r.repeat_penalty for r in plans.queries()["repeat_penalty"](spark, late_dir).collect()}
    for i, t in enumerate(long_texts()):
        s = re.sub(r"\s+", "", t or "")
        two = [s[k : k + 2] for k in range(len(s) - 1)]
        assert got[i].compact_len == len(s) and got[i].max_8gram == most(s, 8)
        assert got[i].distinct2 == pytest.approx(len(set(two)) / max(1, len(two)), abs=1e-6)
        want = 0.0 if len(s) < 80 else min(0.8, sum(w for n, times, w in ((8, 5, 0.35), (12, 4, 0.35), (20, 3, 0.25)) if most(s, n) >= times))
        assert penalty[i] == pytest.approx(want, abs=1e-6)
    assert got[5].max_8gram >= 6 and penalty[5] > penalty[4] == 0.0  # all repeats are behind character 3000


def test_degeneration_takes_the_whole_text(spark, late_dir):
    got = {r.doc_id: r for r in plans.queries()["degeneration"](spark, late_dir).collect()}
    assert got[4].max_sentence == 1 and got[5].extreme and got[5].max_sentence >= 5


def test_series_is_sampled_to_its_end(spark, tmp_path):
    rows = [(i * 3, float(i)) for i in range(5000)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in plans.queries()["downsampled_series"](spark, str(tmp_path)).collect())
    every = -(-5000 // 60)
    kept = rows[::every]
    top = kept[-1][1]
    assert got == [(k, v, min(7, int(v / top * 8))) for k, v in kept]


def test_gram_containment_of_documents(spark, tmp_path):
    import random

    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    items = [(i, say(rng.randint(3, 80))) for i in range(12)] + [(20, None), (21, "abc")]
    docs = [(i, say(rng.randint(0, 400)) + rng.choice(items[:12])[1][: rng.randint(5, 80)] if i % 3 else say(rng.randint(0, 30))) for i in range(40)]
    docs += [(None, "x" * 4000 + items[0][1]), (99, docs[1][1]), (100, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = lambda t: (lambda s: {s[i : i + 5] for i in range(len(s) - 4)})(re.sub(r"\s+", "", t or ""))
    want = []
    for d, t in docs:
        for i, u in items:
            a, b = grams(t), grams(u)
            if a and b and len(a & b) >= 0.2 * min(len(a), len(b)):
                want.append((d, i, len(a & b)))
    got = [tuple(r) for r in plans.queries()["gram_containment_documents"](spark, str(tmp_path)).collect()]
    assert want and any(d is None for d, _, _ in want)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_duplicates_miss_nothing(spark):
    import difflib
    import random

    rng = random.Random(12)

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 5))):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", " "])
        return "".join(t)

    held = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in [1, 2, 3, 4, 5, 7, 9, 12, 14, 20, 24, 30, 60, 150, 260, 700]] + ["", None]
    rows = [(i, changed(t or "")) for i, t in enumerate(held * 25)] + [(None, held[5]), (1000, None), (1001, "abcXefg"), (1002, "z" * 3100 + held[12])]
    held += ["abcdefg", "z" * 3100 + held[13]]
    a, b = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(t,) for t in held], "held string")
    got = sorted((r.id if r.id is not None else -1) for r in joins.near_duplicates(a, b, "text", "held").collect())
    want = sorted((i if i is not None else -1) for i, t in rows if t and any(k and difflib.SequenceMatcher(None, k, t).ratio() >= 0.85 for k in held))
    assert got == want and 1001 in got and -1 in got


def test_sum_before_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", 5)
    rows = [(k, float(v) if v else None, n) for k in ("a", "b") for v, n in ((0, 2), (1, 1), (2.5, 4), (3, 1), (9, 7), (100, 1), (1e9, 3))]
    got = ranking.sum_before(spark.createDataFrame(rows, "k string, v double, n long"), "v", "n", "before", ["k"]).collect()
    assert {(r.k, r.v): r.before for r in got} == {(k, v): sum(m for j, w, m in rows if j == k and (w or 0) < (v or 0)) for k, v, _ in rows}


def test_best_cosine_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100)
    v = np.random.default_rng(1).normal(size=(60, 4))
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 4), (61, None)]
    got = {r.id: r.best for r in vectors.best_cosine(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), F.col("id") % 5 == 0, "id", "v").collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    near = unit @ unit.T
    np.fill_diagonal(near, -1)
    assert {k: pytest.approx(near[k].max()) for k in range(0, 60, 5)} == got


def test_unicode_classes_agree_with_python(spark):
    import random

    rng = random.Random(3)
    parts = ["\u3000政策依据：甲", "政策依据:", "\n", "问题１：", "问题 12 ：", "问答对\u3000３", "回答\u00a0:", "《税法》第１条", "《乙》", "《丙表》", "，", "。", "按照", "财税〔２０２０〕 12 号", "<IMG src", "x.PNG", "其他"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.has_rag_style(F.col("t")).alias("flag")).collect()
    differ = [(r.t, r.flag) for r in rows if r.flag != bool(list(rules.RagSpans().eval(r.t)))]
    assert not differ and {True, False} == {r.flag for r in rows}


def test_listed_documents():
    think = "《甲法》、《乙法》、《丙法》。按照《丁法》处理。"
    own = [s for s in rules.RagSpans().eval(think) if s[3] == patterns.RAG_LIST_CLASS]
    assert [s[2] for s in own] == ["《甲法》", "《乙法》", "《丙法》"] and all(think[b:e] == t for b, e, t, _ in own)
    assert [s[2] for s in rules.RagSpans().eval("政策依据：")] == ["政策依据："]
