"""NFKC of all code points and of sequences, against Python's."""

import random
import re
import unicodedata

from assayer.functions import text as X

POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def test_all_code_points(spark):
    texts = ["a" + chr(c) + "b" for c in POINTS if c]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    wrong = [r.i for r in df.select("i", X.normal("t").alias("n")).toLocalIterator() if r.n != unicodedata.normalize("NFKC", texts[r.i])]
    assert wrong == []


def test_sequences(spark):
    rng = random.Random(1)
    marked = [chr(c) for c in POINTS if unicodedata.combining(chr(c)) or 0x1100 <= c < 0x1200 or 0xAC00 <= c < 0xAC80 or 0x900 <= c < 0xE00]
    texts = ["".join(rng.choice(marked if rng.random() < 0.6 else "aeéoü가각") for _ in range(rng.randint(0, 8))) for _ in range(20_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.i for r in df.select("i", X.normal("t").alias("n")).collect() if r.n != unicodedata.normalize("NFKC", texts[r.i])] == []


def test_common_texts_stay_in_the_engine():
    quick = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), X.not_normal()))
    for t in ("plain ASCII, 12.5 %", "Übergrößenträger déjà señor œuvre Łódź", "税务机关应当依法征收", "Привет, мир", "日本語のテキスト"):
        assert not quick.search(t), t
    for t in ("Ａ", "ﬁ", "e\u0301", "①", "㎏", "\u00a0"):
        assert quick.search(t), t


def test_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("ﬁ" * 50_000,)], "t string")
    assert [r.n for r in df.select(X.normal("t").alias("n")).collect()] == ["", "", "fi" * 50_000]
