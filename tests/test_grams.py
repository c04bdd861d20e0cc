"""Grams as numbers against plain Python, and what rests on them."""

import random
from collections import Counter

import pytest

from assayer.functions import grams as G
from assayer.operators import joins as J

LETTERS = ["ab", "abcdefgh ", "é😀𝔘a", "".join(map(chr, range(0x4E00, 0x6000)))]


def say(rng, most=60):
    letters = rng.choice(LETTERS)
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def of(text, n):
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


@pytest.mark.parametrize("most", [G.MOST, 1 << 24])
def test_repeats_and_shared_grams(monkeypatch, most):
    """Also where prefixes are numbered anew, as they are for large alphabets and long grams."""
    monkeypatch.setattr(G, "MOST", most)
    rng = random.Random(1)
    texts = [say(rng) for _ in range(60)] + ["", "a"]
    for t in texts:
        assert G.repeats(t, [1, 2, 5, 20]) == [(sum(of(t, n).values()), len(of(t, n)), max(of(t, n).values(), default=0)) for n in (1, 2, 5, 20)]
    for n in (1, 2, 5, 8):
        index = G.Index(texts, n)
        assert index.sizes.tolist() == [len(of(t, n)) for t in texts]
        for t in [say(rng) for _ in range(40)] + texts[:20]:
            assert index.shared(G.points(t)).tolist() == [len(of(t, n) & of(u, n)) for u in texts]
            assert index.shared(G.points(t), repeated=True).tolist() == [sum((of(t, n) & of(u, n)).values()) for u in texts]
    assert G.Index([], 5).shared(G.points("abcdef")).tolist() == []


@pytest.mark.parametrize("swapped", [False, True])
def test_gram_containment_makes_no_rows_but_results(spark, monkeypatch, swapped):
    """Whichever side is the smaller, in one block or in many; no gram and no candidate is a row, and nothing is shuffled."""
    rng = random.Random(2)
    items = [(f"i{k}", "".join(rng.choice("abcd ") for _ in range(40))) for k in range(30)] + [(None, "abcdabcd"), ("same", "abcdabcd"), ("short", "ab c"), ("null", None)]
    docs = [(k, "".join(rng.choice("abcd\n") for _ in range(200)) + (rng.choice(items)[1] or "")) for k in range(30)] + [(None, items[0][1]), (99, None)]
    a, b = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item string, text string")
    grams = lambda t: set(of("".join((t or "").split()), 5))
    want = [(d, i, len(grams(t) & grams(u))) for d, t in docs for i, u in items if grams(t) & grams(u) and len(grams(t) & grams(u)) >= 0.2 * min(len(grams(t)), len(grams(u)))]
    for size in (2 << 20, 300):
        monkeypatch.setattr(J, "BLOCK_BYTES", size)
        got = J.gram_containment(b, a, "item", "doc") if swapped else J.gram_containment(a, b, "doc", "item")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        assert sorted(((r.doc, r.item, r.shared) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert len(want) > 100 and any(d is None for d, _, _ in want) and any(i is None for _, i, _ in want)
