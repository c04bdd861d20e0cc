"""The toxicity grammar, its lexicon, the choice by folds and the fit against plain versions of them."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import decontaminate
from assayer.llm import toxicity as T

NEGATIONS, REPORTS, TARGETS, THREATS = ({*w.split()} for w in (T.NEGATIONS, T.REPORTS, T.TARGETS, T.THREATS))


def brute_features(text, weights):
    """Every insult or threat by what stands around it in its clause."""
    out = np.zeros(8)
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        tokens = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]", clause)
        for i, token in enumerate(tokens):
            own = max([weights.get("=" + token, 0)] + [weights.get("^" + token[:n], 0) for n in (3, 4, 5, 6) if len(token) > n])
            threat = own <= 0 and token in THREATS
            if own <= 0 and not threat:
                continue
            said = lambda words, some: any(t in words and not insult(t, weights) for t in some)
            if said(REPORTS, tokens[:i]) or sum(t in "\"“”«»" for t in tokens[:i]) % 2:
                reading = 3
            elif said(NEGATIONS, tokens[max(0, i - 3) : i]):
                reading = 2
            elif said(TARGETS, tokens[max(0, i - 4) : i]) or said(TARGETS, tokens[i + 1 : i + 4]):
                reading = 1
            else:
                reading = 0
            out[reading + 4 * threat] += min(1.0, (1.0 if threat else own) / T.LOG_ODDS)
    return np.minimum(out, 3.0)


def insult(t, weights):
    return max([weights.get("=" + t, 0)] + [weights.get("^" + t[:n], 0) for n in (3, 4, 5, 6) if len(t) > n]) > 0


def test_features_against_brute_force():
    rng = random.Random(1)
    weights = {"=grob": 5.0, "^snar": 4.4, "=you": 4.1, "^abcdef": 9.0, "=zu": 2.0}
    lexicon = T.Lexicon(weights)
    words = ["grob", "snark", "snarling", "snar", "zu", "kill", "töten", "you", "he", "not", "isn't", "nie", "said", "sagte", '"', "“", "tree", "house", "12", "a_b", "abcdefg", ".", "!", "\n", ",", "KILL", "Grob"]
    for _ in range(800):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert lexicon.features(text) == pytest.approx(brute_features(text, weights)), text
    assert not lexicon.features(None).any() and not lexicon.features("").any()
    long = "tree " * 100_000 + "grob"
    assert lexicon.features(long) == pytest.approx(brute_features(long, weights))


def sample(n=240, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(40)]
        if toxic and rng.random() < 0.9:
            words.insert(rng.randint(0, 40), rng.choice(["zorkish", "zorker", "vilmost", "vilmost"]))
        out.append((" ".join(words), int(toxic)))
    return out + out[:4]


def brute_lexicon(rows, chance):
    """rows: (h, text, toxic), one for each text."""
    toxic = T.one_of_near_copies([(h, T.marks(t)) for h, t, y in rows if y])
    n_pos, n_neg = len(toxic), sum(not y for _, _, y in rows)
    pos = Counter(f for h, t, y in rows if y and h in toxic for f in T.word_features(t))
    neg = Counter(f for h, t, y in rows if not y for f in T.word_features(t))
    least = max(4, math.ceil(math.log(chance) / math.log(n_pos / (n_pos + n_neg))))
    odds = {f: math.log((k + 0.1) / n_pos) - math.log((neg[f] + 0.1) / n_neg) for f, k in pos.items() if k >= least}
    found = {f: (pos[f], o) for f, o in odds.items() if o >= T.LOG_ODDS}
    covered = lambda f: f[0] == "^" and any(g != f and g[1:].startswith(f[1:]) and len(g) > len(f) - (g[0] == "=") and k >= pos[f] * T.SAME_SUPPORT and len(f) - 1 in T.PREFIXES for g, (k, _) in found.items())
    return {f: o for f, (_, o) in found.items() if not covered(f)}


def test_lexicon_and_choice_against_brute_force(spark):
    rows = sorted({(hashlib.md5(t.encode()).hexdigest(), t, y) for t, y in sample()})
    df = spark.createDataFrame(rows, "h string, text string, toxic int")
    for chance in T.CHANCES:
        got, want = T.fit_lexicon(df, chance), brute_lexicon(rows, chance)
        assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f]) for f in got)
        assert any(f.endswith("vilmost") for f in got)
    totals = [0.0] * len(T.CHANCES)
    for fold in range(T.FOLDS):
        own = lambda r: int(r[0][:8], 16) % T.FOLDS == fold  # noqa: E731, B023
        known, asked = [r for r in rows if not own(r)], [r for r in rows if own(r)]
        for k, chance in enumerate(T.CHANCES):
            lexicon = T.Lexicon(brute_lexicon(known, chance))
            w = T.fit_weights(np.array([lexicon.features(t) for _, t, _ in known]), np.array([float(y) for _, _, y in known]))
            for _, t, y in asked:
                p = 1 / (1 + math.exp(-max(-30, min(30, w[0] + w[1:] @ lexicon.features(t)))))
                totals[k] -= math.log(max(1e-9, p if y else 1 - p))
    assert [sum(x) for x in zip(*(T.losses(rows, f) for f in range(T.FOLDS)), strict=True)] == pytest.approx(totals)
    assert T.choose_chance(df) == min(zip(totals, T.CHANCES, strict=True))[1]


def test_weights_are_where_the_gradient_vanishes():
    rng = np.random.default_rng(3)
    x, y = rng.random((200, 8)), (rng.random(200) < 0.3).astype(float)
    w = T.fit_weights(x, y)
    one = np.hstack([np.ones((200, 1)), x])
    gradient = one.T @ (y - 1 / (1 + np.exp(-one @ w))) - 10 * T.PRIOR_STRENGTH * (w - T.PRIOR)
    assert np.abs(gradient).max() < 1e-4


def test_model_of_little(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 1)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert model[0] == {} and all(0 <= r.score <= 1 for r in T.score(docs, model).collect())
    assert T.score(docs.limit(0), model).count() == 0


def test_one_block_is_broadcast_at_a_time(spark, monkeypatch):
    """Each plan of a block of anchors has one broadcast, and the next is made only when its matches are written."""
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 2)
    plans, matches = [], decontaminate.matches

    def seen(docs, block):
        out = matches(docs, block)
        plans.append(out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin"))
        return out

    monkeypatch.setattr(decontaminate, "matches", seen)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(["ab", "cd", "xy", "bc", "yz", "qq"])], "item_id long, text string")
    got = {r.doc_id: r.n_items for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: 3, 2: 2} and len(plans) > 2 and set(plans) == {1}
