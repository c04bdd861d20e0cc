"""Common runs, subsequences and the fuzzy anti join against difflib and brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import similarity as S
from assayer.operators import joins as J


def texts(rng, n, most=40):
    for _ in range(n):
        letters = rng.choice(["ab", "abc", "abcdefgh", "é😀𝔘a", "aaaab"])
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def test_automaton_agrees_with_difflib():
    rng = random.Random(1)
    for a, b in zip(texts(rng, 1500), texts(random.Random(2), 1500), strict=True):
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        found = m.find_longest_match(0, len(a), 0, len(b))
        assert S.common_run(a, b) == found.size
        if found.size:
            assert S.Automaton(b).longest(a) == (found.a, found.b, found.size)
        assert S.ratio(a, b) == pytest.approx(m.ratio(), abs=1e-12)


def test_subsequence_bounds_the_ratio():
    rng = random.Random(3)
    for a, b in zip(texts(rng, 300), texts(random.Random(4), 300), strict=True):
        rows = [0] * (len(b) + 1)
        for c in a:
            above = rows[:]
            for j, d in enumerate(b):
                rows[j + 1] = above[j] + 1 if c == d else max(rows[j], above[j + 1])
        assert S.subsequence(len(a), S.places(a), b) == rows[-1]
        for autojunk in (True, False):
            assert difflib.SequenceMatcher(None, a, b, autojunk).ratio() * (len(a) + len(b)) <= 2 * rows[-1] + 1e-9


def test_subsequence_stops_early():
    a, b = "ab" * 2000, "cd" * 2000 + "ab"
    assert S.subsequence(len(a), S.places(a), b, 3900) < 3900
    assert S.subsequence(len(a), S.places(a), a, len(a)) == len(a)


@pytest.mark.parametrize("hot", [J.HOT_GRAM, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, hot):
    """Near copies by cuts, swaps and insertions at many lengths, also where a gram is dealt out over parts."""
    monkeypatch.setattr(J, "HOT_GRAM", hot)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "x", "né"]) for _ in range(n))
    held = [say(n) for n in (1, 2, 3, 5, 8, 13, 21, 34, 60, 90)] + ["a", "ab", "z" * 250, "", None]
    asked = []
    for t in held:
        t = t or ""
        for share in (0, 0.05, 0.12, 0.2, 0.25, 0.3, 0.4):
            cut = int(len(t) * share)
            at = rng.randint(0, max(0, len(t) - cut))
            asked += [t[:at] + t[at + cut :], t[:at] + say(1) * max(0, cut // 5) + t[at:], t[at:] + t[:at]]
    asked = [*asked, None, "entirely different words here"]
    a = spark.createDataFrame(list(enumerate(asked)), "id int, text string").withColumn("class", F.lit("clash")).withColumn("gram", F.lit(1)).withColumn("n", F.lit(2))
    b = spark.createDataFrame([(t,) for t in held], "held string").withColumn("c", F.lit(0))
    got = {r.id for r in J.near_duplicates(a, b, "text", "held").collect()}
    want = {i for i, t in enumerate(asked) if t and any(h and difflib.SequenceMatcher(None, h, t).ratio() >= 0.85 for h in held)}
    assert got == want and 20 < len(want) < len(asked) - 20


def test_blocks_of_long_texts_begin_at_rare_characters():
    """difflib finds no more blocks than that, which is what lets long grams be asked for; and no near text is missed."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("eeeeetttaaoin    shrdlucmfwypvbgk.,TAS") for _ in range(n))
    texts = [say(rng.choice([90, 190, 199, 200, 260, 420, 900])) for _ in range(40)]
    asked = []
    for t in texts * 3:
        cut, at = rng.randint(0, len(t) // 4), rng.randrange(len(t))
        asked.append("".join(c for c in t if rng.random() > 0.02) if rng.random() < 0.5 else t[:at] + say(cut // 2) + t[at + cut :])
    block = S.Block(texts, 0.85)
    assert [S.most_blocks("ab" * k) for k in (1, 99, 100)] == [None, None, 1]
    counted = 0
    for t in asked:
        want = [k for k in block.texts if difflib.SequenceMatcher(None, k, t).ratio() >= 0.85]
        found = [block.texts[k] for k in block.candidates(t)]
        assert set(want) <= set(found) and block.has_near(t) == bool(want)
        assert len(found) < 5
        counted += len(want)
        for k in texts[:6]:
            if (most := S.most_blocks(t)) is not None:
                assert len(difflib.SequenceMatcher(None, k, t).get_matching_blocks()) - 1 <= most
    assert counted > 40


def test_keys_at_the_edge_of_the_lengths_are_all_looked_at():
    """Of several keys of the longest length that can reach the ratio only the first was."""
    text = "abcdefghijklmnopq"
    keys = ["zzzzzz" + "yyyyyyyyyyyyyyyyy", text + "rstuvw"]
    assert difflib.SequenceMatcher(None, keys[1], text).ratio() == 0.85
    block = S.Block(keys, 0.85)
    assert block.has_near(text) and block.near([text]).tolist() == [True]


@pytest.mark.parametrize("letters", ["ab", "eeeeetttaaoin    shrdlucmfwypvbgk.,TAS", "é😀𝔘a中文字", "".join(map(chr, range(0x4E00, 0x5100)))])
def test_near_agrees_with_difflib(letters, monkeypatch):
    """Bands of one and several words, matrix products and single texts; in tiles, and alone."""
    rng = random.Random(len(letters))
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    keys = [say(rng.randint(1, most)) for most in (9, 60, 180, 260, 600, 1300) for _ in range(12)]
    asked = [say(rng.randint(0, 300)) for _ in range(10)]
    for t in keys:
        share, at = rng.random() * 0.25, rng.randrange(len(t))
        asked += ["".join(c for c in t if rng.random() > share), t[:at] + say(len(t) // 12) + t[at + len(t) // 8 :]]
    want = [any(difflib.SequenceMatcher(None, k, t).ratio() >= 0.85 for k in keys) if t else False for t in asked]
    assert S.Block(keys, 0.85).near(asked).tolist() == want and 20 < sum(want) < len(asked) - 10
    monkeypatch.setattr(S.Block, "APART", 60)
    monkeypatch.setattr(S.Block, "FEWEST", 64)  # hardly any place is free, so pairs are left to the second look
    monkeypatch.setattr(S.Block, "WIDE", 0.1)
    assert S.Block(keys, 0.85).near(asked).tolist() == want


def test_prose_is_decided_in_tiles(monkeypatch):
    """No text is looked up on its own, and few pairs are compared one by one."""
    rng = random.Random(8)
    syllables = "th in er on the and tion ing re ly at st wh ea nd ou sh ha".split()
    say = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    keys, asked = ([say(rng.choice([8, 20, 30, 40, 80, 150, 250])) for _ in range(n)] for n in (120, 300))
    alone, compared = [], []
    monkeypatch.setattr(S.Block, "has_near", lambda self, text: alone.append(text))
    monkeypatch.setattr(S.Near, "__call__", lambda self, key, text: compared.append((key, text)))
    assert not S.Block(keys, 0.85).near(asked).any()
    assert not alone and len(compared) < 300


def test_blocks_by_length(monkeypatch):
    monkeypatch.setattr(J, "HOT_GRAM", 10)
    monkeypatch.setattr(J, "NEAR_BYTES", 100)
    sizes = [{"n": n, "rows": rows, "bytes": n * rows} for n, rows in ((1, 4), (2, 6), (3, 1), (5, 25), (7, 1), (9, 10), (60, 1), (200, 1))]
    assert J._by_length(sizes) == [(1, 2, 0, 1), (3, 3, 0, 1), (5, 5, 0, 3), (5, 5, 1, 3), (5, 5, 2, 3), (7, 7, 0, 1), (9, 9, 0, 1), (60, 60, 0, 1), (200, 200, 0, 2), (200, 200, 1, 2)]


def test_nothing_is_near_to_nothing(spark):
    a, none = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([("",), (None,)], "held string")
    near = J.near_duplicates(a, none, "text", "held")
    assert near.columns == ["id", "text"] and near.count() == 0
