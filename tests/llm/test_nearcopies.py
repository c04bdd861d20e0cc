"""Near copies: candidates, the exact decision and whole groups against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import nearcopies as N

DOCS = "doc_id long, text string"


def brute(text):
    """The set of five-word shingles of a text."""
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def say(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]


def changed(rng, words, share):
    out = list(words)
    for p in rng.sample(range(len(out)), max(1, round(len(out) * share))):
        out[p] = "changed" + str(rng.randint(0, 10**6))
    return out


@pytest.mark.parametrize("large", [N.LARGE, 0])
def test_recall_and_precision_by_band(spark, monkeypatch, large):
    """Of pairs of 0.80 and more nine in ten are found, also just above 0.80; none below is. The same with the anchors of a large corpus."""
    monkeypatch.setattr(N, "LARGE", large)
    rng = random.Random(2)
    bands = {(0.7, 0.8): [], (0.8, 0.82): [], (0.82, 0.85): [], (0.85, 0.9): [], (0.9, 1.01): []}
    rows = []
    while any(len(x) < 150 for x in bands.values()):
        base = say(rng, rng.randint(100, 500))
        other = changed(rng, base, rng.uniform(0.002, 0.07))
        j = similar(brute(" ".join(base)), brute(" ".join(other)))
        for (lo, hi), found in bands.items():
            if lo <= j < hi and len(found) < 150:
                found.append(len(rows))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    stays = {r["row"].doc_id: r.stays for r in N.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(stays[i] for found in bands.values() for i in found)
    shares = {band: sum(not stays[i + 1] for i in found) / len(found) for band, found in bands.items()}
    assert shares[0.7, 0.8] == 0 and all(s >= 0.9 for band, s in shares.items() if band[0] >= 0.8), shares
    assert shares[0.9, 1.01] == 1


def test_groups_against_brute_force(spark):
    """Groups whose members are mostly below 0.8 of each other, chains, exact copies and odd rows."""
    rng = random.Random(3)
    rows = []
    for size, share in ((40, 0.02), (30, 0.035), (60, 0.012)):
        base = say(rng, 250)
        rows += [" ".join(changed(rng, base, share)) for _ in range(size)]
    link = say(rng, 300)
    for _ in range(12):
        link = changed(rng, link, 0.02)
        rows.append(" ".join(link))
    rows += rows[:5] + [None, "", "  \n", "one", "ONE", "two words", "a b c d e", "a b c d e f", "x " * 70_000, "x " * 5]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    sets, root = [brute(t) for t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if root[i] != root[j] and similar(sets[i], sets[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("row", "fps", "node", "digest", "a", "n", "root")})
    out = N.near_copies(df).collect()
    assert out[0]["row"].asDict().keys() == set(df.columns)
    assert sorted(r["row"].doc_id for r in out if r.stays) == sorted(set(root))


def test_rows_without_ids_and_repeated_rows(spark):
    text = " ".join(say(random.Random(4), 80))
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text), (None, "alone"), (1, "other words " * 9), (1, "and these " * 9)]
    kept = sorted(((r["row"].doc_id, r["row"].text) for r in N.near_copies(spark.createDataFrame(rows, DOCS)).collect() if r.stays), key=repr)
    assert kept == sorted([(7, text), (None, "alone"), rows[6], rows[7]], key=repr)
    assert N.near_copies(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_links_of_an_anchor(cut):
    """Members of parts and those that pass by, in batches of any size: all links across groups, and a forest of least bits."""
    rng = np.random.default_rng(5)
    fps = np.repeat(rng.integers(0, 2**63, (6, 5), dtype=np.uint64), 10, axis=0)
    for k in range(60):
        for b in rng.integers(0, 320, rng.integers(0, 30)):
            fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    part = np.arange(60) % 3
    rows = sorted((9, int(2 * q + (q > part[k])), k) for k in range(60) for q in range(part[k], 3))
    cols = {"anchor": pa.array([r[0] for r in rows], pa.int64()), "slot": pa.array([r[1] for r in rows], pa.int64()), "node": pa.array([r[2] for r in rows], pa.int64()), "comp": pa.array([r[2] % 4 for r in rows], pa.int64())}
    table = pa.table(cols | {f"f{i}": pa.array([int(fps[r[2]].view(np.int64)[i]) for r in rows], pa.int64()) for i in range(5)})
    batches = lambda: table.to_batches(max_chunksize=cut)
    near = {(i, j): int(np.bitwise_count(fps[i] ^ fps[j]).sum()) for i, j in itertools.combinations(range(60), 2)}
    near = {p: d for p, d in near.items() if d <= 40}
    links = lambda across: [tuple(x) for b in N._compared(30, 40, across)(batches()) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(set(links(True))) == sorted(p for p in near if p[0] % 4 != p[1] % 4)
    found = links(False)
    likely = {p for p, d in near.items() if d <= 30}
    assert {p for p in found if p[0] != p[1]} <= likely
    assert {p[0] for p in found if p[0] == p[1]} == {x for p in near for x in p}
    groups = lambda pairs: [min(r) for r in _reach(60, pairs)]
    assert groups(found) == groups(likely)


def _reach(n, pairs):
    own = [{i} for i in range(n)]
    for a, b in pairs:
        if own[a] is not own[b]:
            both = own[a] | own[b]
            for x in both:
                own[x] = both
    return own


def test_forest_has_the_least_bits():
    rng = random.Random(6)
    for _ in range(50):
        n = rng.randint(2, 25)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        bits = [rng.randint(0, 9) for _ in pairs]
        kept, root = N.forest(n, *(np.array(x, dtype=np.int64).reshape(-1) for x in (list(zip(*pairs, strict=True)) or [[], []])), np.array(bits, dtype=np.int64))
        own, want = list(range(n)), 0
        for d, (a, b) in sorted(zip(bits, pairs, strict=True)):
            if own[a] != own[b]:
                want += d
                own = [own[a] if x == own[b] else x for x in own]
        assert sum(bits[k] for k in kept) == want and len(kept) == n - len(set(own)) and len(set(root.tolist())) == len(set(own))


def test_two_blocks_an_anchor():
    """Anchors of two blocks are homes of both; equal fingerprints share all of them."""
    fps = np.random.default_rng(7).integers(0, 2**63, (3, 24), dtype=np.uint64)
    one, two = N.anchors(fps, 1), N.anchors(fps, 2)
    assert one.shape == (3, 96) and two.shape == (3, 144)
    assert all(len(set(x.tolist())) == len(x) for x in (*one, *two))
    other = fps.copy()
    other[:, 0] ^= np.uint64(1 << 15)  # the bit that is left out
    assert (N.anchors(other, 1) == one).all()


def test_size_of_the_input_changes_no_result(spark, monkeypatch):
    """Pairs just above the limit, some of which anchors miss, and crowded anchors: the same rows stay beyond LARGE as before it."""
    rng = random.Random(8)
    rows = []
    while len(rows) < 400:
        base = say(rng, rng.randint(60, 120))
        other = changed(rng, base, rng.uniform(0.015, 0.03))
        if 0.8 <= similar(brute(" ".join(base)), brute(" ".join(other))) < 0.83:
            rows += [" ".join(base), " ".join(other)]
    base = say(rng, 200)
    rows += [" ".join(changed(rng, base, 0.01)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), DOCS)
    stays = []
    for large, part in ((N.LARGE, N.PART), (0, N.PART), (N.LARGE, 16)):
        monkeypatch.setattr(N, "LARGE", large)
        monkeypatch.setattr(N, "PART", part)
        stays.append(sorted(r["row"].doc_id for r in N.near_copies(docs).filter("stays").collect()))
    assert stays[0] == stays[1] == stays[2] and len(stays[0]) < 260
