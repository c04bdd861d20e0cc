"""SimHash near-duplicates by anchor-point covering.

Fingerprints are linked when at most THRESHOLD bits differ. The 64 bits are cut into
blocks; a linked pair differs by at most ``THRESHOLD // blocks`` bits in one block at
least. On each block a covering code supplies anchors: Hamming [15, 11] words on every
15 bits (perfect, radius 1) and single bits for the rest, so that every value has one
nearest anchor, its home. A fingerprint is sent to its home and to every anchor that
lies within covering radius plus the block's threshold and is the home of some value
that close. Two fingerprints that agree up to the threshold in a block meet at the
home of either. Each anchor compares its home members with all members and passes on
a spanning forest of the links, never all pairs.

Fewer blocks mean a larger code, more copies of each fingerprint, and far fewer random
meetings: four blocks serve up to LARGE distinct fingerprints, two blocks beyond. Both
find every link; only the work differs.

Large anchors are split: home members are dealt into parts of at most PART expected rows
and the other members go to each part, where they stream past the part's home members.

Defined results: null and blank texts have fingerprint zero and are linked like others;
equal fingerprints are linked (distance 0); texts of fewer words than a shingle has hash
as one shingle; very long texts are hashed HASHES shingles at a time; repeated rows give
repeated results; component_id ignores null ids. `near_duplicates` returns its own columns
alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints up to which four blocks are used.
LARGE = 50_000_000
#: Home members of an anchor's part.
PART = 4096
HASHES = 1 << 16
#: Fingerprints of a task that sends them to their anchors.
SPREAD_ROWS = 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of what h is a hash of; seed 0 leaves h as it is."""
    if not seed:
        return h
    h = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def signature(text: str | None, shingle: int = SHINGLE, seeds: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a text, one for each seed."""
    # bytes.split() cuts at ASCII white space: blank and 0x09 to 0x0D
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(seeds, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) < shingle:
        one = np.array([digest(whole, SEED)], np.uint64)
        return np.array([_mixed(one, k)[0] for k in range(seeds)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros((seeds, 64), np.int64)
    for k in range(0, n, HASHES):
        spans = zip(starts[k : min(n, k + HASHES)].tolist(), ends[k + shingle - 1 : min(n, k + HASHES) + shingle - 1].tolist(), strict=True)
        h = np.array([digest(whole[a:b], SEED) for a, b in spans], "<u8")
        for seed in range(seeds):
            ones[seed] += np.unpackbits(_mixed(h, seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return int(signature(text)[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _home15(v: np.ndarray) -> np.ndarray:
    """Nearest Hamming [15, 11] word of 15-bit values: the bit that the syndrome names is flipped."""
    syndrome = np.zeros_like(v)
    for i in range(15):
        syndrome ^= np.where((v >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return np.where(syndrome > 0, v ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), v)


_HOME15 = _home15(np.arange(1 << 15, dtype=np.uint64))


def home(v: np.ndarray, width: int) -> np.ndarray:
    """The home anchor of `width`-bit values: coded 15 bits at a time, the rest taken as it is."""
    out = np.zeros_like(v)
    for k in range(0, width // 15 * 15, 15):
        out |= _HOME15[(v >> np.uint64(k)) & np.uint64(0x7FFF)] << np.uint64(k)
    rest = width // 15 * 15
    return out | (v >> np.uint64(rest) << np.uint64(rest))


def anchors(fp: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, whether it is the home), without repeats per fingerprint."""
    width, near = 64 // blocks, threshold // blocks
    flips = [0] + [sum(1 << i for i in c) for w in range(1, near + 1) for c in itertools.combinations(range(width), w)]
    out = []
    mask = np.uint64((1 << width) - 1)
    for k in range(blocks):
        v = (fp >> np.uint64(k * width)) & mask
        reached = np.stack([home(v ^ np.uint64(f), width) for f in flips], axis=1)
        own = reached[:, 0].copy()
        reached.sort(axis=1)
        fresh = np.ones(reached.shape, bool)
        fresh[:, 1:] = reached[:, 1:] != reached[:, :-1]
        at, _ = np.nonzero(fresh)
        anchor = reached[fresh]
        # the block's number takes the place of a code bit that no anchor needs
        out.append(((anchor * np.uint64(blocks) + np.uint64(k)).view(np.int64), at, anchor == own[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(fp: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each distinct fingerprint of an anchor the smallest one that it is linked to here."""
    parent = np.arange(len(fp))
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        while True:
            low = np.minimum(parent[a], parent[b])
            new = parent.copy()
            np.minimum.at(new, parent[a], low)
            np.minimum.at(new, parent[b], low)
            new = new[new]
            if np.array_equal(new, parent):
                break
            parent = new
    return parent


def _tree(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links (a, b) between nodes 0 to n - 1 span the components, and each node's root (its component's smallest node)."""
    root = _forest(np.arange(n), [(a, b)])
    done, via = root == np.arange(n), np.full(n, -1)
    while True:
        f, g = np.flatnonzero(done[a] & ~done[b]), np.flatnonzero(done[b] & ~done[a])
        if not len(f) and not len(g):
            break
        child = np.concatenate([b[f], a[g]])
        via[child] = np.concatenate([f, g])
        done[child] = True
    return via[via >= 0], root


def _compared(threshold: int):
    """Rows come sorted by (anchor, part, not home): members stream past the home members of the part."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = part = None
        homes, names, groups = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal edges, held
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            edges, held = [], 0
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        def linked(members: np.ndarray, nodes: np.ndarray) -> None:
            """Keeps links that join what isn't joined yet. groups: for each home member the smallest node that it is joined with here."""
            nonlocal held, groups
            order = np.argsort(names)
            for k in range(0, len(members), 256):
                own, own_nodes = members[k : k + 256], nodes[k : k + 256]
                i, j = np.nonzero(np.bitwise_count(homes[:, None] ^ own[None, :]) <= threshold)
                at = order[np.minimum(np.searchsorted(names, own_nodes, sorter=order), len(names) - 1)]
                own_groups = np.where(names[at] == own_nodes, groups[at], own_nodes)
                apart = groups[i] != own_groups[j]
                i, j = i[apart], j[apart]
                if len(i):
                    every, at = np.unique(np.concatenate([groups[i], own_groups[j]]), return_inverse=True)
                    kept, root = _tree(len(every), at[: len(i)], at[len(i) :])
                    edges.append((names[i[kept]], own_nodes[j[kept]]))
                    held += len(kept)
                    at = np.minimum(np.searchsorted(every, groups), len(every) - 1)
                    groups = np.where(every[at] == groups, every[root[at]], groups)

        for b in batches:
            anc, prt = b.column("anchor").to_numpy(), b.column("part").to_numpy()
            fp = b.column("fp").to_numpy()
            node = b.column("node").to_numpy() if "node" in b.schema.names else fp
            fp = fp.view(np.uint64)
            own = b.column("home").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((anc[1:] != anc[:-1]) | (prt[1:] != prt[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(anc)], strict=True):
                if lo == hi:
                    continue
                if (anc[lo], prt[lo]) != (anchor, part):
                    anchor, part, homes, names, groups = anc[lo], prt[lo], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                mine = own[lo:hi]
                if mine.any():
                    homes, names, groups = (np.concatenate([x, new[lo:hi][mine]]) for x, new in ((homes, fp), (names, node), (groups, node)))
                if len(homes):
                    linked(fp[lo:hi], node[lo:hi])
            if held > 100_000:
                yield flush()
        if held:
            yield flush()

    return compare


def links(distinct: DataFrame, n: int, blocks: int | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) of a graph over distinct fingerprints with the components of the link graph; each edge is a link."""
    blocks = blocks or (4 if n <= LARGE else 2 if threshold < 6 else 3)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = b.slice(k, 4096).column("fp").to_numpy()
                anchor, at, is_home = anchors(fp.view(np.uint64), blocks, threshold)
                yield pa.record_batch({"anchor": pa.array(anchor), "fp": pa.array(fp[at]), "home": pa.array(is_home)})

    # few tasks may hold all fingerprints, each of which becomes dozens of rows here
    sent = distinct.select("fp").repartition(max(1, n // SPREAD_ROWS)).mapInArrow(spread, "anchor long, fp long, home boolean")
    # home members are one per fingerprint and block; anchors with many are split into parts, by a table that stays distributed
    crowded = sent.filter("home").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > PART)
    parts = materialize(crowded.select("anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "simhash-crowded")
    cols = [c for c in sent.columns if c != "home"]
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a home member belongs to one part, where it is compared as home; it passes all other parts as a member
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (F.col("home") & (p == mine)).alias("home")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("home").alias("home")))
    if parts.limit(1).count():
        sent = sent.join(parts, "anchor", "left").select(*cols, F.explode(F.when(F.col("parts").isNull(), one).otherwise(every)).alias("x")).select(*cols, F.col("x.home").alias("home"), F.col("x.part").alias("part"))
    else:
        sent = sent.withColumn("part", F.lit(0))
    sent = sent.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return sent.mapInArrow(_compared(threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each node of an edge list; root is the smallest node reachable.

    Each node points at its smallest neighbour, paths are halved until they end at a node that points at itself, and
    the graph of these ends is what is left to join: edges within a group go, so each round has fewer. Every step is
    written to the shared folder. Joins are on nodes with plain equality, so that adaptive execution can split hot ones.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    found = None
    while True:
        root = materialize(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m")).select("fp", F.least("fp", "m").alias("root")), "simhash-roots")
        while True:
            up = root.select(F.col("fp").alias("p"), F.col("root").alias("above"))
            new = materialize(root.join(up, root["root"] == up["p"]).select("fp", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "simhash-roots")
            root = new.select("fp", "root")
            if not new.filter("moved").limit(1).count():
                break
        ends = root.select(F.col("fp").alias("end"), F.col("root").alias("further"))
        found = root if found is None else found.join(ends, found["root"] == ends["end"], "left").select("fp", F.coalesce("further", "root").alias("root"))
        of = lambda c: root.select(F.col("fp").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        both = materialize(both.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "simhash-edges")
        if not both.limit(1).count():
            return found


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    rows = materialize(fingerprints(df, text), "simhash-fp")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = materialize(links(distinct, rows.select("fp").distinct().count()), "simhash-links")
    roots = components(edges)
    group = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = group.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = group.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
