"""Near copies of whole texts: SimHash anchors propose, exact shingle sets decide.

A text has SIGNATURE independent 64-bit SimHash fingerprints over its shingles, the first ANCHORED of which are cut into
blocks of 15 bits (a 16th bit is left out). The anchors of a block are the words of the Hamming [15, 11]
code, which has covering radius 1: a block goes to every anchor within that radius plus a threshold of no
bit, which is one. Texts that meet at an anchor are compared there in all bits of all fingerprints, and are candidates where these
differ in no more bits than the similarity lets expect, with SLACK standard errors. At a similarity of
0.8 two texts share an anchor with probability 0.15 a block, so 0.96 over five fingerprints, and 0.98 of these pass the bits.

Candidates are decided by the Jaccard similarity of the shingle sets themselves, in two rounds, since a
group of thousands of near copies has millions of pairs. The first takes from every anchor a forest of least bits
over the likely links, and marks the texts that have a candidate at all. Links that hold join texts to groups; the second round
sends the marked texts alone and takes all candidates between different groups. A pair that is left out is in one group already,
so no link is lost. Only texts of candidates are shuffled: a bit filter of a fixed size tells them apart where they are read.

Texts with equal shingle sets are one node (their sets' 128-bit digests are compared). Crowded anchors are split:
members are dealt into parts, which are compared with each other. A text that many others are compared with is sent to several tasks.

Which texts are candidates doesn't depend on the size of the input. Beyond LARGE rows only the parts of crowded anchors are larger, so
that a text passes by fewer of them; parts never change what is linked, as all candidates between different groups are decided.

Defined results: null and blank texts have an empty set and are copies of each other; texts of fewer words than a shingle
are one shingle; texts of any length are hashed HASHES shingles at a time; of a group the row with the smallest doc_id
stays (null ids come last, and of equal ids one row); all columns are kept, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .phrases import _filter, _lets
from .simhash import _HOME15, HASHES, LOWER, SEED, _forest, _mixed, components

#: Fingerprints of a text whose bits are compared, and how many have anchors.
SIGNATURE, ANCHORED = 8, 5
BLOCKS = 4
#: Standard errors of the number of differing bits that a candidate may have.
SLACK = 2.0
#: Members of an anchor's part (beyond LARGE rows PART_LARGE), and links of a text that one task decides.
PART, PART_LARGE, LINKS = 2048, 16384, 256
LARGE = 20_000_000
#: Nodes of a task that sends them to their anchors.
SPREAD_ROWS = 20_000


def shingles(text: str | None, shingle: int) -> Iterator[bytes]:
    """The shingles of a text, repeats included: its words in lower case (A-Z), joined by blanks."""
    words = (text or "").encode().translate(LOWER).split()
    whole = b" ".join(words)
    if not words:
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(whole)]
    for a, b in zip(starts.tolist(), last, strict=False):
        yield whole[a:b]


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    """Similarity of two shingle sets; empty ones are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def sketch(text: str | None, shingle: int, seeds: int) -> tuple[np.ndarray, bytes]:
    """Fingerprints of a text, and a 128-bit digest of its set of shingles."""
    ones, n, seen = np.zeros((seeds, 64), np.int64), 0, []
    found = shingles(text, shingle)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(found, HASHES)), np.uint64)):
        for seed in range(seeds):
            ones[seed] += np.unpackbits(_mixed(h, seed).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        seen = [np.unique(np.concatenate([*seen, h]))]
    fps = np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()
    return fps, xxhash.xxh3_128_digest(seen[0].tobytes() if seen else b"")


def bits_apart(similarity: float, bits: int, slack: float) -> int:
    """Bits of `bits` in which fingerprints of sets of equal size with a Jaccard similarity differ, and `slack` standard errors more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def anchors(fps: np.ndarray, joined: int) -> np.ndarray:
    """The anchors of nodes with fingerprints (n, seeds): homes of single blocks, or of pairs of blocks of a fingerprint."""
    homes = np.stack([_HOME15[(fps >> np.uint64(64 // BLOCKS * k)) & np.uint64(0x7FFF)] for k in range(BLOCKS)], axis=2)
    out = []
    for which, of in enumerate(itertools.combinations(range(BLOCKS), joined)):
        value = np.zeros(fps.shape, np.uint64)
        for k in of:
            value = value << np.uint64(15) | homes[:, :, k]
        # blocks and seeds have anchors of their own
        out.append((value << np.uint64(5) | np.uint64(which)) * np.uint64(fps.shape[1]) + np.arange(fps.shape[1], dtype=np.uint64))
    return np.concatenate(out, axis=1).view(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (their places) that join nodes 0 to n - 1 with the least bits, and the groups after that. root: groups that there are already."""
    order = np.argsort(bits, kind="stable")
    a, b, live = a[order], b[order], np.arange(len(order))
    root, kept = np.arange(n) if root is None else root, []
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            return (order[np.concatenate(kept)] if kept else order[:0]), root
        best = np.full(n, len(order))
        for side in (a, b):
            np.minimum.at(best, root[side[live]], live)
        pick = np.unique(best[best < len(order)])
        kept.append(pick)
        root = _forest(np.arange(n), [(root[a[pick]], root[b[pick]])])[root]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint row of a and each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out


class _Part:
    """The members of an anchor's part, and links between them and those that pass by."""

    def __init__(self, likely: int, limit: int, across: bool):
        self.likely, self.limit, self.across = likely, limit, across
        self.own: list[tuple] = []
        self.whole = None

    def add(self, fps: np.ndarray, nodes: np.ndarray, groups: np.ndarray) -> None:
        self.own.append((fps, nodes, groups))

    def within(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between members."""
        self.whole = fps, nodes, groups = tuple(np.concatenate(x) for x in zip(*self.own, strict=True))
        n, found = len(nodes), []
        for at in range(0, n - 1, 256):
            bits = _differ(fps[at : at + 256], fps[at + 1 :])
            i, j = np.nonzero(bits <= self.limit)
            i, j, d = i + at, j + at + 1, bits[i, j]
            fine = (i < j) & (groups[i] != groups[j] if self.across else True)
            found.append((i[fine], j[fine], d[fine]))
        self.root = np.arange(n)
        if found:
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            yield self._links(i, j, d, nodes, n)

    def _links(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.across:
            return nodes[i], nodes[j]
        marked = nodes[np.unique(np.concatenate([i, j]))]
        near = np.flatnonzero(d <= self.likely)
        kept, root = forest(len(nodes), i[near], j[near], d[near], np.concatenate([self.root, np.arange(n, len(nodes))]))
        # groups that met through those that pass by have met here too
        self.root, kept = root[:n], near[kept]
        return np.concatenate([nodes[i[kept]], marked]), np.concatenate([nodes[j[kept]], marked])

    def passing(self, fps: np.ndarray, nodes: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between members and others."""
        own, own_nodes, own_groups = self.whole
        for at in range(0, len(nodes), 256):
            some = slice(at, at + 256)
            bits = _differ(own, fps[some])
            i, j = np.nonzero(bits <= self.limit)
            d = bits[i, j]
            if self.across:
                fine = own_groups[i] != groups[some][j]
                i, j, d = i[fine], j[fine], d[fine]
            yield self._links(i, j + len(own_nodes), d, np.concatenate([own_nodes, nodes[some]]), len(own_nodes))


def _compared(likely: int, limit: int, across: bool):
    """Rows come sorted by (anchor, slot). across: all links between different groups within `limit` bits, else a forest of those within `likely`, and a loop at each node that has any link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            links.clear()
            # many anchors say the same
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            anchor, slot, nodes = (batch.column(c).to_numpy() for c in ("anchor", "slot", "node"))
            fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in batch.schema.names if c.startswith("f")], axis=1)
            groups = batch.column("comp").to_numpy() if across else nodes
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                rows = fps[lo:hi], nodes[lo:hi], groups[lo:hi]
                if (anchor[lo], slot[lo] // 2) != at:
                    if part and part.whole is None:
                        links += part.within()
                    at, part = (anchor[lo], slot[lo] // 2), None
                if slot[lo] % 2 == 0:
                    part = part or _Part(likely, limit, across)
                    part.add(*rows)
                elif part:
                    if part.whole is None:
                        links += part.within()
                    links += part.passing(*rows)
            if sum(len(x[0]) for x in links) > 200_000:
                yield flush()
        if part and part.whole is None:
            links += part.within()
        if links:
            yield flush()

    return compare


def _candidates(nodes: DataFrame, n: int, likely: int, limit: int, across: bool, part: int) -> DataFrame:
    """Distinct links (a, b), a <= b, that anchors give for nodes (node, fps and, for links across groups, comp)."""
    cols = ["node", *(["comp"] if across else [])]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                fps = rows.column("fps").flatten().to_numpy().reshape(rows.num_rows, -1)
                to = anchors(np.ascontiguousarray(fps[:, :ANCHORED]).view(np.uint64), 1)
                at = np.repeat(np.arange(rows.num_rows), to.shape[1])
                yield pa.record_batch([pa.array(to.ravel()), *[rows.column(c).take(pa.array(at)) for c in cols], *[pa.array(fps[at, k]) for k in range(SIGNATURE)]], names=["anchor", *cols, *[f"f{k}" for k in range(SIGNATURE)]])

    schema = ", ".join(f"{c} long" for c in ("anchor", *cols, *[f"f{k}" for k in range(SIGNATURE)]))
    sent = nodes.select("fps", *cols).repartition(max(1, n // SPREAD_ROWS)).mapInArrow(spread, schema)
    crowded = sent.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > part)
    parts = materialize(crowded.select("anchor", F.ceil(F.col("n") / part).cast("long").alias("parts")), "nearcopies-crowded")
    if parts.limit(1).count():
        # a member belongs to one part (an even slot) and passes all later ones (odd slots)
        mine = F.pmod(F.xxhash64("node"), F.col("parts"))
        every = F.transform(F.sequence(mine, F.col("parts") - 1), lambda p: 2 * p + (p > mine).cast("long"))
        sent = sent.join(parts, "anchor", "left").withColumn("slot", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(every))).drop("parts")
    else:
        sent = sent.withColumn("slot", F.lit(0).cast("long"))
    # a part and those that pass it go to one task
    sent = sent.repartition(F.col("anchor"), F.shiftright("slot", 1)).sortWithinPartitions("anchor", "slot")
    return sent.mapInArrow(_compared(likely, limit, across), "a long, b long").distinct()


def _texts_of(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (node, t) of the links' nodes, and a few more: what passes a bit filter of a fixed size."""
    ids = links.select(F.explode(F.array("a", "b")).alias("node")).select(F.xxhash64("node").alias("h"))
    filled = links.sparkSession.sparkContext.broadcast(_filter(ids))

    @F.pandas_udf(T.BooleanType())
    def needed(h: pd.Series) -> pd.Series:
        return pd.Series(_lets(filled.value, h.to_numpy().view(np.uint64)))

    return texts.filter(needed(F.xxhash64("node")))


def _decided(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts (node, t) have at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            a, b = [], []
            for node, other, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "t")), strict=True):
                if other is None:
                    at, own = node, set(shingles(text, shingle))
                elif node == at and jaccard(own, set(shingles(text, shingle))) >= similarity:
                    a.append(node)
                    b.append(other)
            if a:
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    texts = _texts_of(links, texts)
    parts = links.groupBy("a").agg(F.ceil(F.count("*") / LINKS).cast("int").alias("parts"))
    heads = parts.join(texts, parts["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "t")
    dealt = links.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    others = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "part", "b", "t")
    # the text itself comes before those that it is compared with
    sent = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return sent.select("a", "b", "t").mapInArrow(run, "a long, b long")


def near_copies(df: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """All rows and columns of df, in a struct `row`, and `stays`: whether the row is the one that stands for its group.

    A group is what links of texts with at least `similarity` of their shingles in common reach.
    """
    spark = df.sparkSession
    small_batches(spark)
    at = df.columns.index(text)
    part = PART_LARGE if df.count() > LARGE else PART
    seeds = SIGNATURE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(t, shingle, seeds) for t in b.column("row").field(at).to_pylist()]
            fps = np.array([x[0] for x in made], np.uint64).reshape(-1)
            sent = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * seeds, pa.int32()), pa.array(fps.view(np.int64)))
            yield pa.record_batch([b.column("row"), sent, pa.array([x[1] for x in made], pa.binary())], names=["row", "fps", "digest"])

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("fps", T.ArrayType(T.LongType())), T.StructField("digest", T.BinaryType())])
    rows = materialize(packed.mapInArrow(run, schema).select("*", F.col("row.doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place")), "nearcopies-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")
    nodes = materialize(rows.groupBy("digest").agg(F.min("place").alias("node"), F.first("fps").alias("fps"), F.min(order).alias("low"), F.count("*").alias("n")), "nearcopies-nodes")
    n, bits = nodes.count(), 64 * SIGNATURE
    texts = rows.select(F.col("place").alias("node"), F.col("row")[df.columns[at]].alias("t"))
    likely, limit = bits_apart(similarity, bits, 0), bits_apart(similarity, bits, SLACK)
    met = materialize(_candidates(nodes, n, likely, limit, False, part), "nearcopies-met")
    links = met.filter("a <> b")
    first = materialize(_decided(links, texts, shingle, similarity), "nearcopies-first")
    roots = components(first).select(F.col("fp").alias("node"), "root")
    marked = met.filter("a = b").select(F.col("a").alias("node"))
    grouped = materialize(nodes.join(marked, "node").join(roots, "node", "left").select("node", "fps", F.coalesce("root", "node").alias("comp")), "nearcopies-marked")
    rest = _candidates(grouped, grouped.count(), likely, limit, True, part).join(links, ["a", "b"], "left_anti")
    second = _decided(materialize(rest, "nearcopies-rest"), texts, shingle, similarity)
    found = components(first.unionByName(second)).select(F.col("fp").alias("node"), "root")
    group = nodes.join(found, "node", "left").select("digest", "low", "n", F.coalesce("root", "node").alias("root"))
    first_of = group.groupBy("root").agg(F.min("low").alias("first"), F.sum("n").alias("size")).filter("size > 1")
    # only groups of several rows are joined with the rows
    chosen = group.join(first_of, "root").select("digest", F.col("first.place").alias("first"))
    return rows.join(chosen, "digest", "left").select("row", F.coalesce(F.col("first") == F.col("place"), F.lit(True)).alias("stays"))
