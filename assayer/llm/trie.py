"""Prefix trie of conversations: chains found by binary search over prefix digests.

A node is a distinct sequence of first turns; its members are the conversations that begin with it,
its owner is the smallest of them. A conversation that owns a node owns all that follow in
it, since members only become fewer: what it owns is one chain from a first owned depth to its
end. That depth is found by binary search: in each round one batched join takes every conversation's middle depth to
its digest and the digest's minimum. Chains hang below the node before their first one, so that chains, not nodes,
form the tree that is aggregated bottom-up, in rounds that double the distance; nodes then get
suffix sums along their chains.

The digest of a prefix is the sum of the SHA-256 of each turn with its depth, in four 32-bit lanes that are summed
without overflow. Sums of prefixes need no walk through a conversation: places, digests and suffix sums
are counted in parts of PART rows, then over parts, so that a conversation of any length is spread over tasks.
The ids that end at a node are joined to pieces of PIECE ids in ranges of (node, id) and hashed
piece after piece as a stream: no list of members is ever held whole.

Defined results: a null role or text counts as empty; turns are in order of turn (null first), role, text; repeated
rows are turns of their own; rows without a conv_id belong to no conversation and are left out; a conversation without turns is a
member of the root alone; empty tables give no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a conversation or chain that are summed in one window.
PART = 256
#: Ids of a piece that is hashed at once.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"
LANES = ("s0", "s1", "s2", "s3")


def turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 0 on, said: digest of role and text, words) and conversations (conv_id, n).

    Places are two-level ranks: places in sorted ranges, shifted by the counts of the ranges before.
    """
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # equal rows are interchangeable, so any tie-break that lets ranges split them gives the same turns
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = materialize(ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), said.alias("said"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-turns")
    placed = placed.withColumn("range", F.shiftright("at", 33))
    counts = placed.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count("*").alias("own"), F.min("at").alias("first"))
    of_conv = Window.partitionBy("c")
    before = F.coalesce(F.sum("own").over(of_conv.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("c", "r", "first", before.alias("before"), F.sum("own").over(of_conv).alias("n")), "trie-counts")
    numbered = placed.join(counts, (placed["conv_id"] == counts["c"]) & (placed["range"] == counts["r"]))
    return numbered.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "said", "words"), counts.select(F.col("c").alias("conv_id"), "n").distinct()


def _running(df: DataFrame, key: str, at: str, sums: list[str], down: bool = False) -> DataFrame:
    """Running sums of columns by key in order of `at` (from the end if `down`), this row included, in two levels."""
    part = F.floor(F.col(at) / PART).cast("long")
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    own = Window.partitionBy(key, "part").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    whole = df.withColumn("part", part)
    upper = Window.partitionBy("k").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, -1)
    above = whole.groupBy(F.col(key).alias("k"), F.col("part").alias("p")).agg(*[F.sum(c).alias(c) for c in sums])
    above = above.select("k", "p", *[F.sum(c).over(upper).alias(f"up_{c}") for c in sums]).filter(F.col(f"up_{sums[0]}").isNotNull())
    inner = whole.withColumns({c: F.sum(c).over(own) for c in sums})
    out = inner.join(above, (inner[key] == above["k"]) & (inner["part"] == above["p"]), "left")
    return out.withColumns({c: F.col(c) + F.coalesce(F.col(f"up_{c}"), F.lit(0)) for c in sums}).select(*df.columns)


def _digests(steps: DataFrame) -> DataFrame:
    """conv_id, depth, words, key: the digest of the first `depth` turns."""
    mark = F.sha2(F.concat_ws(":", "depth", "said"), 256)
    lanes = steps.select("conv_id", "depth", "words", *[F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)])
    summed = _running(lanes, "conv_id", "depth", list(LANES))
    return summed.select("conv_id", "depth", "words", F.unhex(F.sha2(F.concat_ws(":", "depth", *LANES), 256)).alias("key"))


def _first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame, top: int, deepest: int) -> DataFrame:
    """conv_id, n, hi (first owned depth, n + 1 where nothing is owned), above (owner of the node before it)."""
    state = convs.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), F.when(F.col("conv_id") == top, 0).otherwise(F.col("n") + 1).cast("long").alias("hi"), F.lit(top).cast("long").alias("above"))
    asked = prefixes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "key")
    owners = minima.select("key", "owner")
    gap = deepest + 1
    while gap > 1:  # the widest gap is known without looking
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        state = state.withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, mid))
        told = state.filter("mid IS NOT NULL").join(asked, (F.col("conv_id") == F.col("c")) & (F.col("mid") == F.col("d"))).join(owners, "key").select(F.col("conv_id").alias("c"), "owner")
        own = F.col("owner") == F.col("conv_id")
        new = state.join(told, F.col("conv_id") == F.col("c"), "left").select("conv_id", "n", F.when(own | F.col("owner").isNull(), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(own, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(own | F.col("owner").isNull(), F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = materialize(new, "trie-search")
        gap = (gap + 1) // 2
    return state.select("conv_id", "n", "hi", F.when(F.col("conv_id") != top, F.col("above")).alias("above"))


def _bottom_up(chains: DataFrame, top: int) -> DataFrame:
    """Adds up `leaves` and `saved` of each chain (conv_id, above, leaves, saved) and all chains below it, by doubling distances."""
    state = chains.select("conv_id", "above", "leaves", "saved")
    while True:
        state = materialize(state, "trie-chains")
        if not state.filter("above IS NOT NULL").limit(1).count():
            return state.select("conv_id", "leaves", "saved")
        below = state.filter("above IS NOT NULL").groupBy(F.col("above").alias("c")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        # nothing is above the topmost chain, so what hangs below it needs no join
        higher = state.filter(F.col("above").isNotNull() & (F.col("above") != top)).select(F.col("conv_id").alias("x"), F.col("above").alias("y"))
        higher = higher.join(state.select(F.col("conv_id").alias("y"), F.col("above").alias("next")), "y").select("x", "next")
        plus = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c)
        state = state.join(below, F.col("conv_id") == F.col("c"), "left").join(higher, F.col("conv_id") == F.col("x"), "left").select("conv_id", F.col("next").alias("above"), plus("leaves"), plus("saved"))


def _hashed(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 from rows (node, depth, conv_id)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["node", "depth", "first", "ids"])

        for b in batches:
            for node, depth, conv in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "conv_id")), strict=True):
                if (node, depth) != at or len(ids) == PIECE:
                    if ids:
                        done.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = (node, depth), []
                ids.append(conv)
            if done:
                yield out()
        if ids:
            done.append((*at, ids[0], ",".join(map(str, ids))))
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        row = lambda: pa.record_batch([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([h.hexdigest()])], names=["node", "depth", "ends_sha256"])
        for b in batches:
            done = []
            for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) == at:
                    h.update(b"," + ids.encode())
                    continue
                if at:
                    done.append(row())
                at, h = (node, depth), hashlib.sha256(ids.encode())
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if at:
            yield row()

    order = ["node", "depth", "conv_id"]
    said = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "node long, depth long, first long, ids string")
    return said.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digest, "node long, depth long, ends_sha256 string")


def tree(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie; see prefix_trie for the columns.

    steps: conv_id, depth (from 1 on, without gaps), said, words. convs: conv_id, n (turns; may be 0).
    """
    convs = materialize(convs, "trie-convs")
    about = convs.agg(F.min("conv_id").alias("top"), F.count("*").alias("n"), F.max("n").alias("deepest")).head()
    top, deepest = about["top"], about["deepest"] or 0
    prefixes = materialize(_digests(steps), "trie-prefixes")
    minima = materialize(prefixes.groupBy("key").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("words").alias("words")), "trie-minima")
    found = _first_owned(prefixes, minima, convs, -1 if top is None else top, deepest)
    chains = found.filter("hi <= n")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    # a node's last turn is the same for all members, and so is the number of its words
    nodes = root.unionByName(minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words"))
    hung = chains.filter("above IS NOT NULL").select(F.col("above").alias("node"), (F.col("hi") - 1).alias("at"), F.col("conv_id").alias("child"))
    attached = hung.groupBy("node", "at").agg(F.count("*").alias("hanging"))
    # what chains own, end and have hanging from them
    own = nodes.join(chains.select(F.col("conv_id").alias("c"), "n", "hi", "above"), F.col("conv_id") == F.col("c"))
    own = own.join(attached, (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("at")), "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")
    own = own.select("conv_id", "depth", "n_convs", children.alias("n_children"), F.when(F.col("depth") > F.col("hi"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "above", (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = materialize(own, "trie-nodes")
    sums = own.groupBy("conv_id").agg(F.max("above").alias("above"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = _bottom_up(sums, -1 if top is None else top).select(F.col("conv_id").alias("child"), F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"))
    below = hung.join(whole, "child").groupBy("node", "at").agg(F.sum("own_leaves").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))
    plus = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c)
    filled = own.join(below, (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("at")), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", plus("leaves"), plus("saved"))
    filled = _running(filled, "conv_id", "depth", ["leaves", "saved"], down=True)
    ends = found.select(F.when(F.col("hi") <= F.col("n"), F.col("conv_id")).otherwise(F.col("above")).alias("node"), F.col("n").alias("depth"), "conv_id")
    hashed = _hashed(ends).select(F.col("node").alias("c"), F.col("depth").alias("d"), "ends_sha256")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = filled.join(hashed, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left")
    long = lambda c, name=None: F.col(c).cast("long").alias(name or c)
    return out.select(long("conv_id"), long("depth"), long("parent_conv_id"), long("n_convs"), long("n_children"), long("leaves", "n_leaves"), long("saved", "saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text): one row for each node.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens (of the
    subtree), ends_sha256 (of the comma-joined ids that end here).
    """
    steps, convs = turns(df)
    return tree(steps.select("conv_id", (F.col("place") + 1).alias("depth"), "said", "words"), convs)
