"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of WINDOW words (a shorter item is one window). A window
is contained in a document only if all of its words are, so in an order by rarity a
prefix of one word, the rarest, is necessary. These rarest words, by their place in the
item, are the anchors: each window holds at least one. Rarity is the number of times a
word occurs in all documents. Document words are joined with anchors on the word alone;
the place of an anchor in its item then bounds where a window can lie (positional and
length bounds), and comparing the words on its two sides, at most WINDOW - 1 each way
and never beyond the item, verifies containment exactly and gives the run of words hit.

Documents are scanned twice (counts, matches) and only matches are shuffled. Anchors are
broadcast in blocks of at most BLOCK_ROWS, one pass over the documents for each block,
so what is broadcast has a bound however large the benchmark is.

Words are compared in lower case for A-Z. The join sees words in full lower case (cheap,
and never tells more apart), the verification sees the exact ones.

Defined results: null and empty texts have no words and are not contaminated; items
without words are ignored; items with a null id match but add nothing to n_items;
repeated items count once per id; every input row gives one row, repeated ones too;
words equally rare are told apart by their place in the item; very long texts are looked
at whole. Other columns stay as they are, but for those named as the operator's results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .common import materialize, named_back, set_apart

WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Anchors of a broadcast block: about 1 KB each, 64 MB at most.
BLOCK_ROWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: As BETWEEN, for text that is not yet in lower case.
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words up to which the vocabulary is broadcast while counting (tens of MB at most).
VOCABULARY_ROWS = 500_000
NEW = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def tokens(text: Column) -> Column:
    """Words of a text as they are written; an empty string may stand at either end."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN_RAW, -1)


def exact(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(word, UPPER, LOWER)


def item_words(items: DataFrame) -> DataFrame:
    """item_id, iw (lower-case words), ix (exact words) of items that have words."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.filter(tokens(F.col("text")), lambda w: w != "").alias("raw"))
    return own.filter(F.size("raw") > 0).select("item_id", F.transform("raw", F.lower).alias("iw"), F.transform("raw", exact).alias("ix")).distinct()


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, df: occurrences in all documents of the benchmark's words (0 where absent)."""
    said = docs.select(F.explode(tokens(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    if vocabulary.count() <= VOCABULARY_ROWS:
        said = said.join(F.broadcast(vocabulary), "word", "left_semi")
    found = said.groupBy("word").agg(F.count("*").alias("df"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """word, item_id, n, at (place in the item), before, after (exact words next to it, nearest first), own (exact word)."""
    placed = items.select("item_id", F.size("iw").alias("n"), F.posexplode("iw").alias("at", "word"), "ix")
    placed = placed.join(counts, "word", "left").select("item_id", "n", "at", "word", "ix", F.coalesce("df", F.lit(0)).alias("df"))
    # every window gets each of its words as a candidate; the rarest (then first) is its anchor
    last = F.greatest(F.lit(0), F.col("n") - WINDOW)
    windows = placed.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - WINDOW + 1), F.least(F.col("at"), last))).alias("window"))
    rarest = windows.groupBy("item_id", "ix", "n", "window").agg(F.min(F.struct("df", "at", "word")).alias("low"))
    chosen = rarest.select("item_id", "ix", "n", F.col("low.at").alias("at"), F.col("low.word").alias("word")).distinct()
    before = F.reverse(F.slice("ix", F.greatest(F.lit(1), F.col("at") - WINDOW + 2), F.least(F.col("at"), F.lit(WINDOW - 1))))
    return chosen.select("word", "item_id", "n", "at", before.alias("before"), F.slice("ix", F.col("at") + 2, WINDOW - 1).alias("after"), F.get("ix", F.col("at")).alias("own"))


def _run(doc: Column, pos: Column, near: Column, step: int) -> Column:
    """How many words on one side of `pos` agree with `near`, the nearest first; stops at the first that differs."""
    out = F.lit(WINDOW - 1)
    for k in range(WINDOW - 1, 0, -1):
        same = F.get(near, F.lit(k - 1)) == exact(F.get(doc, pos + step * k))
        out = F.when(F.coalesce(same, F.lit(False)), out).otherwise(F.lit(k - 1))
    return out


def matches(docs: DataFrame, block: DataFrame) -> DataFrame:
    """Keys of `docs`, begin, end, item_id: runs of words that are windows of an item.

    `docs` has columns k1, k2 and tokens; begin and end are places in tokens.
    """
    at = docs.select("k1", "k2", "tokens", F.posexplode("tokens").alias("pos", "said")).withColumn("word", F.lower("said"))
    joined = at.join(F.broadcast(block), "word").filter(exact(F.col("said")) == F.col("own"))
    left, right = (_run(F.col("tokens"), F.col("pos"), F.col(near), step) for near, step in (("before", -1), ("after", 1)))
    runs = joined.select("k1", "k2", "pos", "item_id", "n", left.alias("l"), right.alias("r"))
    long = F.col("l") + F.col("r") + 1 >= F.least(F.lit(WINDOW), F.col("n"))
    return runs.filter(long).select("k1", "k2", (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r") + 1).alias("end"), "item_id")


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """Adds k1, k2 to columns set apart: rows with equal keys have equal id and text, and so equal results."""
    docs, names = set_apart(docs)
    key, said = F.col(names["doc_id"]), F.col(names[text])
    return docs.withColumns({"k1": F.coalesce(key.cast("long"), F.lit(0)), "k2": F.xxhash64(key, said), "said": said}), names


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """k1, k2, n_hit, n_items, ids: the contaminated documents alone, of k1, k2 and said (the text)."""
    listed = materialize(item_words(items), "decontaminate-items")
    vocabulary = listed.select(F.explode("iw").alias("word")).distinct()
    chosen = materialize(anchors(listed, frequencies(docs.select(F.col("said").alias("text")), vocabulary)), "decontaminate-anchors")
    blocks = max(1, -(-chosen.count() // BLOCK_ROWS))
    split = docs.select("k1", "k2", tokens(F.col("said")).alias("tokens"))
    path = shared_path(docs.sparkSession, "decontaminate-matches")
    for b in range(blocks):
        # a block's matches are written before the next one is broadcast, so that one block at a time is held
        found = matches(split, chosen.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b) if blocks > 1 else chosen)
        found.write.parquet(f"{path}/block={b}")
    found = docs.sparkSession.read.schema(found.schema).parquet(*[f"{path}/block={b}" for b in range(blocks)])
    # words hit: each run adds what reaches beyond the runs before it
    spans = found.groupBy("k1", "k2", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    hit = spans.select("k1", "k2", fresh.alias("fresh")).groupBy("k1", "k2").agg(F.sum("fresh").cast("long").alias("n_hit"))
    ids = found.select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    return hit.join(ids, ["k1", "k2"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to each row."""
    docs, names = _keyed(docs, text)
    pieces = tokens(F.col("said"))
    ends = (F.element_at(pieces, 1) == "").cast("int") + ((F.element_at(pieces, -1) == "") & (F.size(pieces) > 1)).cast("int")
    out = docs.withColumn("n_words", (F.size(pieces) - ends).cast("long")).join(hits(docs, items), ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items_sha256": F.sha2(F.coalesce("ids", F.lit("")), 256)})
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*named_back(names, *NEW), *NEW)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any contaminated word, columns as they were."""
    docs, names = _keyed(docs, text)
    return docs.join(hits(docs, items), ["k1", "k2"], "left_anti").select(*named_back(names))
