"""Phrase collocations by Apriori passes over whole texts.

A text is lower-cased (A-Z), cut at `.,;:!?` and line ends into pieces, and these at blanks
and tabs into words. Pass k looks at each run of k words whose two overlapping runs of
k - 1 words are frequent, and counts it. What is frequent is broadcast as a bit filter of a
fixed size (FILTER_BITS, two bits a run), however many runs there are: a run that the filter
lets through by chance costs work, but is counted like any other and goes when its count is
known. The widest part, counting runs that mostly turn out to be rare, is done by 64-bit hash;
the next pass counts those that reached the support by their words. So hashes only choose what
is counted, and counts are exact.

Scores come from the level tables alone: both parts of each cut are looked up there by a join,
and a phrase learns of longer ones that hold it by one aggregation.

All is per language. Tasks count what they read in flushes of a bounded size; what is sent is one row
for each distinct run of a flush, so that frequent runs make no hot key.

Defined results: a null text counts as empty, a null lang as `und`; texts of any length are
read CHUNK bytes at a time without losing runs that span chunks; repeated rows count as often as they come;
without a frequent pair the result is empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

SUPPORT, LONGEST = 30, 4
#: A phrase goes where a longer one that holds it has this percentage of its occurrences.
COVERED = 80
PER_LANG = 2000
#: log2 of the bits of the broadcast filter (16 MB).
FILTER_BITS = 27
#: Bytes of text that are split at once; runs and distinct words after which a task sends what it has counted.
CHUNK = 2 << 20
RUNS, WORDS = 3_000_000, 300_000
#: Rows of a batch that is sent.
SENT = 1 << 17
#: Parts of a language that are ranked on their own before the language is.
RANKED = 256

BREAKS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes(b"."[0] if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_APART = re.compile(rb"[ \t.]")
_SCHEMA = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time, with b"." for each break between pieces."""
    text, at = text.translate(_MAP), 0
    while at < len(text):
        cut = _APART.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = cut.start() if cut else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs from those of their beginnings and last words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _lets(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter holds both bits of each hash."""
    mask, out = np.uint64((1 << FILTER_BITS) - 1), None
    for at in (h & mask, h >> np.uint64(32) & mask):
        one = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        out = one if out is None else out & one
    return out


class _Language:
    """Words of one language as numbers (0 is a break), their hashes, and runs that are to be counted by their words."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."]
        self.hashes, self.runs, self.n = np.zeros(1, np.uint64), [], 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > len(self.hashes):
            fresh = list(self.ids)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in fresh], np.uint64)])
        return out

    def counted(self) -> tuple[list[str], np.ndarray]:
        """Distinct runs as text, and how often they came."""
        cols = np.concatenate(self.runs, axis=1)
        code = cols[0]
        for col in cols[1:]:
            code = np.unique(code, return_inverse=True)[1] << 32 | col
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        words = list(self.ids)
        return [b" ".join([words[i] for i in row]).decode() for row in cols[:, first].T.tolist()], n


def _pass(k: int, last: bool, bits: np.ndarray | None):
    """Pass k over batches of (lang, text): hashes of runs of k words (unless it is the last), and runs of k - 1 by their words."""

    def sent(h: list | np.ndarray, lang: str | None, gram: list | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), SENT):
            part = slice(at, at + SENT)
            size = len(n[part])
            yield pa.record_batch([
                pa.array(h[part]) if gram is None and h is not None else pa.nulls(size, pa.int64()),
                pa.array([lang] * size, pa.string()), pa.array(gram[part], pa.string()) if gram else pa.nulls(size, pa.string()), pa.array(n[part], pa.int64()),
            ], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Language] = {}
        hashes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if hashes:
                h, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield from sent(h.view(np.int64), None, None, n)
            for lang, own in known.items():
                if own.n:
                    yield from sent(None, lang, None, np.array([own.n]))
                if own.runs:
                    gram, n = own.counted()
                    yield from sent(None, lang, gram, n)
            known.clear()
            hashes.clear()

        def read(own: _Language, ids: np.ndarray, seen: bool) -> int:
            """seen: whether the first k - 1 words were there before."""
            h, apart, m = own.hashes[ids], ids == 0, k - 1
            if not m:
                hashes.append(h[~apart])
                own.n += len(hashes[-1])
                return len(hashes[-1])
            size = len(ids) - m + 1
            if size <= 0:
                return 0
            g, bad = h[:size], apart[:size]
            for j in range(1, m):
                g, bad = _joined(g, h[j : j + size]), bad | apart[j : j + size]
            at = np.flatnonzero(~bad)
            at = at[_lets(bits, g[at])]
            if not last:
                both = at[:-1][np.diff(at) == 1]
                hashes.append(_joined(g[both], h[both + m]))
            own_at = at[1:] if seen and len(at) and at[0] == 0 else at
            own.runs.append(np.stack([ids[own_at + j] for j in range(m)]))
            return len(own_at) + len(at)

        held = 0
        for b in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                before = np.zeros(0, np.int64)
                for words in tokens(b"\n".join(texts)):
                    own = known[lang] = known.get(lang) or _Language(lang)
                    ids = np.concatenate([before, own.numbers(words)])
                    held += read(own, ids, len(before) == k - 1 > 0)
                    tail = ids[max(0, len(ids) - k + 1) :] if k > 1 else ids[:0]
                    if held >= RUNS or sum(len(x.ids) for x in known.values()) >= WORDS:
                        names = list(own.ids)
                        tail = [names[i] for i in tail.tolist()]
                        yield from flush()
                        held = 0
                        own = known[lang] = _Language(lang)
                        tail = own.numbers(tail)
                    before = tail
        yield from flush()

    return run


def _filter(frequent: DataFrame) -> np.ndarray:
    """The bits of the hashes `h` of a table, put together by Spark; what is gathered has a fixed size at most."""
    mask = (1 << FILTER_BITS) - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("at")
    words = frequent.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def levels(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Frequent runs (lang, phrase, size, f) of 1 to `longest` words, and (lang, n): all words of each language."""
    spark = df.sparkSession
    small_batches(spark)
    said = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    bits, tables, totals = None, [], None
    for k in range(1, longest + 2):
        filled = spark.sparkContext.broadcast(bits)
        counted = said.mapInArrow(_told(k, k > longest, filled), "h long, lang string, gram string, n long")
        counted = counted.groupBy("h", "lang", "gram").agg(F.sum("n").alias("n"))
        level = materialize(counted.filter((F.col("n") >= support) | (F.col("h").isNull() & F.col("gram").isNull())), f"phrases-{k}")
        filled.destroy()
        exact = level.filter("gram IS NOT NULL").select("lang", F.col("gram").alias("phrase"), F.lit(k - 1).alias("size"), F.col("n").alias("f"))
        if k == 1:
            totals = level.filter("h IS NULL AND gram IS NULL").select("lang", "n")
        else:
            tables.append(exact)
        frequent = level.filter("h IS NOT NULL").select("h")
        if k <= longest and not frequent.limit(1).count():
            break
        bits = _filter(frequent) if k <= longest else None
    out = tables[0] if tables else exact
    for table in tables[1:]:
        out = out.unionByName(table)
    return out, totals


def _told(k: int, last: bool, filled):
    return lambda batches: _pass(k, last, filled.value)(batches)


def _run(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of `found` that no longer one covers."""
    longest = LONGEST if (top := found.agg(F.max("size")).head()[0]) is None else int(top)
    cand = found.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    part = lambda side, start, size: F.struct(F.lit(side).alias("side"), _run(F.col("w"), start, size).alias("part"))
    parts = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(part("l", F.lit(1), F.col("cut")), part("r", F.col("cut") + 1, F.col("size") - F.col("cut")))).alias("p")).select("lang", "phrase", "a", "cut", "p.side", "p.part")
    known = found.select(F.col("lang").alias("in"), F.col("phrase").alias("part"), "f")
    told = parts.join(known, (parts["lang"] == known["in"]) & (parts["part"] == known["part"])).select("lang", "phrase", "a", "cut", "side", "f", F.lit(None).cast("long").alias("longer"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _run(F.col("w"), i, k))))
    none = lambda t: F.lit(None).cast(t)
    held = cand.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), none("long").alias("a"), none("int").alias("cut"), none("string").alias("side"), none("long").alias("f"), F.col("a").alias("longer"))
    of = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("cut") == k), F.col("f"))).alias(f"{side}{k}")
    sums = told.unionByName(held).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *[of(side, k) for k in range(1, max(2, longest)) for side in "lr"])
    sums = sums.filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))

    def cut(k: int) -> Column:
        score = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.array(*[cut(k) for k in range(1, max(2, longest))]))
    return sums.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, covered: int = COVERED, per_lang: int = PER_LANG) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `per_lang` phrases of each language by score, occurrences and text."""
    found, totals = levels(df, text, lang, support, longest)
    best = scored(found, covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    top = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= per_lang)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= per_lang)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
