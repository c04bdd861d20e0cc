"""Exact removal of repeated byte spans, after suffix-array construction with a difference cover.

A byte goes if a LENGTH-byte string that covers it also starts elsewhere. Texts are kept
as blocks of bounded size; what blocks send each other are sorted keys, never text.

1. Cover sample. A difference cover modulo PERIOD picks about 6 % of the places of a text.
   For any two places there is a shift below PERIOD that takes both into the sample, so
   two equal LENGTH-byte strings contain equal WIDTH-byte strings at two sampled places.
   The sampled suffixes, cut to WIDTH bytes, are ranked: all that is used of a rank is
   whether another sampled suffix shares it.
2. Suffixes. A suffix can only be repeated to LENGTH bytes if a sampled suffix that
   begins in its first PERIOD bytes shares its rank. Most ties are thus settled by the
   ranks alone; the suffixes left get a LENGTH-byte key.
3. Marks. Places that their own WIDTH bytes choose are the same in equal strings, so all
   marks of a repeated suffix are shared. Suffixes with an unshared mark drop out before
   keys are sent; what is left is little more than the repeats themselves.
4. Buckets. Keys are sorted one bucket at a time (a bucket is of bounded size) and equal
   neighbours across all blocks mark the repeated strings.

Order beyond LENGTH bytes is never needed, so keys are hashes of the cut suffixes
(polynomials over random byte values, in prefix sums) instead of the suffixes themselves.
Equal strings always meet. Ranks and marks only nominate, so a collision there costs work
and nothing else. The keys that decide have 63 bits, and a second, independent hash names
their bucket: with b buckets, two of n different strings collide with probability
n**2 / 2**64 / b, and b grows with n.

The same steps run over words as over bytes: a passage is a run of at least
PASSAGE_WORDS words that also starts elsewhere. Passages are counted, not removed.
Words are what white space (blank and 0x09 to 0x0D) separates; WORD_BYTES bytes of a
longer one count as a word.

A message is one block's keys for one bucket; empty ones aren't sent, so there are never
more messages than keys. What a block found is sent along as runs of places for its next
step. Equal texts are stored once. Blocks hold equal texts together, after each task has
dropped its own repeats, so a text that many rows share moves twice a task at most.

Defined results: a null text counts as empty (nothing removed, hash of the empty
string); texts under LENGTH bytes lose nothing; repeated rows are copies and lose all
from LENGTH bytes on; overlaps count; every input row gives one row; further columns of
the input are not looked at, whatever their names. A text is one block at least, so a
task holds the longest text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .common import materialize, small_batches

#: Perfect difference sets (Singer): every difference modulo 307, or 31, occurs once.
COVER_307 = (0, 1, 3, 44, 56, 61, 67, 75, 82, 91, 95, 124, 160, 178, 200, 210, 237, 262)
COVER_31 = (0, 1, 3, 8, 12, 18)

LENGTH = 400
PERIOD = 307
COVER = np.array(COVER_307)
PASSAGE_WORDS = 50
WORD_BYTES = 256
#: Expected bytes of text in a block, keys in a bucket, and symbols of a text that are hashed at once.
BLOCK_BYTES = 12 << 20
BUCKET_KEYS = 2_000_000
SEGMENT = 1 << 20
#: Spark's own bound on the buckets of a table; beyond it a task gets several blocks.
MOST_FILES = 100_000

#: Symbols of a text from one place to another, as random 64-bit values.
Symbols = Callable[[int, int], np.ndarray]


@dataclass(frozen=True)
class Level:
    """What strings are made of: `length` symbols that must not repeat, their cover, and one of how many places is a mark."""

    length: int
    period: int
    cover: tuple[int, ...]
    every: int
    salt: int

    @property
    def width(self) -> int:
        return self.length - self.period + 1


BYTES = Level(LENGTH, PERIOD, COVER_307, 16, 0)
WORDS = Level(PASSAGE_WORDS, 31, COVER_31, 4, 0x5851F42D4C957F2D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LONGEST = SEGMENT + 1024
_UP = [_powers(b, _LONGEST) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), _LONGEST) for b in _BASES]
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def keys_at(symbols: Symbols, at: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit keys of the strings between the places `at` (sorted) and `ends`, a segment at a time."""
    up, down = _UP[which], _DOWN[which]
    out = np.empty(len(at), np.uint64)
    done = 0
    while done < len(at):
        lo = int(at[done])
        end = int(np.searchsorted(at, lo + SEGMENT))
        own, last = at[done:end] - lo, ends[done:end] - lo
        n = int(last.max())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols(lo, lo + n) * up[:n], out=sums[1:])
        out[done:end] = (sums[last] - sums[own]) * down[own]
        done = end
    out ^= out >> np.uint64(32)  # spreads the high bits' quality over all of the key
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def words(data: np.ndarray) -> np.ndarray:
    """A value for each word of a text."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    pieces = -(-(ends - starts) // WORD_BYTES)
    if len(pieces) and pieces.max() > 1:
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + (np.arange(len(first)) - first) * WORD_BYTES
        ends = np.minimum(starts + WORD_BYTES, np.repeat(ends, pieces))
    return keys_at(lambda lo, hi: _VALUES[data[lo:hi]], starts, ends)


def _within(n: int, at: np.ndarray, period: int) -> np.ndarray:
    """For each of the first n places, how many of `at` lie in the `period` places from it on."""
    step = np.zeros(n + period, np.int32)
    step[at + 1] = 1
    before = np.cumsum(step)
    return before[period : period + n] - before[:n]


def runs(places: np.ndarray) -> np.ndarray:
    """Sorted places as rows (first, one past the last)."""
    cut = np.flatnonzero(np.diff(places) > 1)
    first, last = places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]
    return np.stack([first, last + 1], axis=1).astype(np.int32) if len(places) else np.zeros((0, 2), np.int32)


def from_runs(rows: np.ndarray) -> np.ndarray:
    n = (rows[:, 1] - rows[:, 0]).astype(np.int64)
    return np.arange(int(n.sum())) + np.repeat(rows[:, 0] - (np.cumsum(n) - n), n)


def removed(n: int, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """Which of n symbols are covered by the strings at `places`, and the number of maximal runs."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    return gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0


class _Text:
    """One text at one level. Words are only looked for once a step needs them."""

    def __init__(self, level: Level, data: np.ndarray, copied: bool):
        self.level, self.data, self.copied = level, data, copied

    @cached_property
    def _words(self) -> np.ndarray:
        return words(self.data)

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        return _VALUES[self.data[lo:hi]] if self.level is BYTES else self._words[lo:hi]

    @property
    def n(self) -> int:
        return len(self.data if self.level is BYTES else self._words)

    @property
    def last(self) -> int:
        """Places from which a string begins."""
        return self.n - self.level.length + 1

    def keys(self, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        return keys_at(self.symbols, at, at + width, which) ^ np.uint64(self.level.salt)

    def sample(self) -> np.ndarray:
        """Places of the cover sample, if the text is long enough for a repeat."""
        n = self.n - self.level.width + 1 if self.last > 0 else 0
        at = (np.arange(-(-n // self.level.period))[:, None] * self.level.period + np.array(self.level.cover)[None, :]).ravel()
        return at[at < n]

    def tied(self, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Places whose string holds a sampled place of shared rank."""
        return np.flatnonzero(_within(self.last, at[shared], self.level.period) > 0) if shared.any() else np.zeros(0, np.int64)

    def marks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places near `places` that their own bytes choose, and their keys."""
        if not len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        near = np.zeros(self.n + 1, np.int32)
        np.add.at(near, places, 1)
        np.add.at(near, places + self.level.period, -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        key = self.keys(at, self.level.width)
        own = key % np.uint64(self.level.every) == 0
        return at[own], key[own]

    def narrowed(self, places: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Places whose string holds none of the unshared marks `alone`."""
        return places[_within(self.last, alone, self.level.period)[places] == 0] if len(places) else places


_ODD = np.uint64(1)


class _Sorted:
    """The distinct keys of a block in order of bucket and key. The lowest bit of a key gives way to a flag."""

    def __init__(self, texts: list[_Text], keys: list[np.ndarray], buckets: int, second: list[np.ndarray] | None = None):
        key = np.concatenate(keys) | _ODD if keys else np.zeros(0, np.uint64)
        twice = np.repeat(np.array([t.copied for t in texts], bool), [len(k) for k in keys])
        self.lens, bits = [len(k) for k in keys], (buckets - 1).bit_length()
        order = np.argsort(key)
        named = np.concatenate(second) if second else key
        bucket = (named >> np.uint64(64 - bits)).astype(np.int32) if bits and len(named) else np.zeros(len(key), np.int32)
        if second and bits:
            order = order[np.argsort(bucket[order], kind="stable")]
        key, bucket = key[order], bucket[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        group = np.cumsum(new) - 1
        self.group = np.empty(len(key), np.int64)
        self.group[order] = group
        self.keys, self.bucket = key[new], bucket[new]
        self.more = np.bincount(group, minlength=len(self.keys)) > 1
        self.more[self.group[twice]] = True

    def messages(self, block: int) -> pa.Table:
        """One row for each bucket that has keys of this block."""
        first = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if len(self.keys) else np.zeros(0, np.int64)
        sent = np.where(self.more, self.keys, self.keys ^ _ODD)  # the flag is the lowest bit
        ends = np.concatenate([first, [len(self.keys)]]) * 8
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(sent)]).cast(pa.binary())
        return _sent(block, self.bucket[first], blobs)

    def flags(self, info: pa.Table) -> list[np.ndarray]:
        """For each key of each text, what the buckets said."""
        info = info.sort_by("bucket")
        said = np.concatenate([np.frombuffer(f.as_buffer(), np.uint8) for f in info.column("data")] or [np.zeros(0, np.uint8)]).astype(bool)
        return np.split(said[self.group], np.cumsum(self.lens)[:-1]) if self.lens else []


def _sent(block: int, buckets: np.ndarray, data: pa.Array, item: np.ndarray | None = None, more: pa.Array | None = None) -> pa.Table:
    n = len(data)
    return pa.table([pa.array(np.full(n, block, np.int32)), pa.array(np.asarray(buckets, np.int32)), pa.array(np.asarray(np.zeros(n) if item is None else item, np.int32)), data, pa.nulls(n, pa.binary()) if more is None else more], names=["block", "bucket", "item", "data", "more"])


SENT = "block int, bucket int, item int, data binary, more binary"


class _Block:
    """A block's distinct texts, each over bytes and over words, and what is known about them."""

    def __init__(self, block: pa.Table, info: pa.Table):
        self.info = info
        n: dict[bytes, int] = {}
        seen: dict[bytes, np.ndarray] = {}
        for h, text in zip(block.column("h").to_pylist(), block.column("text"), strict=True):
            n[h] = n.get(h, 0) + 1
            if text.is_valid:
                seen[h] = np.frombuffer(text.as_buffer(), np.uint8)
        self.rows = sorted(seen.items(), key=lambda x: x[0])
        self.number = block.column("block")[0].as_py() if block.num_rows else 0
        self.texts: list[_Text] = []
        for h, data in self.rows:
            self.texts += [_Text(level, data, n[h] > 1) for level in (BYTES, WORDS)]

    def part(self, kind: int, state: bool = False) -> pa.Table:
        own = pc.equal(self.info.column("kind"), kind)
        return self.info.filter(pc.and_(own, (pc.less if state else pc.greater_equal)(self.info.column("bucket"), 0)))

    def _state(self, places: list[np.ndarray], marks: list[np.ndarray] | None = None) -> pa.Table:
        """What the next step goes on from; these rows pass by the buckets as they are."""
        own = [i for i, p in enumerate(places) if len(p)]
        more = pa.array([marks[i].astype(np.int32).tobytes() for i in own], pa.binary()) if marks else None
        return _sent(self.number, np.full(len(own), -1 - (self.number & 0x7FFFFFFF)), pa.array([runs(places[i]).tobytes() for i in own], pa.binary()), np.array(own), more)

    def _known(self, kind: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        info = self.part(kind, state=True)
        places, marks = [np.zeros(0, np.int64)] * len(self.texts), [np.zeros(0, np.int64)] * len(self.texts)
        for i, p, m in zip(info.column("item").to_pylist(), info.column("data").to_pylist(), info.column("more").to_pylist(), strict=True):
            places[i] = from_runs(np.frombuffer(p, np.int32).reshape(-1, 2))
            if m is not None:
                marks[i] = np.frombuffer(m, np.int32).astype(np.int64)
        return places, marks

    def send_sample(self, buckets: int) -> pa.Table:
        return self._sampled(buckets)[1].messages(self.number)

    def _sampled(self, buckets: int) -> tuple[list[np.ndarray], _Sorted]:
        at = [t.sample() for t in self.texts]
        return at, _Sorted(self.texts, [t.keys(a, t.level.width) for t, a in zip(self.texts, at, strict=True)], buckets)

    def send_marks(self, buckets: int) -> pa.Table:
        at, keys = self._sampled(buckets)
        places = [t.tied(a, f) for t, a, f in zip(self.texts, at, keys.flags(self.part(1)), strict=True)]
        marked = [t.marks(p) for t, p in zip(self.texts, places, strict=True)]
        sent = _Sorted(self.texts, [k for _, k in marked], buckets).messages(self.number)
        return pa.concat_tables([sent, self._state(places, [a for a, _ in marked])])

    def send_suffixes(self, buckets: int, of_marks: int) -> pa.Table:
        places, marks = self._known(2)
        keys = _Sorted(self.texts, [t.keys(a, t.level.width) for t, a in zip(self.texts, marks, strict=True)], of_marks)
        places = [t.narrowed(p, a[~f]) for t, p, a, f in zip(self.texts, places, marks, keys.flags(self.part(2)), strict=True)]
        return pa.concat_tables([self._suffixes(places, buckets).messages(self.number), self._state(places)])

    def _suffixes(self, places: list[np.ndarray], buckets: int) -> _Sorted:
        keys = [[t.keys(p, t.level.length, which) for t, p in zip(self.texts, places, strict=True)] for which in (0, 1)]
        return _Sorted(self.texts, keys[0], buckets, keys[1])

    def repeats(self, buckets: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, bytes, places of repeated strings of bytes, and of words) of each text."""
        places, _ = self._known(3)
        found = [p[f] for p, f in zip(places, self._suffixes(places, buckets).flags(self.part(3)), strict=True)]
        for i, (h, data) in enumerate(self.rows):
            yield h, data, found[2 * i], found[2 * i + 1]


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Sorts one bucket's keys of all blocks; a key is shared if a block says so or several blocks have it."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["block", "bucket", "item", "data", "more"])
    sent = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("data")]
    every = np.concatenate(sent)
    keys, at, n = np.unique(every | _ODD, return_inverse=True, return_counts=True)
    shared = n > 1
    shared[at[(every & _ODD).astype(bool)]] = True
    back = np.split(shared[at].astype(np.uint8), np.cumsum([len(k) for k in sent])[:-1])
    return table.select(["block", "bucket", "item"]).append_column("data", pa.array([b.tobytes() for b in back], pa.binary())).append_column("more", table.column("more"))


def _settled(sent: DataFrame, name: str) -> DataFrame:
    return materialize(sent.groupBy("bucket").applyInArrow(_sorted_bucket, SENT), name)


def block_name(number: int) -> int:
    """The int that Spark's hash (Murmur3 with seed 42) takes to `number`: as keys, such names deal blocks out evenly."""
    m = (1 << 32) - 1
    turn = lambda x, r: (x >> r | x << (32 - r)) & m
    back = lambda x, odd: x * pow(odd, -1, 1 << 32) & m
    h = number & m
    h = back(h ^ h >> 16, 0xC2B2AE35)
    h = back(h ^ h >> 13 ^ h >> 26, 0x85EBCA6B)
    h = turn(back((h ^ h >> 16 ^ 4) - 0xE6546B64, 5), 13) ^ 42
    h = back(turn(back(h, 0x1B873593), 15), 0xCC9E2D51)
    return h - (h >> 31 << 32)


def _blocks(df: DataFrame, n_blocks: int) -> DataFrame:
    """Distinct texts by block as a bucketed table: later passes group by block without moving text.

    A second row with a text's hash, without the text, says that it has copies.
    """
    spark, files = df.sparkSession, min(n_blocks, MOST_FILES)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            own, again = [], []
            for i, x in enumerate(b.column("h").to_pylist()):
                times = seen[x] = min(3, seen.get(x, 0) + 1)
                if times <= 2:
                    own.append(i)
                    again.append(times == 2)
            if own:
                rows = b.take(pa.array(own))
                names = [block_name(int.from_bytes(h[:6], "little") % n_blocks) for h in rows.column("h").to_pylist()]
                yield pa.record_batch([pa.array(names, pa.int32()), rows.column("h"), pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), rows.column("text"))], names=["block", "h", "text"])

    name, path = f"assayer_spans_{uuid.uuid4().hex[:12]}", shared_path(spark, "spans-blocks")
    texts = df.select("h", F.encode("t", "utf-8").alias("text")).mapInArrow(dealt, "block int, h binary, text binary")
    texts.repartition(files, "block").write.bucketBy(files, "block").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the plan knows how they are bucketed
    return table


def remove_repeats(df: DataFrame, text: str = "text", kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages; with `kept` also the remaining bytes."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")).withColumn("h", F.unhex(F.md5("t")))
    total = rows.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first()["n"] or 0
    # powers of two, so that leading bits name a bucket; about 9 % of a text's bytes begin sampled strings, up to a quarter candidates
    power = lambda n: 1 << max(0, (int(n) - 1).bit_length())
    sample_buckets, suffix_buckets = power(total * 0.09 / BUCKET_KEYS + 1), power(total / 4 / BUCKET_KEYS + 1)
    blocks = _blocks(rows, max(1, -(-total // BLOCK_BYTES)))

    def step(f: Callable[[_Block], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda block, info: f(_Block(block, info))

    def result(own: _Block) -> pa.Table:
        out: list[tuple] = []
        for h, data, places, passages in own.repeats(suffix_buckets):
            gone, n_spans = removed(len(data), places)
            said, n_passages = removed(int(passages[-1]) + PASSAGE_WORDS if len(passages) else 0, passages, PASSAGE_WORDS)
            left = data[~gone].tobytes()
            out.append((h, len(data), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), int(said.sum()), n_passages, left if kept else None))
        cols = list(zip(*out, strict=True)) or [[]] * len(DONE)
        return pa.table([pa.array(c, t) for c, t in zip(cols, DONE.values(), strict=True)], names=list(DONE))

    known = spark.createDataFrame([], f"kind int, {SENT}")
    together = lambda f, schema: blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(step(f), schema)
    steps = [(lambda b: b.send_sample(sample_buckets), "ranks"), (lambda b: b.send_marks(sample_buckets), "marks"), (lambda b: b.send_suffixes(suffix_buckets, sample_buckets), "suffixes")]
    for kind, (f, name) in enumerate(steps, 1):
        known = _settled(together(f, SENT), f"spans-{name}").select(F.lit(kind).alias("kind"), "*")
    schema = "h binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long, kept binary"
    done = together(result, schema)
    done = materialize(done if kept else done.drop("kept"), "spans-result")
    return rows.select("doc_id", "h").join(done, "h").drop("h")


DONE = {"h": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_words": pa.int64(), "n_passages": pa.int64(), "kept": pa.binary()}
