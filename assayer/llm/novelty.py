"""Secrets by novelty: what a string adds to the size of its surroundings once compressed.

Patterns propose strings: assignments to sensitive names, access ids and long hexadecimal
runs, and any other long run of key characters with a sensitive word shortly before it. Each is
measured: its surroundings are compressed with and without it by zstandard, primed with a
dictionary of identifiers, and the difference is its marginal size. A name, a path or a word costs
little next to the code around it and the dictionary; random characters cost nearly their own
length. What the base patterns find always stays; of the others those are
reported whose marginal bytes per character reach NOVEL.

The dictionary is made of the identifiers that most documents use, counted over all
documents; its size is bounded by IDENTIFIERS, however large the corpus is.

Offsets are code points, ends exclusive. Defined results: a null text counts as empty and has no
spans; texts of any length are scanned whole in time proportional to their length; repeated rows give repeated
results; without documents the dictionary is empty; other columns are left as they are, whatever their
names, but the column of spans replaces one of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Identifiers of the dictionary, and distinct ones after which a task sends its counts.
IDENTIFIERS, HELD = 4096, 300_000
IDENTIFIER = re.compile(r"[A-Za-z_]{4,40}")
#: Characters before and after a string that count as its surroundings, and how near a sensitive word has to be.
BEFORE, AFTER, NEAR = 256, 128, 48
#: Marginal bytes a character from which a string is reported.
NOVEL = 0.8
LEVEL = 9

# The base patterns, by kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a string suspicious, and the kind of what is reported for its novelty.
SENSITIVE = re.compile(r"passphrase|password|passwd|\bpwd\b|secret|token|api.?key|access.?key|private.?key|credential|authori[sz]ation|bearer|\bauth\b|signature|\bsalt\b|session.?id|cookie", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
CLASSES = (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))
ADDED = "novel"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("bytes", T.IntegerType()), T.StructField("novelty", T.DoubleType())]))


def base(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret itself) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def suspects(text: str, found: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters shortly after a sensitive word that no base span overlaps."""
    taken, k = sorted((s, e) for _, s, e, _, _ in found), 0
    for m in RUN.finditer(text):
        if not _mixed(m.group()) or not SENSITIVE.search(text, max(0, m.start() - NEAR), m.start()):
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not (k < len(taken) and taken[k][0] < m.end()):
            yield m.span()


def _mixed(run: str) -> bool:
    """Whether a run has digits and letters, or letters of both cases inside."""
    return sum(c.search(run) is not None for c in CLASSES) >= 2


class Meter:
    """Marginal sizes against surroundings and a dictionary."""

    def __init__(self, dictionary: bytes):
        own = {}
        if len(dictionary) >= 8:
            own["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own["dict_data"].precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **own)

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes that text[start:end] adds to what surrounds it."""
        before, own, after = (text[a:b].encode("utf-8", "surrogatepass") for a, b in ((max(0, start - BEFORE), start), (start, end), (end, end + AFTER)))
        return max(0, len(self.press.compress(before + own + after)) - len(self.press.compress(before + after)))

    def spans(self, text: str | None) -> list[dict]:
        text = text or ""
        found = base(text)
        out = [(kind, s, e, self.marginal(text, a, b), b - a) for kind, s, e, a, b in found]
        for s, e in suspects(text, found):
            size = self.marginal(text, s, e)
            if size >= NOVEL * (e - s):
                out.append((ADDED, s, e, size, e - s))
        order = (*KINDS, ADDED)
        out.sort(key=lambda x: (x[1], order.index(x[0])))
        return [{"kind": kind, "start": s, "end": e, "bytes": n, "novelty": n / size} for kind, s, e, n, size in out]


def dictionary(df: DataFrame, text: str = "text", size: int = IDENTIFIERS) -> bytes:
    """The `size` identifiers that most documents use, the most frequent last, where zstandard reaches them most cheaply."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        row = lambda: pa.record_batch([pa.array(list(counts)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["word", "n"])
        for b in batches:
            for t in b.column("t").to_pylist():
                counts.update(set(IDENTIFIER.findall(t or "")))
                if len(counts) >= HELD:
                    yield row()
                    counts.clear()
        if counts:
            yield row()

    counted = df.select(F.col(text).alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


def with_secrets(df: DataFrame, known: bytes, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, bytes, novelty>> in order of start, then kind. known: a dictionary."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out]
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(f"`{text}`").alias("t"))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.int32()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(known)
        for b in batches:
            yield pa.record_batch([b.column("row"), pa.array([meter.spans(t) for t in b.column("t").to_pylist()], arrow)], names=["row", "found"])

    found = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("found", SPANS)]))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], F.col("found").alias(out))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, spans: str = "secrets") -> DataFrame:
    """doc_id, counts by base kind, hash of the base spans, all spans as text, and their marginal bytes in the same order."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    own = spans_text(F.filter(s, lambda x: x["kind"].isin(*KINDS)))
    return df.select("doc_id", *[count(k) for k in KINDS], F.sha2(own, 256).alias("base_sha256"), spans_text(s).alias("spans"), F.array_join(F.transform(s, lambda x: x["bytes"].cast("string")), ",").alias("marginal_bytes"))
