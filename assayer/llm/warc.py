"""WARC archives and their capture index by external merge.

Writing: each task writes one gzip-per-record .warc.gz file to shared storage and
returns its captures sorted by (URL key, timestamp, page): a run. Payloads that are
equal and of at least MIN_REVISIT bytes are stored once; the others become revisit
records that name the first. Runs are written as a table, so a file counts only if
its task's attempt was the one that was committed.

Index: captures are dealt into ranges of the whole key (a hot URL spreads over ranges by
time and page). Each range gets its slice of each run and merges the slices with a
tournament tree of losers; ranges in order form the global capture history.

Reading: each range reads its records from the archives by offset, checks payload digests
and returns one row per capture.

Defined results: a null html is an empty payload; rows with a null page_id are stored as
responses unless a row with an id has the same payload; repeated rows of the smallest id
are all responses; null URLs get the empty key. Archives stay in the folder given.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

MIN_REVISIT = 100
#: Captures of a merge range (expected), and records of an archive.
RANGE_ROWS = 20_000
#: pages have no time of capture: page_id seconds (modulo 20 years) after this day stand for it.
EPOCH, SPAN = datetime(2000, 1, 1, tzinfo=timezone.utc), 20 * 365 * 86400
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "url_key string, ts string, page_id long, path string, offset long, length long, seq long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without www and scheme, path and query in lower case."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + port + ")" + ((u.path or "/") + ("?" + u.query if u.query else "")).lower()


def timestamp(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % SPAN)


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; with `first` a revisit that stores the HTTP head alone."""
    when = timestamp(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", when),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", timestamp(first).strftime("%Y-%m-%dT%H:%M:%SZ")), ("X-Refers-To-Page", str(first))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, the root's winner comes out next."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        """Sends run i up from its leaf; an empty place on the way keeps it until its opponent comes."""
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.heads[win := self.losers[0]] is not None:
            yield self.heads[win]
            self.heads[win] = next(self.runs[win], None)
            self._play(win)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, n and first: the page that a row revisits, else null."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    firsts = own.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("c")).filter("c > 1").select("digest", "low")
    own = own.join(firsts, "digest", "left")
    return own.withColumn("first", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("low")), F.col("low"))).drop("low")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below `folder` (any URI that pyarrow.fs opens) and returns the runs, as a written table."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out = path = None
        captures, offset = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"  # an attempt's own file; only committed attempts are listed in the runs
                path, out = f"{base}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
            for page, url, payload, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                data = gzip.compress(record(page, url, payload, digest, first), 5, mtime=0)
                out.write(data)
                captures.append((url_key(url), timestamp(page).strftime("%Y%m%d%H%M%S"), page, path, offset, len(data)))
                offset += len(data)
        if out is not None:
            out.close()
            captures.sort(key=lambda c: (c[0], c[1], c[2] is not None, c[2] or 0, c[4]))
            for k in range(0, len(captures), 10_000):
                own = captures[k : k + 10_000]
                cols = [*zip(*own, strict=True), range(k, k + len(own))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["url_key", "ts", "page_id", "path", "offset", "length", "seq"])

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "first")
    return materialize(rows.mapInArrow(run, RUN), "warc-runs")


def merged(runs: DataFrame) -> DataFrame:
    """The runs as one capture history: partitions in order of (url_key, ts, page_id), each merged by a loser tree."""
    n = runs.count()
    parts = max(1, -(-n // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for b in batches:
            for c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                slices.setdefault(c[3], []).append((c[0], c[1], c[2] is not None, c[2] or 0, *c[2:]))
        out = [c[:2] + c[4:] for c in LoserTree(list(slices.values()))]
        for k in range(0, len(out), 10_000):
            cols = zip(*out[k : k + 10_000], strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    schema = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64())])
    # a slice keeps its run's order: within a range rows come sorted by (run, place in the run)
    ranged = runs.repartitionByRange(parts, "url_key", "ts", "page_id", "path").sortWithinPartitions("path", "seq")
    return ranged.mapInArrow(run, RUN)


def read(history: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the archives in the order of the history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            rows: list = [None] * len(places)
            file, at = None, None
            for i in sorted(range(len(places)), key=places.__getitem__):
                path, offset, length = places[i]
                if path != at:
                    if file is not None:
                        file.close()
                    file, at = fs.open_input_file(path), path
                fields, http, payload = parse(gzip.GzipFile(fileobj=io.BytesIO(file.read_at(length, offset))).read())
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest differs: {path} at {offset}")
                rows[i] = (int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, int(http["Content-Length"]), digest, fields["WARC-Type"], int(x) if (x := fields.get("X-Refers-To-Page")) else None)
            if file is not None:
                file.close()
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return history.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
