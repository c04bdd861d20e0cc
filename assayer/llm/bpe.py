"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary.

Pre-tokenisation runs no regular expression. Each code point becomes a symbol (its
class, with marks for contractions and for the last blank of a run), each symbol a
transition function over the few states of an automaton. Function composition is
associative, so the state before every code point comes from a blockwise scan: compose
within blocks, scan the blocks' functions, then apply within blocks from the known
states. A table over (state, symbol) says where pieces begin.

Pieces go through a cache; what it lacks is merged pair by pair, lowest rank first,
with a heap so that long pieces stay near linear. Token ids keep byte offsets, and
decoding turns ids alone back into bytes.

The pattern that the automaton implements is the one of the public byte-level
vocabularies: contractions 's 't 're 've 'm 'll 'd; an optional blank with letters,
numbers or other signs; white space, leaving its last blank to what follows.

Defined results: a null text counts as empty; an empty text has no ids (the hash of
the empty string); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import small_batches

#: Symbols: class codes of `chars` come first.
SYM_BLANK, SYM_QUOTE1, SYM_QUOTE2, SYM_START, SYM_LEAVE = 4, 5, 6, 7, 8
SYMBOLS = 9
#: States: what the piece so far ends with.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, NEED_TWO, NEED_ONE, DONE = range(9)
STATES = 9
BLOCK = 64
#: Code points that are scanned at once; texts are cut before blanks.
PIECE = 1 << 18
#: Pieces of a cache generation (two are kept), longest cached piece, and from where the heap is used.
CACHED_PIECES, CACHED_CHARS, LONG = 200_000, 64, 100
#: Rows that are encoded and sent on at once.
ROWS_OUT = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state."""
    to = np.zeros((SYMBOLS, STATES), np.uint8)
    cut = np.ones((SYMBOLS, STATES), bool)
    for sym, inside in ((chars.LETTER, IN_LETTERS), (chars.NUMBER, IN_NUMBERS), (chars.OTHER, IN_OTHER)):
        to[sym] = inside
        cut[sym, [inside, AFTER_BLANK]] = False
    for need, then in ((NEED_TWO, NEED_ONE), (NEED_ONE, DONE)):
        to[chars.LETTER, need] = then
        cut[chars.LETTER, need] = False
    for sym, need in ((SYM_QUOTE1, NEED_ONE), (SYM_QUOTE2, NEED_TWO)):
        to[sym] = need
        to[sym, [IN_OTHER, AFTER_BLANK]] = IN_OTHER  # within a run of signs a quote is a sign
        cut[sym, [IN_OTHER, AFTER_BLANK]] = False
    for sym, after in ((chars.SPACE, AFTER_SPACE), (SYM_BLANK, AFTER_BLANK)):
        to[sym] = after
        cut[sym, [AFTER_SPACE, AFTER_BLANK]] = False
    to[SYM_LEAVE] = AFTER_SPACE  # last of a longer run of white space that is no blank, before other text
    to[SYM_START] = BEGIN
    return to, cut


NEXT, CUT = _tables()


def _symbols(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text's code points, and which white space ends a run before other text."""
    sym = chars.classes()[p].copy()
    space = sym == chars.SPACE
    sym[p == 32] = SYM_BLANK
    n = len(p)
    leaving = np.zeros(n, bool)
    leaving[:-1] = space[:-1] & ~space[1:]
    quote = np.flatnonzero(p == 39)
    if len(quote):
        pad = np.concatenate([p, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[quote[one]] = SYM_QUOTE1
        sym[quote[two]] = SYM_QUOTE2
    return sym, leaving


def _states(sym: np.ndarray, state: int = BEGIN) -> np.ndarray:
    """State before each symbol, by a blockwise scan over transition functions."""
    n = len(sym)
    if n <= 4 * BLOCK:
        out = np.empty(n, np.uint8)
        for i, s in enumerate(sym.tolist()):
            out[i] = state
            state = _NEXT_LISTS[s][state]
        return out
    blocks = -(-n // BLOCK)
    rows = np.full(blocks * BLOCK, SYM_START, np.uint8)
    rows[:n] = sym
    rows = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    flat = NEXT.ravel().astype(np.intp)
    f = np.broadcast_to(np.arange(STATES), (blocks, STATES)).copy()  # each block's function so far
    for j in range(BLOCK):
        f = flat[rows[j][:, None] + f]
    start = _scan(f, state)
    out = np.empty((BLOCK, blocks), np.uint8)
    for j in range(BLOCK):
        out[j] = start
        start = flat[rows[j] + start]
    return out.T.reshape(-1)[:n]


_NEXT_LISTS = NEXT.tolist()


def _scan(f: np.ndarray, state: int) -> np.ndarray:
    """State before each block: an associative scan by doubling over the blocks' functions."""
    n = len(f)
    before = np.empty((n, STATES), np.intp)
    before[0] = np.arange(STATES)
    before[1:] = f[:-1]
    step = 1
    while step < n:
        before[step:] = np.take_along_axis(before[step:], before[:-step], axis=1)
        step *= 2
    return before[:, state]


def starts(p: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Indices of the code points where pieces begin.

    `heads` are indices of placeholder code points that stand before each of several
    joined texts; each is a piece of its own and cuts what lies on its two sides apart.
    """
    if not len(p):
        return np.zeros(0, np.int64)
    sym, leaving = _symbols(p)
    if heads is not None:
        sym[heads] = SYM_START
        leaving[heads[heads > 0] - 1] = False
    state = _states(sym)
    cut = CUT[sym, state]
    # a run's last white space stands apart from the rest of the run
    leaving &= (state == AFTER_BLANK) | (state == AFTER_SPACE)
    cut |= leaving
    cut[0] = True
    return np.flatnonzero(cut)


def pieces(text: str) -> Iterator[str]:
    """Texts of at most about PIECE code points, cut where white space follows other text (always a boundary)."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not (text[end] in " \n" and chars.classes()[ord(text[end - 1])] != chars.SPACE):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def groups(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(index of the text, part of it) in order, in groups of about PIECE code points."""
    out, size = [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            if out and size + len(part) > PIECE:
                yield out
                out, size = [], 0
            out.append((i, part))
            size += len(part)
    if out:
        yield out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all adjacent pairs the one of lowest rank (leftmost first) is merged, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    get, top = ranks.get, len(ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    near = [get(piece[i : i + 2], top) for i in range(len(piece) - 1)]
    while near and (low := min(near)) < top:
        i = near.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i:
            near[i - 1] = get(parts[i - 1] + parts[i], top)
        if i < len(near):
            near[i] = get(parts[i] + parts[i + 1], top)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, with a heap."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue  # one side has changed since
        j = end[i]
        alive[j] = False
        end[i] = to
        if to < n:
            before[to] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) is not None:
                heapq.heappush(heap, (x, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over the ranks of a tiktoken file; the cache is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.table = _Table(tokens)
        self.decimals = _Table([b"%d " % i for i in range(len(tokens))])
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    @classmethod
    def load(cls, lines: bytes) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())})

    def _ids(self, piece: str) -> list[int]:
        """Ids of a piece that the young cache lacks."""
        ids = self.old.get(piece)
        if ids is None:
            ids = merge(piece.encode(), self.ranks)
        if len(piece) <= CACHED_CHARS:
            if len(self.young) >= CACHED_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; short texts share a scan."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for group in groups(texts):
            joined = "".join("\0" + part for _, part in group)
            heads = np.cumsum([0] + [len(part) + 1 for _, part in group])
            at = starts(chars.points(joined), heads[:-1])
            bounds = np.searchsorted(at, heads).tolist()
            at = at.tolist() + [len(joined)]
            for (i, _), lo, hi in zip(group, bounds, bounds[1:], strict=False):
                got: list[int] = []
                add, get = got.extend, self.young.get
                for a, b in zip(at[lo + 1 : hi], at[lo + 2 : hi + 1], strict=True):
                    ids = get(piece := joined[a:b])
                    if ids is None:
                        ids = self._ids(piece)
                        get = self.young.get
                    add(ids)
                out[i].append(np.array(got, np.int32))
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, and its end."""
        return np.concatenate([[0], np.cumsum(self.table.lens[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of ids."""
        return self.table.join(ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.decimals.join(ids)[:-1]


class _Table:
    """Byte strings that numpy joins by index."""

    def __init__(self, strings: list[bytes]):
        self.lens = np.array([len(t) for t in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        out = []
        for k in range(0, len(ids), PIECE):
            own = ids[k : k + PIECE]
            lens = self.lens[own]
            ends = np.cumsum(lens)
            at = np.arange(int(ends[-1])) + np.repeat(self.offsets[own] - (ends - lens), lens)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


def encode(df: DataFrame, vocabulary: str, text: str = "text", tokens: bool = False, offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with `tokens` also ids, with `offsets` also where each token begins (bytes).

    `vocabulary` is the path of a tiktoken rank file; its bytes (a fixed size) are broadcast.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * tokens + ", token_starts array<long>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(shared.value)
        for b in (whole.slice(k, ROWS_OUT) for whole in batches for k in range(0, whole.num_rows, ROWS_OUT)):
            n, ids_sha, back_sha, all_ids, all_starts = [], [], [], [], []
            for ids in codec.encode_batch([t or "" for t in b.column("t").to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(codec.decimal(ids)).hexdigest())
                back_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if tokens:
                    all_ids.append(ids)
                if offsets:
                    all_starts.append(codec.token_offsets(ids)[:-1])
            more = [pa.array(all_ids, pa.list_(pa.int32()))] * tokens + [pa.array(all_starts, pa.list_(pa.int64()))] * offsets
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * tokens, *["token_starts"] * offsets])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)
