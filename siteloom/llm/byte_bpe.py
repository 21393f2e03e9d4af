"""Byte-level BPE encoding and decoding by a given rank file.

Text is cut into pieces without a regular expression.  Each code point gets a symbol class from
a table; each symbol is a transition function on a small state set, packed into one byte, and
functions are composed by an associative scan (one table look-up a composition), blocks first,
then block summaries.  States and neighbouring classes give the piece boundaries of a whole
batch at once.  Pieces then go through a cache of merged pieces.  Where a piece begins, in code
points and in tokens, can be kept, so that a span of a text is decoded from its own tokens only;
decoding is a gather over the vocabulary's bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_batches

# symbol classes of code points
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, START = range(7)
#: White space of the splitting pattern (fixed values: the Unicode property White_Space).
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# scan states: nothing pending, a fresh apostrophe, inside a two-letter contraction, contraction just ended
_REST, _FRESH, _INSIDE, _ENDED = range(4)
# scan symbols: resets to rest; fresh apostrophe; one-letter suffix; first of a two-letter suffix; any other letter
_S_RESET, _S_APOS, _S_ONE, _S_TWO, _S_LETTER = range(5)
_MOVES = {
    _S_RESET: (_REST, _REST, _REST, _REST),
    _S_APOS: (_FRESH, _FRESH, _FRESH, _FRESH),
    _S_ONE: (_REST, _ENDED, _ENDED, _REST),
    _S_TWO: (_REST, _INSIDE, _ENDED, _REST),
    _S_LETTER: (_REST, _REST, _ENDED, _REST),
}
#: A transition function packed into a byte: two bits for the image of each state.
_CODES = np.array([sum(to << (2 * s) for s, to in enumerate(_MOVES[k])) for k in range(5)], dtype=np.uint8)
_IDENTITY = np.uint8(sum(s << (2 * s) for s in range(4)))


@functools.cache
def _compose_table() -> np.ndarray:
    """table[f << 8 | g] = g after f."""
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), dtype=np.int64)
    for s in range(4):
        mid = (f >> (2 * s)) & 3
        out |= ((g >> (2 * mid)) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


def _after(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _compose_table()[(f.astype(np.uint16) << np.uint16(8)) | g]


def scan(codes: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan of packed transition functions under composition."""
    n = len(codes)
    if n <= width:
        out = codes.copy()
        for i in range(1, n):
            out[i : i + 1] = _after(out[i - 1 : i], codes[i : i + 1])
        return out
    rows = -(-n // width)
    grid = np.full(rows * width, _IDENTITY, dtype=np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = _after(grid[i - 1], grid[i])
    before = np.concatenate([np.array([_IDENTITY]), scan(grid[-1], width)[:-1]])
    for i in range(width):
        grid[i] = _after(before, grid[i])
    return grid.T.reshape(-1)[:n]


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_WHITE] = BLANK
    table[0x20] = SPACE
    table[0x27] = APOSTROPHE
    return table


def pieces(text: str, starts: np.ndarray) -> np.ndarray:
    """Sorted offsets (code points) at which a piece of ``text`` begins; documents begin at ``starts`` (sorted)."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cls = _classes()[code]
    head = np.zeros(n + 1, dtype=bool)
    head[starts] = True
    tail = head[1:].copy()
    tail[-1] = True  # last of a document
    head = head[:-1]
    prev = np.empty(n, dtype=np.uint8)
    prev[0] = START
    prev[1:] = cls[:-1]
    prev[head] = START
    is_letter, white = cls == LETTER, (cls == SPACE) | (cls == BLANK)
    following = np.zeros(n, dtype=code.dtype)
    following[:-1] = code[1:]
    following[tail] = 0
    symbol = np.where(is_letter, _S_LETTER, _S_RESET).astype(np.uint8)
    symbol[(cls == APOSTROPHE) & (prev != SPACE) & (prev != OTHER) & (prev != APOSTROPHE)] = _S_APOS
    ascii_letters = np.flatnonzero(is_letter & (code < 128))
    c, f = code[ascii_letters], following[ascii_letters]
    symbol[ascii_letters[(c == ord("s")) | (c == ord("t")) | (c == ord("m")) | (c == ord("d"))]] = _S_ONE
    symbol[ascii_letters[(((c == ord("r")) | (c == ord("v"))) & (f == ord("e"))) | ((c == ord("l")) & (f == ord("l")))]] = _S_TWO
    moves = _CODES[symbol]
    # a document's first symbol starts from rest whatever came before: make it constant
    at = np.flatnonzero(head)
    moves[at] = (moves[at] & 3) * np.uint8(0b01010101)
    state = scan(moves) & 3  # from rest
    was = np.empty(n, dtype=np.uint8)
    was[0] = _REST
    was[1:] = state[:-1]
    was[head] = _REST
    group, prev_group = cls.copy(), prev.copy()
    group[cls == APOSTROPHE] = OTHER
    prev_group[prev == APOSTROPHE] = OTHER
    prev_white = (prev == SPACE) | (prev == BLANK)
    suffix = (was == _FRESH) & ((symbol == _S_ONE) | (symbol == _S_TWO))
    solid = ~white & (prev != SPACE) & ((group != prev_group) & ~suffix | (was == _ENDED) & is_letter)
    next_solid = np.zeros(n, dtype=bool)
    next_solid[:-1] = ~white[1:]
    next_solid[tail] = False
    blank = white & (~prev_white | next_solid)
    return np.flatnonzero(head | solid | blank)


class Merger(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes; merged once while it stays cached."""

    LIMIT = 250_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        out = np.array(self.merge(raw), dtype="<u4").tobytes()
        if len(raw) <= 64:  # long ones hardly come again
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = out
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: a heap of pairs over a linked list of parts."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


class Codec:
    """Encoder and decoder for one rank file (base64 token and rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merger = Merger(self.ranks)
        size = max(self.ranks.values()) + 1
        vocabulary = [b""] * size
        for token, rank in self.ranks.items():
            vocabulary[rank] = token
        self.lengths = np.array([len(t) for t in vocabulary], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """As ``encode_batch`` for any number of texts of any length: BLOCK code points or little more are held at once.

        A longer text is cut before white space that follows something else, where a piece always begins."""
        for block in _blocks(texts):
            if len(block) > 1 or len(block[0]) <= BLOCK:
                yield from self.encode_batch(block)
                continue
            ids, starts, tokens, done = [], [], [], 0
            for part in _parts(block[0]):
                [(own, begins, first)] = self.encode_batch([part])
                starts.append(begins + done)
                tokens.append(first + sum(map(len, ids)) // 4)
                ids.append(own)
                done += len(part)
            yield b"".join(ids), np.concatenate(starts), np.concatenate(tokens)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text: its ids as bytes, the code points at which its pieces begin, and the first token of each piece."""
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        stops = np.cumsum(lengths)
        starts = stops - lengths
        cut = pieces(joined, starts[lengths > 0])
        first, last = np.searchsorted(cut, starts), np.searchsorted(cut, stops)
        edges = [*cut.tolist(), len(joined)]
        merged, out = self.merger, []
        for a, b, s in zip(first.tolist(), last.tolist(), starts.tolist(), strict=True):
            if lengths[len(out)] == 0:
                out.append((b"", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
                continue
            own = edges[a : b + 1]
            parts = [merged[joined[i:j]] for i, j in zip(own, own[1:], strict=False)]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
            out.append((b"".join(parts), cut[a:b] - s, np.cumsum(sizes) - sizes))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: token lengths give each byte's place in the vocabulary."""
        i = np.frombuffer(ids, dtype="<u4")
        lengths = self.lengths[i]
        stops = np.cumsum(lengths)
        if not len(stops):
            return b""
        shift = np.repeat(self.begins[i] - (stops - lengths), lengths)
        return self.bytes[shift + np.arange(stops[-1])].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


#: Code points encoded at once.
BLOCK = 1_000_000
_BLANKS = "".join(map(re.escape, map(chr, _WHITE)))
_EDGE = re.compile(f"(?<=[^{_BLANKS}])[{_BLANKS}]")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of BLOCK code points, each up to the next white space after anything else."""
    at = 0
    while at < len(text):
        cut = _EDGE.search(text, at + BLOCK)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _encoder(path: str, names: list[str], keep_ids: bool, columns: list[str], offsets: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(columns.index("text")).to_pylist()]
            n, ids_sha, text_sha, kept, begins, firsts = [], [], [], [], [], []
            for ids, starts, first in own.encode(texts):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                if offsets:
                    begins.append(starts.astype(np.int32))
                    firsts.append(first.astype(np.int32))
            cols = [batch.column(i) for i in range(len(columns))] if keep_ids else [batch.column(columns.index("doc_id"))]
            more = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if keep_ids:
                more.append(pa.array(kept, pa.list_(pa.int32())))
            if offsets:
                more += [pa.array(begins, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=names)

    return run


def _add(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


_DIGESTS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """The documents with n_tokens, ids_sha256, decoded_sha256 and ids (array of int).

    ``offsets``: also piece_starts and piece_tokens (arrays of int), the code point and the token at
    which each piece begins, for ``decode_span``.
    ``path``: the rank file, present on every executor.  Each piece of the splitting pattern is
    merged by itself; no special tokens.  A null text is as an empty one: no ids.  Other columns
    pass through; columns of the input with the names added are replaced.
    """
    bounded_batches(docs.sparkSession)
    places = ["piece_starts", "piece_tokens"] if offsets else []
    docs = docs.drop("ids", *places, *(n for n, _ in _DIGESTS))
    schema = _add(docs.schema, [*_DIGESTS, *((n, T.ArrayType(T.IntegerType())) for n in ("ids", *places))])
    return docs.mapInArrow(_encoder(path, schema.names, True, docs.columns, offsets), schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode``, the ids staying in the task."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = _add(T.StructType([docs.schema["doc_id"]]), _DIGESTS)
    return docs.mapInArrow(_encoder(path, schema.names, False, docs.columns), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the text of the ids (invalid UTF-8 replaced); null ids give null."""

    @F.pandas_udf(T.StringType())
    def text(ids):
        own = codec(path)
        return ids.map(lambda x: None if x is None else own.decode(np.asarray(x, dtype="<u4").tobytes()).decode("utf-8", "replace"))

    return encoded.withColumn(to, text(ids))


def decode_span(encoded: DataFrame, path: str, start: int, length: int, to: str = "span") -> DataFrame:
    """Adds ``to``: ``length`` code points of the text from ``start``, from the tokens of the pieces that hold them alone.

    ``encoded`` holds ids, piece_starts and piece_tokens; a span beyond the text is cut, null ids give null."""

    @F.pandas_udf(T.StringType())
    def text(ids, starts, tokens):
        own = codec(path)

        def one(i, s, t):
            if i is None:
                return None
            a, b = np.searchsorted(s, start, "right") - 1, np.searchsorted(s, start + length, "left")
            if not len(s) or a < 0 or b <= a:
                return ""
            part = np.asarray(i, dtype="<u4")[t[a] : t[b] if b < len(t) else None]
            return own.decode(part.tobytes()).decode("utf-8", "replace")[start - s[a] :][:length]

        return pd.Series([one(i, s, t) for i, s, t in zip(ids, starts, tokens, strict=True)], dtype=object)

    return encoded.withColumn(to, text("ids", "piece_starts", "piece_tokens"))
