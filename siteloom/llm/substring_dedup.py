"""Substring deduplication by prefix-partitioned suffix trees over words.

A suffix of a document is followed as deep as the window.  Prefixes of growing length split the
suffixes into groups that fit in memory: a first pass counts suffixes in buckets of prefix hashes,
for several lengths; a suffix belongs to the shortest prefix whose bucket is small enough, and one
whose whole window is still too common is dealt by document as well.  A partition holds whole
groups.  Sorted by their words, the leaves of each subtree stand in order, and the words that a
leaf shares with the one before it (its LCP) tell the internal nodes: where that reaches the
window, both hang below one deep node, a repeat, whose first leaf is of the earliest document.
Deep nodes of consecutive suffixes follow each other by suffix links, so a document's overlapping
windows join to its maximal repeats.

Only suffixes that can repeat enter a tree: each window has an anchor, the word 5-gram of least
hash in it, which equal windows share; anchors seen in one document only rule their windows out.
Whole copies of an earlier text are settled by their text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import WordHashes, bounded_batches, discard, materialise, mix, prefixes, row_key, same, windows

ANCHOR = 5
#: Words of the shortest prefix, and by how much it grows.
PREFIX, GROW = 4, 3
#: Suffixes that a group of one prefix may hold, at most and at least; most buckets in which they are counted, a length.
GROUP, LEAST, BUCKETS = 1 << 18, 1 << 11, 1 << 20
#: Bytes of the hash that stands for a word in a suffix, and of the window's own hash, which confirms a deep node.
WORD_BYTES, CHECK = 2, 5
_LAST = (1 << 63) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def lengths(window: int) -> list[int]:
    """Prefix lengths, shortest first; the last is the window."""
    return [*range(min(PREFIX, window), window, GROW), window]


def sizes(suffixes: int, partitions: int) -> tuple[int, int]:
    """Suffixes that a group may hold, a quarter of a partition within bounds; and buckets, a power of two, four or more for each group."""
    group = max(1, min(GROUP, max(LEAST, suffixes // (4 * partitions))))
    buckets = min(BUCKETS, max(64, 1 << (4 * suffixes // group).bit_length()))
    return max(group, 4 * suffixes // buckets), buckets


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _profile(window: int, buckets: int):
    """Two kinds of rows: (0, anchor, row, windows from and to), one for each run of windows with one anchor;
    and (prefix length, bucket, null, suffixes), once a task: a bounded array of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        counts = {k: np.zeros(buckets, dtype=np.int64) for k in lengths(window)}
        for batch in batches:
            w, n = hashes.of_texts(batch.column(1).to_pylist())
            if len(w) < window:
                continue
            doc = np.repeat(np.arange(len(n)), n)
            inside = doc[: len(w) - window + 1] == doc[window - 1 :]
            grams = None
            for k, h in prefixes(w, sorted({ANCHOR, *counts}), 1):
                if k == ANCHOR:
                    grams = h
                if k in counts:
                    counts[k] += np.bincount((h[: len(inside)][inside] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
            anchor = _least(grams, window - ANCHOR + 1)
            doc = doc[: len(inside)]
            begins = inside.copy()
            begins[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(begins)
            own = doc[first]
            start = (np.cumsum(n) - n)[own]
            # a run ends before the next one, or with its document's last window
            stop = np.minimum(np.append(first[1:], len(inside)), start + n[own] - window + 1) - 1
            yield _rows(np.zeros(len(first), dtype=np.int32), anchor[first].view(np.int64), batch.column(0).take(pa.array(own)), ((first - start) << 32) | (stop - start))
        for k, seen in counts.items():
            held = np.flatnonzero(seen)
            yield _rows(np.full(len(held), k, dtype=np.int32), held, pa.nulls(len(held), pa.int64()), seen[held])

    return run


def _rows(length: np.ndarray, key: np.ndarray, rk: pa.Array, span: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(length), pa.array(key), rk, pa.array(span)], names=["length", "key", "rk", "span"])


class Splits:
    """Which prefix a suffix is grouped by: buckets that hold too many are marked at every length but the
    last, and at the last they have the number of parts into which documents are dealt."""

    def __init__(self, window: int, buckets: int, heavy: dict[int, tuple[np.ndarray, np.ndarray]], group: int):
        self.window, self.buckets = window, buckets
        self.full = {}
        for k in lengths(window):
            at, n = heavy.get(k, (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
            parts = np.zeros(buckets, dtype=np.int64)
            parts[at] = -(-n // group)
            self.full[k] = parts

    def keys(self, w: np.ndarray, at: np.ndarray, rk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the suffixes at ``at`` of the word hashes w, of rows rk: the key of their group, and whether its documents are dealt."""
        key, dealt = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=bool)
        open_ = np.arange(len(at))
        for k, every in prefixes(w, lengths(self.window), 1):
            if not len(open_):
                break
            h = every[at[open_]]
            parts = self.full[k][(h & np.uint64(self.buckets - 1)).astype(np.int64)]
            if k == self.window:
                dealt[open_] = parts > 0
                h = np.where(parts > 0, mix(h + _GOLD * (1 + rk[open_] % np.maximum(parts, 1)).astype(np.uint64)), h)
            key[open_] = h
            open_ = open_[parts > 0]
        return key, dealt


def _split(profile: DataFrame, window: int, buckets: int, group: int) -> Splits:
    """The driver holds the buckets that are too full: about a quarter of BUCKETS at most for each length."""
    full = profile.where("length > 0").groupBy("length", "key").agg(F.sum("span").alias("n")).where(F.col("n") > group).toPandas()
    heavy = {int(k): (rows["key"].to_numpy(), rows["n"].to_numpy()) for k, rows in full.groupby("length")}
    return Splits(window, buckets, heavy, group)


def _suffixes(splits: Splits):
    """The suffixes that begin in the given spans of windows: key of the group; whether it is dealt, the words after the
    shortest prefix and the window's hash; document, row and place.  A row equal to the one before it adds none."""
    window = splits.window
    skip = lengths(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        before = None
        for batch in batches:
            docs, rks = (batch.column(i).to_numpy() for i in range(2))
            if not len(docs):
                continue
            fresh = np.ones(len(docs), dtype=bool)
            fresh[1:] = (docs[1:] != docs[:-1]) | (rks[1:] != rks[:-1])
            fresh[0] = before != (docs[0], rks[0])
            before = (docs[-1], rks[-1])
            w, n = hashes.of_texts(batch.column(2).to_pylist())
            start, most = np.cumsum(n) - n, np.maximum(n - window + 1, 0)
            spans, own = batch.column(3).flatten().to_numpy(), np.repeat(np.arange(len(docs)), batch.column(3).value_lengths().to_numpy())
            spans, own = spans[fresh[own]], own[fresh[own]]
            edge = np.zeros(len(w) + 1, dtype=np.int32)
            np.add.at(edge, start[own] + np.minimum(spans >> 32, most[own]), 1)
            np.add.at(edge, start[own] + np.minimum((spans & 0xFFFFFFFF) + 1, most[own]), -1)
            at = np.flatnonzero(edge.cumsum() > 0)
            if not len(at):
                continue
            own = np.repeat(np.arange(len(docs)), n)[at]
            key, dealt = splits.keys(w, at, rks[own])
            short = w.astype("<u8").view("<u2")[:: 8 // WORD_BYTES]
            row = np.empty((len(at), 1 + WORD_BYTES * (window - skip) + CHECK), dtype=np.uint8)
            row[:, 0] = dealt
            for i in range(skip, window):
                row[:, 1 + WORD_BYTES * (i - skip) : 1 + WORD_BYTES * (i - skip + 1)] = short[at + i].view(np.uint8).reshape(-1, WORD_BYTES)
            row[:, -CHECK:] = windows(w, window, 2)[at].view(np.uint8).reshape(-1, 8)[:, :CHECK]
            suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(row.shape[1]), len(row), [None, pa.py_buffer(row)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), suffix, pa.array(docs[own]), pa.array(rks[own]), pa.array((at - start[own]).astype(np.int32))], names=["key", "suffix", "doc", "rk", "pos"]
            )

    return run


_DROP, _OPEN, _EDGE = 0, 1, 2
_LEAVES = "key long, suffix binary, doc long, rk long, pos int"


def lcp(suffixes: np.ndarray) -> np.ndarray:
    """Words (after the shortest prefix) that each row shares with the row before it; one more where the whole windows agree.

    suffixes: rows of bytes, sorted, of one subtree.  Internal nodes of the tree are the runs of rows at or above a depth."""
    tail = (suffixes.shape[1] - 1 - CHECK) // WORD_BYTES
    equal = np.ones((len(suffixes), tail + 1), dtype=bool)
    words = suffixes[:, 1 : 1 + tail * WORD_BYTES].reshape(len(suffixes), tail, WORD_BYTES)
    equal[1:, :tail] = (words[1:] == words[:-1]).all(axis=2)
    equal[1:, tail] = (suffixes[1:, -CHECK:] == suffixes[:-1, -CHECK:]).all(axis=1)
    equal[0] = False
    return np.where(equal.all(axis=1), tail + 1, equal.argmin(axis=1))


def _walk_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of whole subtrees in order.  A leaf below a deep node goes if its document comes after the
    node's first one.  Where a group is dealt into parts, the first document's leaves stay open and the
    node leaves an edge with that document."""
    last, low = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, doc, suffixes = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1)
        width = len(suffixes[0].as_py())
        begin = np.frombuffer(suffixes.buffers()[1], dtype=np.int32)[suffixes.offset]
        suffix = np.frombuffer(suffixes.buffers()[2], dtype=np.uint8)[begin : begin + n * width].reshape(n, width)
        deep = lcp(suffix) > (width - 1 - CHECK) // WORD_BYTES
        deep[1:] &= key[1:] == key[:-1]
        deep[0] = last == (key[0], suffix[0].tobytes())
        begins = np.flatnonzero(~deep)
        first = np.concatenate([[low], doc[begins]])[np.cumsum(~deep)]
        dealt = suffix[:, 0] > 0
        state = np.where(doc > first, _DROP, np.where(dealt, _OPEN, -1)).astype(np.int32)
        keep = np.flatnonzero(state >= 0)
        yield _nodes(batch.take(pa.array(keep)), state[keep])
        edges = begins[dealt[begins]]
        if len(edges):
            yield _nodes(batch.take(pa.array(edges)), np.full(len(edges), _EDGE, dtype=np.int32))
        last, low = (key[-1], suffix[-1].tobytes()), first[-1]


def _nodes(rows: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
    """Leaves with their state; only open ones and edges still need their suffix."""
    suffix = pa.array(rows.column(1).to_pylist() if state.any() else [None] * len(state), pa.binary())
    return pa.RecordBatch.from_arrays([suffix, *rows.columns[2:], pa.array(state)], names=["suffix", "doc", "rk", "pos", "state"])


def _copies(keyed: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, rk of documents whose whole text (by 128 bits of hashes and its length) is that of a document
    with a smaller doc_id; and the bytes of all texts."""
    narrow = keyed.select("doc_id", "rk", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("len"))
    narrow = materialise(narrow, "texts")
    text = ["h", "h2", "len"]
    groups = narrow.groupBy(*text).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1 and low is not null").drop("n")
    # a table of its own, so that the join can broadcast it or split a very large group of copies
    groups = materialise(groups, "copied-texts")
    later = narrow.join(groups, text).where(F.coalesce(F.col("doc_id") > F.col("low"), F.lit(True)))
    copies, size = materialise(later.select("doc_id", "rk").distinct(), "copies"), narrow.agg(F.sum("len")).first()[0] or 0
    discard(narrow, groups)
    return copies, size


def _partitions(spark: SparkSession, suffixes: int) -> int:
    """Partitions of about a million suffixes, as many as the session shuffles into at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // (1 << 20)))


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, rk, whole (boolean), starts (array of int) of documents with windows that also
    start in a document with a smaller doc_id; whole: all of the text is such a copy, and starts is null.

    A null doc_id counts as the largest; rows equal in doc_id and text are one document.  Windows are
    equal if 64 bits of hashes of the prefix, 16 of each other word and 40 of the window agree.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", row_key())
    bounded_batches(keyed.sparkSession)
    copies, size = _copies(keyed)
    suffixes = size // 6 + 1  # about as many as words
    partitions = _partitions(docs.sparkSession, suffixes)
    group, buckets = sizes(suffixes, partitions)
    profile = keyed.select("rk", F.col("text").cast("binary").alias("text")).mapInArrow(_profile(window, buckets), "length int, key long, rk long, span long")
    profile = materialise(profile, "profile")
    anchors = profile.where("length = 0").select(F.col("key").alias("anchor"), "rk", "span")
    # a table of its own, so that a very common anchor's rows can be split among tasks of the join
    shared = materialise(anchors.groupBy("anchor").agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a <> b").select("anchor"), "shared-anchors")
    spans = anchors.join(shared, "anchor").groupBy("rk").agg(F.collect_set("span").alias("spans")).withColumnRenamed("rk", "k")
    spans = materialise(spans.join(copies.select(F.col("rk").alias("k")), "k", "left_anti"), "spans")
    splits = _split(profile, window, buckets, group)
    discard(profile, shared)
    texts = keyed.join(spans, F.col("rk") == F.col("k")).select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "rk", F.col("text").cast("binary").alias("text"), "spans")
    leaves = texts.mapInArrow(_suffixes(splits), _LEAVES).repartition(partitions, "key")
    trees = leaves.sortWithinPartitions("key", "suffix", "doc").mapInArrow(_walk_leaves, "suffix binary, doc long, rk long, pos int, state int")
    nodes = materialise(trees, "nodes")
    discard(spans)
    # what is left open: one document's leaves and one edge for each part of a dealt group's node
    edges = nodes.where(F.col("state") == _EDGE).groupBy("suffix").agg(F.min("doc").alias("low"))
    settled = nodes.where(F.col("state") == _OPEN).join(edges, "suffix").where(F.col("doc") > F.col("low"))
    dropped = nodes.where(F.col("state") == _DROP).select("doc", "rk", "pos").union(settled.select("doc", "rk", "pos"))
    found = dropped.groupBy("doc", "rk").agg(F.collect_set("pos").alias("starts"))
    found = found.select(F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "rk", F.lit(False).alias("whole"), "starts")
    return found.union(copies.select("doc_id", "rk", F.lit(True), F.lit(None).cast("array<int>")))


def _strip(window: int, columns: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, repeats = [], [], [], []
            whole = batch.column(batch.schema.get_field_index("__whole")).to_pylist()
            for text, all_of_it, starts in zip(batch.column(batch.schema.get_field_index("__t")).to_pylist(), whole, batch.column(batch.schema.get_field_index("__starts")), strict=True):
                words = (text or b"").split()
                n = len(words)
                cover = np.zeros(n + 2, dtype=np.int32)
                if all_of_it:
                    cover[1] = n >= window
                elif starts.is_valid:
                    at = starts.values.to_numpy() + 1
                    cover[at] += 1
                    cover[at + window] -= 1
                cover = cover.cumsum() > 0
                cover[n + 1 :] = False
                gone = cover[1 : n + 1]
                left = b" ".join([words[i] for i in np.flatnonzero(~gone)]) if gone.any() else b" ".join(words)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"))
                if not digest:
                    ends = np.flatnonzero(np.diff(cover.astype(np.int8))).tolist()
                    repeats.append([{"start": a, "words": b - a} for a, b in zip(ends[::2], ends[1::2], strict=True)])
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            more = [pa.array(kept, pa.string())]
            if not digest:
                more.append(pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))))
            names = [*columns, "n_words", "n_removed", *(["kept_sha256"] if digest else ["text", "repeats"])]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *more], names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, digest: bool = False) -> DataFrame:
    """The documents with n_words, n_removed, the words left, joined by a space, as text, and
    repeats: array of (start, words), the maximal runs of words that went.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id; windows are those of the input.  Words are runs without ASCII white space,
    unchanged; a null text has none.  ``digest``: kept_sha256 of the words left in place of text and repeats.
    Rows repeat as they come in.  Other columns pass through, doc_id as long; n_words, n_removed,
    repeats and kept_sha256 of the input are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "repeats")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = repeated_windows(docs, window).withColumnsRenamed({"whole": "__whole", "starts": "__starts"})
    keyed = docs.withColumns({"__t": F.col("text").cast("binary"), "__rk": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))}).drop("text")
    joined = same(keyed, found, key="__rk")
    columns = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    out = f"{kinds}, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string, repeats array<struct<start:int,words:int>>")
    return joined.select(*(F.col(f"`{c}`") for c in columns), "__t", "__whole", "__starts").mapInArrow(_strip(window, columns, digest), out)
