"""Line deduplication over a corpus.

Hashes of line keys are range-partitioned by (hash, document), sorted within each partition by
document and position, and streamed once.  What comes back is no text but one compressed bitmap
per document that loses lines.  As the range key holds the document too, a line that a third of
all documents share is spread over many partitions; only the first and last run of a partition
can go on in another one, so two summary rows a partition settle those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import FEW_SAMPLES, bounded_batches, materialise, row_key, same

_STRIP = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc_id long, rk long, pos int, n_lines int"
_RUNS = _LINES + ", state int, n_docs long"
_DROP, _OPEN, _EDGE = 0, 1, 2


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, pos, lens, counts = [], [], [], []
            for text in batch.column(2).to_pylist():
                lines = (text or b"").lower().split(b"\n")
                kept = [(i, k) for i, line in enumerate(lines) if len(k := line.strip(_STRIP)) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)]
                digests += [xxhash.xxh3_128_digest(k) for _, k in kept]
                pos += [i for i, _ in kept]
                lens.append(len(kept))
                counts.append(len(lines))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(lens)), lens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(np.repeat(np.array(counts, dtype=np.int32), lens))],
                names=["h1", "h2", "doc_id", "rk", "pos", "n_lines"],
            )

    return run


def _stream_runs(min_docs: int, keep_first: bool):
    """Runs of one hash in a sorted partition.  A run that reaches min_docs here is dropped.  The first
    and the last run may go on in a neighbour partition: while they are shorter their rows stay
    open, and both leave a summary.  With keep_first the first row of the first run stays open too.

    Rows that repeat the one before them (a document that comes several times) are passed over, so
    what is held of a run is the lines of fewer than min_docs documents, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, n_docs, first, leads, held, before = None, None, 0, None, True, [], None

        def close(last: bool) -> list[tuple]:
            if not (leads or last):
                return []
            return [*((*r, _OPEN, 0) for r in held), (*first, _EDGE, n_docs)]

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for row in zip(*cols, strict=True):
                if row == before:
                    continue
                before = row
                if row[:2] != key:
                    if key is not None:
                        out += close(False)
                    leads = key is None
                    key, doc, n_docs, first, held = row[:2], None, 0, row, []
                if row[2:4] != doc or n_docs == 0:
                    doc, n_docs = row[2:4], n_docs + 1
                held.append(row)
                if n_docs >= min_docs:
                    for r in held:
                        if not (keep_first and r is first):
                            out.append((*r, _DROP, 0))
                        elif leads:
                            out.append((*r, _OPEN, 0))
                    held = []
            yield _batch(out)
        if key is not None:
            yield _batch(close(True))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["h1", "h2", "doc_id", "rk", "pos", "n_lines", "state", "n_docs"]
    types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


@F.pandas_udf(T.BinaryType())
def _bitmap(drops: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(drop, n):
        keep = np.ones(n, dtype=np.uint8)
        keep[np.asarray(drop, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pd.Series([one(d, n) for d, n in zip(drops, n_lines, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if b is None:
            return t or ""
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8), count=len(lines))
        return "\n".join([lines[i] for i in np.flatnonzero(keep)])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Documents that lose lines: doc_id, rk (see ``row_key``), n_lines, n_dropped, bitmap.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  A key of
    at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines
    everywhere, or everywhere but at its first place by (doc_id, row key, position) with
    ``keep_first``.  bitmap: zlib-compressed bits, first line first, 1 = stays.  Rows equal in
    doc_id and text are one document; a null text has one empty line, which has no key.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), F.col("text").cast("binary").alias("text"))
    lines = keyed.mapInArrow(_hash_lines(min_chars), _LINES)
    order = ["h1", "h2", "doc_id", "rk"]
    runs = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos").mapInArrow(_stream_runs(min_docs, keep_first), _RUNS)
    runs = materialise(runs, "line-runs", FEW_SAMPLES)
    # two summaries a partition at most
    place = F.struct("doc_id", "rk", "pos")
    edges = runs.where(F.col("state") == _EDGE).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs)
    settled = runs.where(F.col("state") == _OPEN).join(F.broadcast(edges), ["h1", "h2"])
    if keep_first:
        settled = settled.where(~place.eqNullSafe(F.col("first")))
    cols = ["doc_id", "rk", "pos", "n_lines"]
    dropped = runs.where(F.col("state") == _DROP).select(cols).union(settled.select(cols))
    # a group is the lines of one document; rows that repeat a document whole give each place again
    per_doc = dropped.groupBy("doc_id", "rk").agg(F.collect_set("pos").alias("drops"), F.max("n_lines").alias("n_lines"))
    return per_doc.select("doc_id", "rk", "n_lines", F.size("drops").cast("long").alias("n_dropped"), _bitmap("drops", "n_lines").alias("bitmap"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """The documents, each with its text less the dropped lines (other lines joined by LF), and
    the columns n_lines and n_dropped.  A null text becomes empty, with one line.  Other columns
    pass through; n_lines and n_dropped of the input are replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first).drop("n_lines").withColumnsRenamed({"bitmap": "__bitmap", "n_dropped": "__dropped"})
    joined = same(docs.withColumn("__rk", row_key()), bitmaps, key="__rk")
    newlines = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n")))
    return joined.withColumns(
        {
            "n_lines": (F.coalesce(newlines, F.lit(0)) + 1).cast("long"),
            "n_dropped": F.coalesce("__dropped", F.lit(0).cast("long")),
            "text": _apply("text", "__bitmap"),
        }
    ).drop("__rk", "__bitmap", "__dropped")
