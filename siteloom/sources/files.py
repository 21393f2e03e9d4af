"""Collected files as they lie in a folder, plain or compressed, one row each; what cannot be read is a row of its own."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file as stored, and of its text once unpacked.
MOST_STORED, MOST_TEXT = 64 << 20, 256 << 20
#: Bytes that a cell can hold.
MOST_CELL = (1 << 31) - 1


def _text(content: bytes | None, most: int) -> tuple[str | None, bool, str | None]:
    """(text, whether it was compressed, what is wrong) of a file; unpacking stops at ``most`` bytes."""
    if content is None:
        return None, False, "file has no content"
    packed = content[:2] == b"\x1f\x8b"
    if packed:
        out, rest = [], content
        try:
            while rest:  # a file may hold several members
                part = zlib.decompressobj(wbits=31)
                out.append(part.decompress(rest, most + 1 - sum(map(len, out))))
                if sum(map(len, out)) > most:
                    return None, True, f"text exceeds {most} bytes"
                if not part.eof:
                    return None, True, "compressed file ends early"
                rest = part.unused_data
        except zlib.error as e:
            return None, True, f"not readable as gzip: {e}"
        content = b"".join(out)
    if len(content) > most:
        return None, packed, f"text exceeds {most} bytes"
    if content.startswith(b"\xef\xbb\xbf"):
        content = content[3:]
    if b"\x00" in content[:1024]:
        return None, packed, "not a text file"
    return content.decode("utf-8", errors="replace"), packed, None


def _unpack(names: list[str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a file at a time: texts of a batch are never held together with those of another
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body, packed, error = _text(row.column(batch.num_columns - 1)[0].as_py(), most)
                cells = [*row.columns[:-1], pa.array([body], pa.string()), pa.array([packed]), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(cells, names=[*names, "body", "compressed", "error"])

    return run


def file_rows(spark: SparkSession, folder: str, stored: int = MOST_STORED, text: int = MOST_TEXT) -> DataFrame:
    """Files below ``folder``/run_id=.../site=.../file=..., each read once: run_id, site, file, path, length, body, compressed, and error, which says why a file has no body.

    A file is gzip if its first bytes say so, whatever it is called.  Without a body are those that are larger than ``stored`` bytes (their content is not read),
    whose text is larger than ``text`` bytes, that are cut off or damaged, or that are no text.  Files without bytes have no row.
    """
    keys = ["run_id", "site", "file", "path", "length"]
    every = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, run_id string, site string, file string").load(folder)
    whole = stored >= MOST_CELL  # Spark itself raises at a file that no cell holds
    rows = (every if whole else every.where(F.col("length") <= stored)).select(*keys, "content").mapInArrow(_unpack(keys, text), "run_id string, site string, file string, path string, length long, body string, compressed boolean, error string")
    if whole:
        return rows
    large = every.where(F.col("length") > stored).select(*keys, F.lit(None).cast("string").alias("body"), F.lit(None).cast("boolean").alias("compressed"), F.lit(f"file exceeds {stored} bytes").alias("error"))
    return rows.unionByName(large)


def read_files(spark: SparkSession, folder: str, stored: int = MOST_STORED, text: int = MOST_TEXT) -> tuple[DataFrame, DataFrame]:
    """``file_rows`` apart: files (run_id, site, file, path, body, compressed), and rejects (run_id, site, file, path, length, error)."""
    rows = file_rows(spark, folder, stored, text)
    return rows.where("error is null").drop("length", "error"), rows.where("error is not null").drop("body", "compressed")


def sitemap_files(files: DataFrame, *more: str) -> DataFrame:
    """run_id, site, sitemap_url, body and what more is asked for, from ``read_files``: a file's name is its path on the site, or a whole URL, percent-encoded."""
    name = F.coalesce(F.try_url_decode("file"), "file")
    url = F.when(name.rlike("^(?i)https?://"), name).otherwise(F.concat(F.lit("https://"), "site", F.lit("/"), F.regexp_replace(name, "^/+", "")))
    return files.select("run_id", "site", url.alias("sitemap_url"), "body", *more)
