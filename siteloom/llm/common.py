"""What the operators share: a place for intermediate tables, word hashes, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers that give each place in a window its own weight.
WEIGHTS = np.array([xxhash.xxh3_64_intdigest(f"place{i}") | 1 for i in range(64)], dtype=np.uint64)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.  Without one only a local session gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    Tables that a result still reads stay until whoever owns the folder clears it; others are discarded.  ``settings`` hold while
    the table is written, unless the session has its own; the session is left as it was.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siteloom-{uuid.uuid4().hex}/{name}"
    own = {k: v for k, v in (settings or {}).items() if spark.conf.get(k, None) is None}
    # once the table is written, nothing reads the shuffle files that led to it
    own[_CLEANUP] = "true"
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once nothing that is still to be read depends on them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Batches that Python workers get are bounded in bytes, unless the session says how: thousands of very long texts are never held at once."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(8 << 20))


#: Ranges of hashes are even, so twenty samples a partition find their bounds, and the driver gets a fifth of the usual.
FEW_SAMPLES = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "20"}


def mix(x: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words seen lately in this task; bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def of_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after the other, and how many words each has."""
        words, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.split()
                counts[i] = len(own)
                words += own
        return self.of(words), counts


def windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, xxhash.xxh3_64_intdigest(f"window{size}-{seed}"), dtype=np.uint64)
    for i in range(size):
        out += words[i : n + i] * WEIGHTS[(i + 17 * seed) % 64]
    return mix(out)


def prefixes(words: np.ndarray, sizes: list[int], seed: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of every ``size`` consecutive words) for sizes in rising order: as ``windows``, in one sweep."""
    n, total, done = len(words), np.zeros(len(words), dtype=np.uint64), 0
    for size in sizes:
        for i in range(done, min(size, n)):
            total[: n - i] += words[i:] * WEIGHTS[(i + 17 * seed) % 64]
        done = size
        yield size, mix(total[: max(n - size + 1, 0)] + np.uint64(xxhash.xxh3_64_intdigest(f"window{size}-{seed}")))


def row_key() -> Column:
    """64 bits of a document's id and text. With doc_id beside it, it tells apart rows that share an id; rows equal in both are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def same(left: DataFrame, right: DataFrame, how: str = "left", key: str = "rk") -> DataFrame:
    """Join on doc_id (null equals null) and the row key, which ``left`` holds as ``key``; the right side's keys go."""
    r = right.withColumnsRenamed({"doc_id": "__r_id", "rk": "__r_rk"})
    return left.join(r, F.col("doc_id").cast("long").eqNullSafe(F.col("__r_id").cast("long")) & (F.col(key) == F.col("__r_rk")), how).drop("__r_id", "__r_rk")


def only(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are those of a row (doc_id, rk) of ``good``, with all their own columns."""
    return same(docs.withColumn("__rk", row_key()), good, "left_semi", "__rk").drop("__rk")
