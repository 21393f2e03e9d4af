"""Incremental audits: page files as a stream, snapshots that are reused while they live, facts of sites kept up to date."""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteloom.sources.scratch import scratch

#: State that expires needs a store that drops it on disk too.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream, ``max_files`` of them in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as a stream runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drain(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None, progress: list | None = None) -> DataFrame:
    """Runs a stream over all that is there, appending to Parquet; with the same folders a later call takes new files only.

    ``progress`` gets what Spark told of each micro-batch.
    """
    spark = stream.sparkSession
    out = path or scratch(spark, name)
    with _settings(spark, _STORE):
        job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or f"{out}-state").trigger(availableNow=True).start()
        job.awaitTermination()
    if progress is not None:
        progress += job.recentProgress
    return spark.read.schema(stream.schema).parquet(out)


def page_signal_stream(pages: DataFrame, signals: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Signals of pages as they come; a projection, so it holds no state."""
    return signals(pages)


def live_chain(times: np.ndarray, kept: list[int], ttl: int) -> tuple[np.ndarray, list[int]]:
    """Which of the sorted ``times`` are kept, and all kept times: each is held to the last one kept at or before it."""
    keep, kept, i = np.zeros(len(times), dtype=bool), sorted(kept), 0
    times = times.tolist()
    while i < len(times):
        at = bisect.bisect_right(kept, times[i])
        if at and times[i] <= kept[at - 1] + ttl:
            # all that this one covers, up to the next that was kept before
            end = min(kept[at - 1] + ttl, kept[at] - 1 if at < len(kept) else kept[at - 1] + ttl)
            i = bisect.bisect_right(times, end, i)
            continue
        keep[i] = True
        kept.insert(at, times[i])
        i += 1
    return keep, kept


class _Snapshots(StatefulProcessor):
    """Per key the kept times that may still matter; a timer clears them when the newest has expired and the watermark has passed that."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        frame = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)).drop(columns="seen_at")
        at = frame["at"].to_numpy(dtype=np.int64)
        # most keys have few rows and no two at one time: only ties need their other columns
        if len(np.unique(at)) < len(at):
            frame = frame.sort_values(["at", *(c for c in frame.columns if c != "at")], kind="stable")
        elif len(at) > 1:
            frame = frame.iloc[np.argsort(at)]
        kept = list(self.times.get()[0]) if self.times.exists() else []
        keep, kept = live_chain(frame["at"].to_numpy(dtype=np.int64), kept, self.ttl)
        # no row before the watermark comes any more, so of the times before it only the last can cover one
        mark = 1000 * timerValues.getCurrentWatermarkInMs()
        past = [t for t in kept if t <= mark]
        self.times.update((past[-1:] + [t for t in kept if t > mark],))
        self.handle.registerTimer((kept[-1] + self.ttl) // 1000 + 2)
        yield frame[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists() and 1000 * expiredTimerInfo.getExpiryTimeInMs() > self.times.get()[0][-1] + self.ttl:
            self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def reuse_snapshots(snapshots: DataFrame, ttl: str = "12 hours", lateness: str = "12 hours") -> DataFrame:
    """A snapshot of each key, and the next one when the time to live of the one kept last has passed; those it covers are dropped.

    Rows of a micro-batch are taken in order of time (ties: of their other columns as text), so files read at once, or in order of
    time over several batches, give what the batch rule gives.  A row from before a kept snapshot is held to the kept one before
    it; rows more than ``lateness`` older than the newest row of earlier batches come too late and are dropped.  Rows without a time are not told apart and all go.

    State: for each key that is alive the kept times within ``lateness``; a timer in event time clears a key when its last snapshot has expired, so the
    state follows the keys of one lifetime, not of all time.  Run by ``drain``, which keeps it in RocksDB.
    """
    kinds = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    rest = [c for c in snapshots.columns if c not in ("cache_key", "collected_at")]
    # other columns pass through pandas as text, which would make nullable integers floats
    rows = snapshots.where("collected_at is not null").select("cache_key", F.unix_micros("collected_at").alias("at"), F.col("collected_at").alias("seen_at"), *(F.col(c).cast("string").alias(c) for c in rest))
    schema = ", ".join(["cache_key string", "at long", *(f"`{c}` string" for c in rest)])
    micros = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)
    kept = rows.withWatermark("seen_at", lateness).groupBy("cache_key").transformWithStateInPandas(_Snapshots(micros), schema, "append", "EventTime")
    back = {"collected_at": F.timestamp_micros("at")} | {c: F.col(c).cast(kinds[c]) for c in rest}
    return kept.select(*(back.get(c, F.col(c)).alias(c) for c in snapshots.columns))


def event_snapshots(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws("-", "event_type", "user_id").alias("cache_key"), F.col("ts").cast("timestamp").alias("collected_at"), "event_id")


# -- facts of sites -------------------------------------------------------------------------------


def latest(versions: DataFrame, keys: list[str], by: str = "batch") -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in versions.columns if c not in (*keys, by)]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("v")).select(*keys, "v.*")


def refresh_counts(signals: DataFrame, every: Callable[[], DataFrame], name: str, recount: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Site-wide facts again for the sites that a stream of signals touches: they depend on all pages of a site, so state cannot answer them.

    What a micro-batch recounts is a version, in a folder of the batch's number that a replayed batch overwrites; the newest version of a site is what is returned,
    a row a site however many batches touched it.
    """
    spark = signals.sparkSession
    out = path or scratch(spark, name)

    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select("site").distinct()
        recount(every().join(touched, "site", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    signals.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(out), ["site"])


class SiteStore:
    """Pages and facts of sites below one folder, kept up to date by a stream of page rows.

    ``pages/batch=N/bucket=K``: the rows of micro-batch N by a hash of their site; ``sites/batch=N``: the facts of the sites that the
    batch touched, from all their pages so far.  Each batch writes folders of its own number as a whole, and reads only batches up to it, so replaying one changes
    nothing.  A batch reads the buckets that it touches, not the whole table.
    """

    def __init__(self, spark: SparkSession, path: str, recount: Callable[[DataFrame], DataFrame], newest: str, buckets: int = 64, per_url: bool = True) -> None:
        """recount: pages (run_id, site, url and the stream's other columns, a row for each URL: that of the largest ``newest``, of those the last to come) to a row for each run and site.

        Without ``per_url`` every row that came counts, also several of a URL.
        """
        self.spark, self.path, self.recount, self.newest, self.buckets, self.per_url = spark, path, recount, newest, buckets, per_url

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("run_id", "site"), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, number: int) -> None:
        """One micro-batch; applying a number again replaces what it wrote."""
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/pages/batch={number}")
        mine = self.spark.read.parquet(f"{self.path}/pages/batch={number}")
        touched = mine.select(F.col("run_id").alias("__run"), F.col("site").alias("__site"), "bucket").distinct()
        held = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # as many as there are buckets at most
        pages = self.spark.read.parquet(f"{self.path}/pages").where(F.col("bucket").isin(held) & (F.col("batch") <= number))
        # rows without a site are a site too
        pages = pages.join(touched.drop("bucket"), F.col("run_id").eqNullSafe(F.col("__run")) & F.col("site").eqNullSafe(F.col("__site")), "left_semi").drop("bucket")
        if self.per_url:
            place = F.row_number().over(Window.partitionBy("run_id", "site", "url").orderBy(F.desc(self.newest), F.desc("batch")))
            pages = pages.withColumn("__r", place).where("__r = 1").drop("__r")
        pages = pages.drop("batch")
        self.recount(pages).write.mode("overwrite").parquet(f"{self.path}/sites/batch={number}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Takes all that the stream has, and returns the sites as they are then."""
        job = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        job.awaitTermination()
        return self.sites()

    def sites(self) -> DataFrame:
        """The newest facts of each run and site."""
        return latest(self.spark.read.parquet(f"{self.path}/sites"), ["run_id", "site"])
