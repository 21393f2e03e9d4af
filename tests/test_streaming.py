"""Streams against the batch rule."""

import collections
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from siteloom.plans import audit, collected
from siteloom.streaming import incremental

DAY = dt.datetime(2024, 1, 1)
TTL = dt.timedelta(hours=12)


def batch_rule(rows):
    """rows: (cache_key, collected_at, event_id); those kept when taken in order of time."""
    last, kept = {}, []
    for key, at, i in sorted(rows):
        if key not in last or at > last[key] + TTL:
            last[key] = at
            kept.append((key, at, i))
    return sorted(kept)


def write(spark, folder, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    spark.createDataFrame([(i, at, int(key.split("-")[1]), key.split("-")[0]) for key, at, i in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))


def sample():
    rng = random.Random(5)
    rows = [(f"click-{k}", DAY + dt.timedelta(hours=rng.choice([1, 5, 12, 13, 30]) * rng.randint(0, 20), seconds=rng.randint(0, 3)), k * 1000 + n) for k in range(8) for n in range(30)]
    # just before, at and just after expiry; two at one time; days apart
    rows += [("view-1", DAY + d, 9_000_000_000_000_000_001 + n) for n, d in enumerate([dt.timedelta(0), dt.timedelta(0), TTL - dt.timedelta(microseconds=1), TTL, TTL + dt.timedelta(microseconds=1), dt.timedelta(days=5)])]
    rng.shuffle(rows)
    return rows


def test_ttl_dedup_is_the_batch_rule(spark, tmp_path):
    rows = sample()
    for part in range(3):  # files out of order
        write(spark, tmp_path / "events.parquet", rows[part::3])
    got = sorted(tuple(r) for r in collected.q_stream_ttl_dedup(spark, str(tmp_path)).select("cache_key", "collected_at", "event_id").collect())
    assert got == batch_rule(rows)
    assert collections.Counter(k for k, *_ in got)["view-1"] == 3


def test_ttl_dedup_over_several_batches(spark, tmp_path):
    rows = sorted(sample(), key=lambda r: (r[1], r[2]))
    got = []
    for part in (rows[:60], rows[60:150], rows[150:]):
        write(spark, tmp_path / "events.parquet", part)
        stream = incremental.event_snapshots(incremental.read_files(spark, str(tmp_path / "events.parquet"), spark.read.parquet(str(tmp_path / "events.parquet")).schema))
        got = incremental.drain(incremental.reuse_snapshots(stream), "again", str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(tuple(r) for r in got) == batch_rule(rows)


def again(spark, tmp_path, lateness, progress=None):
    folder = str(tmp_path / "events.parquet")
    stream = incremental.event_snapshots(incremental.read_files(spark, folder, spark.read.parquet(folder).schema))
    return incremental.drain(incremental.reuse_snapshots(stream, lateness=lateness), "again", str(tmp_path / "out"), str(tmp_path / "state"), progress)


def test_late_rows(spark, tmp_path):
    rows = [("view-1", DAY + dt.timedelta(days=d), d) for d in (0, 1, 5)]
    for part in (rows[:2], rows[2:]):
        write(spark, tmp_path / "events.parquet", part)
        again(spark, tmp_path, "8 days")
    # a row from before all others is no reason to drop it, nor those kept; one between two kept ones is held to the first
    late = [("view-1", DAY - dt.timedelta(days=2), 10), ("view-1", DAY + dt.timedelta(days=1, hours=3), 11), ("view-1", DAY - dt.timedelta(days=9), 12)]
    write(spark, tmp_path / "events.parquet", late)
    got = again(spark, tmp_path, "8 days")
    # nine days before the first day is later than what is waited for
    assert sorted(tuple(r) for r in got.collect()) == batch_rule([*rows, late[0], late[1]])


def test_state_is_flat_over_many_lifetimes(spark, tmp_path):
    rows, progress = [], []
    for day in range(12):  # forty new keys a day, three snapshots each
        part = [(f"view-{day * 40 + k}", DAY + dt.timedelta(days=day, hours=h), day * 1000 + k * 3 + i) for k in range(40) for i, h in enumerate((0, 5, 13))]
        rows += part
        write(spark, tmp_path / "events.parquet", part)
        got = again(spark, tmp_path, "1 hour", progress)
    assert sorted(tuple(r) for r in got.collect()) == batch_rule(rows)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # a value and a timer for each key that is alive: as many after twelve lifetimes as after three
    assert max(held[-4:]) <= max(held[:6]) and max(held) < 3 * 40 * 6


def test_a_long_chain_takes_time_by_its_length(monkeypatch):
    # a look-up in a list that grows must not copy it: searchsorted on a list does, a hundred thousand times here
    monkeypatch.setattr(np, "searchsorted", None)
    keep, kept = incremental.live_chain(np.arange(0, 500_000, 5, dtype=np.int64), [], 3)
    assert keep.all() and len(kept) == 100_000


def test_chain_is_the_rule_one_by_one():
    rng = random.Random(8)
    for _ in range(300):
        ttl = rng.randint(1, 30)
        kept = []
        for t in sorted(rng.sample(range(300), rng.randint(0, 6))):
            if not kept or t > kept[-1] + ttl:
                kept.append(t)
        times = sorted(rng.randint(0, 300) for _ in range(rng.randint(0, 40)))
        want, chain = [], list(kept)
        for t in times:
            before = [k for k in chain if k <= t]
            want.append(not before or t > before[-1] + ttl)
            if want[-1]:
                chain = sorted([*chain, t])
        keep, after = incremental.live_chain(np.array(times, dtype=np.int64), kept, ttl)
        assert keep.tolist() == want and after == chain


def pages(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "run_id string, site string, url string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    return incremental.read_files(spark, str(tmp_path / "pages"), "run_id string, site string, url string, n long")


def count(df):
    return df.groupBy("run_id", "site").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"))


def test_two_batches_and_a_replay_leave_one_row_a_site(spark, tmp_path):
    store = incremental.SiteStore(spark, str(tmp_path / "store"), count, "n", buckets=8)
    store.run(pages(spark, tmp_path, ("r", "a", "a/1", 1), ("r", "a", "a/2", 2), ("r", "b", "b/1", 5)))
    got = store.run(pages(spark, tmp_path, ("r", "a", "a/2", 20), ("r", "a", "a/3", 3), ("r", "c", "c/1", 7)))
    want = [("r", "a", 3, 24), ("r", "b", 1, 5), ("r", "c", 1, 7)]
    assert sorted(map(tuple, got.collect())) == want
    versions = lambda: spark.read.parquet(str(tmp_path / "store" / "sites")).where("site = 'a'").count()
    assert versions() == 2
    # a batch that is applied again, as after a failure, replaces what it wrote
    rows = spark.createDataFrame([("r", "a", "a/2", 20), ("r", "a", "a/3", 3), ("r", "c", "c/1", 7)], "run_id string, site string, url string, n long")
    for _ in range(2):
        store.apply(rows, 1)
    assert sorted(map(tuple, store.sites().collect())) == want and versions() == 2
    # and an earlier one, applied late, sees what it saw then
    store.apply(spark.createDataFrame([("r", "a", "a/1", 1), ("r", "a", "a/2", 2), ("r", "b", "b/1", 5)], rows.schema), 0)
    assert sorted(map(tuple, store.sites().collect())) == want


def test_pages_that_share_a_url_all_count(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages.parquet"))
    make((1, "https://a.example/x", "ab"), (2, "https://a.example/x", "c"), (3, None, "d"))
    make((4, "https://a.example/x", "ef"), (5, "https://a.example:8080/y", "g"), (6, "https://b.example/", None), (7, None, "hi"))
    got = {r["site"]: (r["pages"], r["newest"], r["characters"]) for r in audit.q_stream_site_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.example": (3, 4, 5), "a.example:8080": (1, 5, 1), "b.example": (1, 6, None), None: (2, 7, 3)}


def test_a_batch_reads_the_buckets_that_it_touches(spark, tmp_path):
    seen = []
    store = incremental.SiteStore(spark, str(tmp_path / "store"), lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or count(df), "n", buckets=16)
    make = lambda *rows: spark.createDataFrame(list(rows), "run_id string, site string, url string, n long")
    store.apply(make(*(("r", f"s{i}", "u", i) for i in range(60))), 0)
    store.apply(make(("r", "s7", "v", 1)), 1)
    assert "PartitionFilters: [bucket" in seen[1] or "bucket#" in seen[1].split("PartitionFilters")[1]
    assert {r["site"]: r["pages"] for r in store.sites().collect()}["s7"] == 2


def test_counts_of_touched_sites_replace_those_before(spark, tmp_path):
    every = lambda: spark.read.parquet(str(tmp_path / "pages"))
    recount = lambda df: df.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    for rows in ([("r", "a", "a/1", 1)], [("r", "a", "a/2", 2), ("r", "b", "b/1", 1)]):
        stream = pages(spark, tmp_path, *rows)
        got = incremental.refresh_counts(stream, every, "touched", recount, str(tmp_path / "counts"))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 1)]
