"""Nearest neighbours over several shards, with ties by direction and vectors of unlike lengths."""

import collections

import numpy as np
from pyspark.sql import functions as F

from siteloom.llm import ann


def test_several_shards_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 250)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1000, 50):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(1000), key=lambda i: (-s[i], i))[:5]
        own = sorted(got[q])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in own)
        hit += len(set(best) & {r[1] for r in own})
    assert len(got) == 20 and hit >= 0.95 * 100


def test_multiples_of_a_vector_tie_by_id(spark):
    base = [0.25, -1.0, 0.5, 0.125]
    rows = [(i, [c * 2.0 ** (i % 7) for c in base]) for i in range(40)] + [(100 + i, [1.0, i + 0.5, -0.25, 0.0]) for i in range(30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 20)).collect()
    for q, want in ((0, [1, 2, 3, 4, 5]), (20, [0, 1, 2, 3, 4])):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_lengths_are_spaces_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, [0.5, 0.5]), (5, []), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit("x"), "shard": F.lit(1), "size": F.lit(1)})
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, F.lit(True)).collect()}
    assert got == {(0, 1): 1, (0, 2): 4, (1, 1): 0, (1, 2): 4, (2, 1): 3, (3, 1): 2, (4, 1): 1, (4, 2): 0}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
