"""The additive model: features and boosting against plain loops, held-out accuracy."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import quality_classifier as q
from siteloom.llm import queries

R = random.Random(11)
SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, m = max(len(words), 1), max(len(lines), 1)
    signs = set("#$%&*|<>@^~=+_\\/{}[]`")
    count = lambda held: sum(c in held for c in text)
    upper, digits, odd, marks = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("0123456789"), count(signs), count(".,;:!?'\"()-")
    chars = max(len(text), 1)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    shouted = lambda w: len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w)
    plainly = lambda w: not signs & set(w)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, sum(len(w) == 1 for w in words) / n, upper / max(chars - digits - odd - marks, 1), sum(map(shouted, words)) / n,
        digits / chars, odd / chars, sum(not plainly(w) for w in words) / n, text.count("|") / chars, marks / chars, text.count("!") / n, sum(len(w) <= 3 and plainly(w) for w in words) / n,
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(grams)) / len(grams) if grams else 0,
        np.log1p(len(lines)), len(words) / m, 1 - len(set(lines)) / len(lines) if lines else 0, sum(x[-1] in ".!?" for x in lines) / m,
    ]


def test_features(monkeypatch):
    monkeypatch.setattr(q, "PIECE", 64)
    alphabet = "ab AB.!?\n\t|#é漢😀0\x85 "
    texts = ["", " ", "\n\n", "one", "a a a a a a a", "x" * 5000, "Same line.\nSame line.\n\nOther"] + ["".join(R.choice(alphabet) for _ in range(R.randrange(400))) for _ in range(80)]
    got = q.features([t.encode() for t in texts])
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-12)
    assert np.array_equal(q.features([None]), q.features([b""])) and q.features([]).shape == (0, len(q.FEATURES))
    # what stands beside a text does not matter
    assert np.array_equal(q.features([texts[-1].encode()])[0], got[-1])


def test_leaves_are_the_best_cuts():
    rng = random.Random(3)
    g, w = np.array([rng.gauss(0, 3) for _ in range(9)]), np.array([rng.random() + 0.1 for _ in range(9)])
    value = lambda a, b: g[a:b].sum() ** 2 / (w[a:b].sum() + 5)
    best = max(range(1, 9), key=lambda c: value(0, c) + value(c, 9))
    two = q._leaves(g, w, 5.0, leaves=2)
    assert np.allclose(two[:best], g[:best].sum() / (w[:best].sum() + 5)) and np.allclose(two[best:], g[best:].sum() / (w[best:].sum() + 5))
    more = q._leaves(g, w, 5.0, leaves=4)
    assert 2 <= len(set(more)) <= 4 and np.isclose(more @ w, sum(g[more == v].sum() * w[more == v].sum() / (w[more == v].sum() + 5) for v in set(more)))


def test_plane_is_the_best_pair_of_cuts():
    n = q.COARSE
    g, w = np.random.default_rng(1).standard_normal((n, n)), np.random.default_rng(2).random((n, n))
    value = lambda s: g[s].sum() ** 2 / (w[s].sum() + 5)
    cuts = {(i, j): sum(value(np.s_[a, b]) for a in (slice(0, i), slice(i, n)) for b in (slice(0, j), slice(j, n))) for i in range(1, n) for j in range(1, n)}
    i, j = max(cuts, key=cuts.get)
    table, gain = q._plane(g, w, 5.0)
    assert np.isclose(gain, cuts[i, j] - g.sum() ** 2 / (w.sum() + 5))
    assert np.isclose(table[0, 0], g[:i, :j].sum() / (w[:i, :j].sum() + 5)) and np.isclose(table[-1, -1], g[i:, j:].sum() / (w[i:, j:].sum() + 5))
    assert len(np.unique(table)) == 4


def test_pairs_learn_what_features_alone_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    bounds = [q.edges(x[:, i]) for i in range(3)]
    bins, learns = q.binned(x, bounds), rng.random(4000) < 0.8
    tables = q.boost_features(bins, y, learns, 0.0, 30, 0.1)
    margin = tables[np.arange(3), bins].sum(axis=1)
    gains = q.strengths(bins, y, margin)
    pair = max(gains, key=gains.get)
    assert pair == (0, 2) and np.mean((margin > 0) == y) < 0.65
    planes = q.boost_pairs(bins, y, learns, margin, [pair], 100, 0.2)
    model = {"base": 0.0, "bounds": bounds, "tables": tables, "pairs": [pair], "planes": list(planes)}
    assert np.mean((q.margins(x, model) > 0) == y) > 0.97
    # a sum of table entries, row by row
    one = [sum(tables[f, np.searchsorted(bounds[f], v[f], side="right")] for f in range(3)) + planes[0][bins[k, 0] * q.COARSE // q.BINS, bins[k, 2] * q.COARSE // q.BINS] for k, v in enumerate(x[:50])]
    assert np.allclose(q.margins(x[:50], model), one)


def prose(n):
    return " ".join(f"word{R.randrange(500)}" for _ in range(n)) + "."


def test_scores(spark, docs):
    good = [(i, prose(R.randrange(30, 90))) for i in range(0, 240)]
    bad = [(i, " ".join(w + "###" for w in prose(R.randrange(30, 90)).split())) for i in range(240, 320)]
    odd = [(900, None), (901, ""), (902, "x" * 300_000), (903, prose(40)), (903, prose(40)), (None, "no id")]
    df = docs(*[(i, t, "en", "s", 1.0, True) for i, t in good + bad + odd], schema="doc_id int, text string, lang string, x string, score double, label boolean")
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(320)] + [(5, None), (None, 0)], "doc_id long, quality int")
    out = q.score(df, labels, F.col("doc_id") % 4 == 0, rounds=30).collect()
    assert len(out) == len(good + bad + odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 4 == 0) for r in out)
    seen = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 320]
    assert np.mean([r["predicted"] == int(r["doc_id"] < 240) for r in seen if r["held_out"]]) > 0.97
    # labels of held-out rows, source and lang teach nothing
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = q.score(df.withColumn("lang", F.col("doc_id").cast("string")), flipped, F.col("doc_id") % 4 == 0, rounds=30).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_little_to_learn_from(spark, docs):
    df, held = docs((1, "a b"), (2, None)), F.col("doc_id") < 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in q.score(df, none, held).collect()} == {0.5}
    # fewer than five words in a batch
    assert q.features([b"a b", None, b"c"])[:, 15].tolist() == [0, 0, 0]
    assert all(r["predicted"] == 1 for r in q.score(df, spark.createDataFrame([(1, 1), (2, 1)], none.schema), held).collect())
    assert q.score(df.limit(0), none, held).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    out = queries.op11_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.95
