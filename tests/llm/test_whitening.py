"""QDWH decomposition against the library's, whitening against plain numpy."""

import math

import numpy as np
import pytest

from siteloom.llm import whitening

G = np.random.default_rng(5)


def turned(values):
    q, _ = np.linalg.qr(G.standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[4.0], [1.0, 1.0, 1.0], [3, 3, 1, 1, 1, 0, 0], [1e9, 1, 1e-6, 0], [0, 0, 0], [5, 5 - 1e-9, 5 - 2e-9, 1], [-2, -1, 1, 2], list(range(40))])
def test_eigenvectors(values):
    a = turned(values)
    found, vectors = whitening.eigen(a)
    scale = max(np.abs(values)) or 1
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * scale, rtol=0)


def test_polar_factor():
    a = turned([7.0, 1e-7, -3, -1e-5])
    u = whitening.polar(a)
    values, q = np.linalg.eigh(a)
    assert np.allclose(u, (q * np.sign(values)) @ q.T, atol=1e-8)
    b = G.standard_normal((9, 9))
    left, _, right = np.linalg.svd(b)
    assert np.allclose(whitening.polar(b), left @ right, atol=1e-13)


def plain(vectors, most=8):
    """n, deviations, whitened rows and explained shares by numpy's decomposition and Python's integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array(x, dtype=np.float64) - np.array(sums) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:most], q[:, ::-1][:, :most]
    return n, deviation, centred @ q / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening(spark):
    base = (G.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(base)] + [(3, base[3].tolist(), "x", 1)]
    odd = [(900, None, "x", 1), (901, [None] + [0.0] * 11, "x", 1), (902, [float("nan")] * 12, "x", 1), (903, [float("inf")] + [0.0] * 11, "x", 1), (904, [3e38] + [0.0] * 11, "x", 1), (905, [], "x", 1)]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<float>, whitened string, dim int").repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, want, share = plain([v for _, v, *_ in rows])
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n}
    where = {i: k for k, (i, *_) in enumerate(rows)}
    for r in got:
        k = where[r["vec_id"]]
        assert r["deviation"] == deviation[k]
        assert abs(abs(r["whitened"]) - abs(want[k, r["component"] - 1])) < 1e-9
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    # one sign for all rows
    for c in range(1, 9):
        signs = {np.sign(r["whitened"] * want[where[r["vec_id"]], c - 1]) for r in got if r["component"] == c}
        assert len(signs) == 1


def test_lengths_and_flat_components(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(20)] + [(50 + i, [float(i), 0.0]) for i in range(4)] + [(99, [1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"] // 50, r["n"]) for r in got if r["vec_id"] != 99} == {(0, 20), (1, 4)}
    of = lambda v: {r["component"]: r for r in got if r["vec_id"] == v}
    assert len(of(0)) == 3 and of(0)[3]["whitened"] is None and of(0)[3]["explained"] == pytest.approx(0, abs=1e-12) and of(0)[2]["whitened"] is not None
    assert len(of(50)) == 2 and of(50)[2]["whitened"] is None and of(50)[1]["identity_error"] < 1e-9
    assert len(of(99)) == 1 and of(99)[1]["whitened"] is None and of(99)[1]["deviation"] == 0 and of(99)[1]["identity_error"] is None


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(1 << 20) * (i % 2), 0.5]) for i in range(8)] + [(i + 8, [3.0, 0.5]) for i in range(2000)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    want = dict(zip((i for i, _ in rows), plain([v for _, v in rows])[1]))
    assert {k: v for k, v in want.items() if v < 2**63} == {k: v for k, v in got.items() if v is not None} and any(v is None for v in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(df).count() == 0
