"""Embedding whitening by a QDWH spectral divide-and-conquer.

Tasks sum the vectors, then their centred products; what reaches the driver is one covariance
matrix for each length of vectors, however many rows there are.  Its eigenvectors come from polar
decompositions (QR-based dynamically weighted Halley iterations): the polar factor of the matrix less
a shift gives the spectral projectors of both sides of the shift, bases of their ranges split the matrix
in two, and each part is split again until single components are left.  The whitening matrix
then travels to all tasks and is applied batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, materialise

SCALE, OFFSET = 1024, 100_000
#: Entries beyond this are no coordinates: their integers would not add up in 64 bits.
LARGEST = float(1 << 30)
EPS = np.finfo(np.float64).eps


# -- the decomposition: dense matrices of dimension x dimension ---------------------------------


def polar(a: np.ndarray, most: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by QDWH: X <- b/c X + (a - b/c) / sqrt(c) Q1 Q2', with [sqrt(c) X; I] = [Q1; Q2] R.

    The weights follow a lower bound of the least singular value, which each step raises; it starts at
    the rounding unit, so no estimate can be too large and about six steps do.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / np.sqrt(n)
    eye = np.eye(n)
    for _ in range(most):
        gap = max(1 - low * low, 0.0)
        d = np.cbrt(4 * gap / low**4)
        s = np.sqrt(1 + d)
        wa = s + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * s), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(EPS) and low > 1 - 10 * EPS:  # convergence is cubic: the next step would move by less than a rounding
            break
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of all space whose first ``rank`` columns span the projector's range: a step of subspace iteration from a fixed start."""
    start = np.random.default_rng(7).standard_normal(projector.shape)
    basis, _ = np.linalg.qr(projector @ start[:, :rank])
    basis, _ = np.linalg.qr(projector @ basis)
    rest, _ = np.linalg.qr(start[:, rank:] - basis @ (basis.T @ start[:, rank:]))
    rest, _ = np.linalg.qr(rest - basis @ (basis.T @ rest))
    return np.hstack([basis, rest])


def _split(a: np.ndarray) -> np.ndarray | None:
    """An orthogonal matrix and a rank that make ``a`` block diagonal, larger eigenvalues first; None if no shift parts the spectrum."""
    n = len(a)
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    # the mean parts any spectrum of more than one value; a shift that meets an eigenvalue is moved
    for shift in (float(np.median(np.diag(a))), mean, *(mean + f * spread for f in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3, 0.5, -0.5))):
        u = polar(a - shift * np.eye(n))
        p = (u + u.T + 2 * np.eye(n)) / 4
        rank = int(round(float(np.trace(p))))
        if 0 < rank < n and np.linalg.norm(p @ p - p) < 1e-10 * n:
            basis = _range(p, rank)
            turned = basis.T @ a @ basis
            if np.linalg.norm(turned[:rank, rank:]) <= 1e3 * n * EPS * np.linalg.norm(a):
                return basis, rank
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    A part whose eigenvalues agree to rounding is not split: any basis of it is right.
    """
    a = (a + a.T) / 2
    n, whole = len(a), np.linalg.norm(a)
    vectors, parts = np.eye(n), [(0, n)]
    while parts:
        lo, hi = parts.pop()
        part = vectors[:, lo:hi].T @ a @ vectors[:, lo:hi]
        part = (part + part.T) / 2
        if hi - lo == 1 or np.linalg.norm(part - np.trace(part) / (hi - lo) * np.eye(hi - lo)) <= 4 * (hi - lo) * EPS * whole:
            continue
        found = _split(part)
        if found is None:
            continue
        basis, rank = found
        vectors[:, lo:hi] = vectors[:, lo:hi] @ basis
        parts += [(lo, lo + rank), (lo + rank, hi)]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order], vectors * np.where(signs == 0, 1, signs)


# -- Spark ---------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Vectors with no null, non-finite or absurdly large entry."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integer vectors) for each length of a batch's vectors."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        values = flat[(ends[at][:, None] + np.arange(size)[None, :])] if size else np.empty((len(at), 0))
        yield int(size), at, np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and entry sums of this task's vectors, one row for each length."""
    found: dict[int, list] = {}
    for batch in batches:
        for size, at, x in _by_length(batch.column(0)):
            held = found.setdefault(size, [0, np.zeros(size, dtype=np.int64)])
            held[0] += len(at)
            held[1] += x.sum(axis=0)
    names = ["dim", "n", "sums"]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.list_(pa.int64()))], names=names)


def _products(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of this task's sums of centred products."""
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                c = x - means[size]
                found[size] = found.get(size, 0) + c.T @ c
        for size, product in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size), pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array(list(product), pa.list_(pa.float64()))], names=["dim", "i", "line"])

    return run


def _apply(models: dict[int, dict]):
    names = ["vec_id", "dim", "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column(1)):
                m = models[size]
                away = m["n"] * x - m["sums"]
                # in 64 bits where the sum must fit; else in Python's integers, and null where a long cannot hold it
                if np.abs(away).max(initial=0) < 2**31 and size * float(np.abs(away).max(initial=0)) ** 2 < 2**62:
                    deviation = pa.array((away * away).sum(axis=1), pa.int64())
                else:
                    exact = (away.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
                whitened = (x - m["mean"]) @ m["matrix"]
                ids = batch.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), size), pa.int32()), deviation, pa.array(list(whitened), pa.list_(pa.float64()))], names=names)

    return run


def fit(vectors: DataFrame, most: int = 8) -> dict[int, dict]:
    """For each length of ``vectors`` (one column of usable arrays): n, sums, mean, values, trace and the whitening ``matrix`` (length x components).

    Bounded by the square of the lengths, not by rows: 33 KB for 64 dimensions, 8 MB for 1024.
    A component without variance (to rounding) cannot be scaled; its column is NaN.
    """
    bounded_batches(vectors.sparkSession)
    sums = vectors.mapInArrow(_sums, "dim int, n long, sums array<long>")
    sums = sums.select("dim", "n", F.posexplode_outer("sums").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    models: dict[int, dict] = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["i"] or 0)):
        m = models.setdefault(r["dim"], {"n": r["n"], "sums": []})
        m["sums"] += [] if r["i"] is None else [r["s"]]
    for m in models.values():
        m["sums"] = np.array(m["sums"], dtype=np.int64)
        m["mean"] = m["sums"] / m["n"]
    lines = vectors.mapInArrow(_products({d: m["mean"] for d, m in models.items()}), "dim int, i int, line array<double>")
    cells = lines.select("dim", "i", F.posexplode("line").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("dim", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("line"))
    matrices = {d: np.zeros((d, d)) for d in models}
    for r in rows.toLocalIterator():
        matrices[r["dim"]][r["i"]] = r["line"]
    for d, m in models.items():
        covariance = matrices[d] / m["n"]
        values, vectors_ = eigen(covariance) if d else (np.empty(0), np.empty((0, 0)))
        m["trace"] = float(np.trace(covariance))
        k = min(most, d)
        m["values"] = np.maximum(values[:k], 0.0)
        flat = m["values"] <= 16 * d * EPS * m["trace"]
        m["matrix"] = np.where(flat, np.nan, vectors_[:, :k] / np.sqrt(np.where(flat, 1.0, m["values"])))
    return models


def whiten(embeddings: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and component up to ``most``.

    Vectors that are null or hold null, non-finite or absurd entries (2^30 and more) are dropped; an empty vector has no
    components.  Vectors of another length are a space of their own, with its own n and components.  A component without
    variance cannot be whitened: whitened is null, explained 0; identity_error is measured on the whitened rows over the components that have
    variance (null if none has).  A deviation that a long cannot hold is null.  Repeated rows count each; extra columns do not matter; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    good = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = fit(good.select("embedding"), most)
    flat = good.mapInArrow(_apply(models), "vec_id long, dim int, deviation long, whitened array<double>")
    flat = materialise(flat.withColumn("whitened", F.transform("whitened", lambda w: F.when(~F.isnan(w), w))), "whitened")
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    moments = flat.groupBy("dim").agg(*(F.covar_pop(F.get("whitened", i), F.get("whitened", j)).alias(f"c{i}_{j}") for i, j in pairs))
    errors = moments.select("dim", F.array_max(F.array(*(F.abs(F.col(f"c{i}_{j}") - float(i == j)) for i, j in pairs))).alias("identity_error"))
    facts = [(d, m["n"], [float(v / m["trace"]) if m["trace"] > 0 else 0.0 for v in m["values"]]) for d, m in models.items()]
    told = spark.createDataFrame(facts, "dim int, n long, explained array<double>").join(errors, "dim", "left")
    # a row for each length of vectors
    out = flat.join(F.broadcast(told), "dim").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")
