"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors of one direction are one node.  Nodes are hashed to shards; a task builds a shard's graph in
batches that double, each batch searching the graph so far all at once, and stores it as flat
arrays: vectors, one neighbour matrix a level, ids.  Blocks of queries meet every shard; a
query's results of all shards are merged, spread to their rows and ranked by the cosine of the
original vectors in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, materialise

#: Neighbours a node keeps at level 0 and above; beams when building and searching; nodes expanded at once.
M0, M, BUILD, BEAM, WIDE = 32, 16, 80, 160, 4
#: Nodes a shard aims at; queries in a block; nodes of a query that are ranked exactly.
SHARD, BLOCK, EXACT = 32768, 1024, 48


def search_level(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once, WIDE nodes a step.  entry: (queries, k) nodes, -1 none.
    Returns (nodes, similarities), best first, ``beam`` wide, -1 and -inf where there are fewer."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[np.arange(q)[:, None], entry] = True
    seen[:, n] = True  # -1 lands here
    ids = np.full((q, beam), -1, dtype=np.int64)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    k = min(entry.shape[1], beam)
    ids[:, :k], sims[:, :k] = entry[:, :k], np.where(entry[:, :k] >= 0, _dots(vectors, entry[:, :k], queries), -np.inf)
    done[:, :k] = entry[:, :k] < 0
    active, wide = np.arange(q), min(WIDE, beam)
    while len(active):
        a_ids, a_sims, a_done = ids[active], sims[active], done[active]
        ahead = np.where(a_done, -np.inf, a_sims)
        pick = np.argpartition(-ahead, wide - 1, axis=1)[:, :wide]
        ok = np.take_along_axis(ahead, pick, 1) > -np.inf
        live = ok.any(axis=1)
        if not live.all():
            active, a_ids, a_sims, a_done, pick, ok = active[live], a_ids[live], a_sims[live], a_done[live], pick[live], ok[live]
            if not len(active):
                break
        np.put_along_axis(a_done, pick, True, 1)
        near = links[np.where(ok, np.take_along_axis(a_ids, pick, 1), -1)].reshape(len(active), -1)
        near.sort(axis=1)
        fresh = ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[active[:, None], near] = True
        # the fresh ones of all queries to the left, as narrow as they allow
        most = max(int(fresh.sum(axis=1).max()), 1)
        left = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near, fresh = np.take_along_axis(near, left, 1), np.take_along_axis(fresh, left, 1)
        near = np.where(fresh, near, -1)
        got = np.where(fresh, _dots(vectors, near, queries[active]), -np.inf)
        all_ids, all_sims = np.concatenate([a_ids, near], axis=1), np.concatenate([a_sims, got], axis=1)
        all_done = np.concatenate([a_done, ~fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _dots(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.matmul(vectors[ids], queries[:, :, None])[:, :, 0]


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """For each row the neighbours that are nearer to the node than to a neighbour already taken; free places go to the nearest others."""
    b, k = ids.shape
    own = vectors[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    valid = ids >= 0
    taken = np.zeros((b, k), dtype=bool)
    count = np.zeros(b, dtype=np.int64)
    for i in range(k):
        blocked = ((between[:, i, :] > sims[:, i, None]) & taken).any(axis=1)
        ok = valid[:, i] & ~blocked & (count < keep)
        taken[:, i] = ok
        count += ok
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.full((b, keep), -1, dtype=np.int64)
    chosen = np.take_along_axis(ids, order, 1)
    out[:, : chosen.shape[1]] = chosen
    return out


class Graph:
    """levels: neighbour matrices (nodes, width), -1 where empty, level 0 first; nodes are in order of insertion, highest level first."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], counts: list[int]):
        self.vectors, self.levels, self.counts = vectors, levels, counts

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """vectors: unit, in random order.  The first n / M ** level nodes reach that level."""
        n = len(vectors)
        counts = [n]
        while counts[-1] > 2 * M:
            counts.append(counts[-1] // M)
        graph = cls(np.concatenate([vectors, np.zeros((1, vectors.shape[1]), dtype=np.float32)]), [np.full((c + 1, M0 if i == 0 else M), -1, dtype=np.int64) for i, c in enumerate(counts)], counts)
        done = 1
        while done < n:
            upto = min(n, 2 * done, done + 1024)
            graph._insert(done, upto)
            done = upto
        return graph

    def _insert(self, start: int, stop: int) -> None:
        new = np.arange(start, stop)
        entry = np.zeros((len(new), 1), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            own = new[new < self.counts[level]]
            entry, sims = search_level(self.vectors, self.levels[level], self.vectors[new], entry, BUILD if len(own) else 1)
            if len(own):
                ids, s = entry[: len(own)], sims[: len(own)]
                # nodes of one batch may be each other's neighbours
                among = self.vectors[own] @ self.vectors[own].T
                np.fill_diagonal(among, -np.inf)
                k = min(M, len(own) - 1)
                if k > 0:
                    top = np.argpartition(-among, k - 1, axis=1)[:, :k]
                    ids = np.concatenate([ids, own[top]], axis=1)
                    s = np.concatenate([s, np.take_along_axis(among, top, 1)], axis=1)
                    order = np.argsort(-s, axis=1, kind="stable")
                    ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
                self._link(level, own, _diverse(self.vectors, ids, s, M))

    def _link(self, level: int, own: np.ndarray, chosen: np.ndarray) -> None:
        links = self.levels[level]
        width = links.shape[1]
        links[own, :M] = chosen
        src, dst = np.repeat(own, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, begin = np.unique(dst, return_index=True)
        sizes = np.diff(np.append(begin, len(dst)))
        for part in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 256)):
            if not len(part):
                continue
            wide = int(sizes[part].max())
            more = np.full((len(part), wide), -1, dtype=np.int64)
            for row, j in enumerate(part):
                more[row, : sizes[j]] = src[begin[j] : begin[j] + sizes[j]]
            node = nodes[part]
            ids = np.concatenate([links[node], more], axis=1)
            repeat = np.sort(ids, axis=1)
            where = np.argsort(ids, axis=1, kind="stable")
            same = np.zeros_like(ids, dtype=bool)
            np.put_along_axis(same, where[:, 1:], repeat[:, 1:] == repeat[:, :-1], 1)
            ids = np.where(same, -1, ids)
            sims = _dots(self.vectors, ids, self.vectors[node])
            sims = np.where(ids >= 0, sims, -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (ids >= 0).sum(axis=1) > width
            links[node[~full]] = ids[~full, :width]
            if full.any():
                links[node[full]] = _diverse(self.vectors, ids[full], sims[full], width)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            entry, _ = search_level(self.vectors, self.levels[level], queries, entry, 4)
        return search_level(self.vectors, self.levels[0], queries, entry, min(beam, max(self.counts[0], 1)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, counts=np.array(self.counts), **{f"level{i}": x.astype(np.int32) for i, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as x:
            counts = x["counts"].tolist()
            return cls(x["vectors"], [x[f"level{i}"].astype(np.int64) for i in range(len(counts))], counts)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, as rows of doubles."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by([("node", "ascending")])
    graph = Graph.build(_unit(_matrix(table["embedding"])))
    return pa.table(
        {
            "size": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "graph": pa.array([graph.dump()], pa.binary()), "nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()),
        }
    )


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table(
        {
            "size": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
            "queries": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([_matrix(table["embedding"]).tobytes()], pa.binary()),
        }
    )


def _search(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, graph, nodes = None, None, None
        for batch in batches:
            for size, shard, raw, ids, queries, vectors in zip(*batch.columns, strict=True):
                if (size, shard) != last:
                    last, graph, nodes = (size, shard), Graph.load(raw.as_py()), np.frombuffer(ids.as_py(), dtype=np.int64)
                q = np.frombuffer(queries.as_py(), dtype=np.int64)
                x = _unit(np.frombuffer(vectors.as_py(), dtype=np.float64).reshape(len(q), -1))
                for part in range(0, len(q), 256):
                    found, sims = graph.search(x[part : part + 256])
                    found, sims = found[:, :keep], sims[:, :keep]
                    ok = np.isfinite(sims)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[part : part + 256], ok.sum(axis=1))), pa.array(nodes[found[ok]]), pa.array(sims[ok].astype(np.float64))], names=["query_id", "node", "near"])

    return run


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors that take part, as double: not null or zero, all components finite."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), bad.alias("bad")).where("vec_id is not null and not bad")
    return v.where(F.exists("embedding", lambda v: v != 0)).drop("bad")


def _direction(embedding: Column) -> Column:
    """64 bits of the direction: components over the largest one, to nine places, so that multiples of a vector agree."""
    top = F.array_max(F.transform(embedding, F.abs))
    return F.xxhash64(F.transform(embedding, lambda v: F.round(v / top, 9) + F.lit(0.0)))


def in_blocks(queries: DataFrame) -> DataFrame:
    """Adds block: about BLOCK queries have one, however many vectors are equal."""
    return queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // BLOCK)))).cast("int"))


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` (a Column over vec_id)
    holds its ``k`` nearest other rows by cosine in double precision, ties to the smaller vec_id.

    Vectors that are null, zero, or hold null or non-finite components, and rows without a
    vec_id, take no part.  Vectors of unlike lengths have no cosine: each length is a space of its
    own.  Vectors of one direction (to nine places of the largest component) are one node of the
    index; the rows with the k + 1 smallest ids stand for it, as all of them tie.  vec_id names a
    row: of rows with one vec_id one is kept.  A search costs each shard of about SHARD nodes a walk
    of logarithmic length for each query; queries times shards grow with the square of the table
    if the queries are a share of it.
    """
    bounded_batches(vectors.sparkSession)
    rows = _valid(vectors).withColumn("node", _direction(F.col("embedding"))).withColumn("size", F.size("embedding"))
    # the limit of a ranked window applies before the shuffle
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("size", "node").orderBy("vec_id")))
    ids = ranked.where(F.col("r") <= k + 1).select("size", "node", "vec_id", "embedding").dropDuplicates(["size", "node", "vec_id"])
    ids = materialise(ids, "vector-ids")
    points = ids.groupBy("size", "node").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    points = materialise(points, "points")
    shards = max(1, -(-points.count() // SHARD))
    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    index = points.withColumn("shard", shard).groupBy("size", "shard").applyInArrow(_build, "size int, shard int, graph binary, nodes binary")
    index = materialise(index, "index")
    queries = materialise(rows.where(is_query).drop("node").dropDuplicates(["vec_id"]), "queries")
    blocks = in_blocks(queries).groupBy("size", "block").applyInArrow(_block, "size int, block int, queries binary, vectors binary")
    # a stated query set against all rows, in blocks: each block of queries meets each shard
    met = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["size", "shard"])
    met = met.select("size", "shard", "graph", "nodes", "queries", "vectors").sortWithinPartitions("size", "shard")
    found = materialise(met.mapInArrow(_search(max(EXACT, k + 1)), "query_id long, node long, near double"), "found")
    # the best nodes of a query over all shards, then their rows
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "node"))).where(F.col("r") <= max(EXACT, k + 1)).drop("r", "near")
    own = queries.select(F.col("vec_id").alias("query_id"), "size", F.col("embedding").alias("own"))
    pairs = best.join(own, "query_id").join(ids, ["size", "node"]).where(F.col("vec_id") != F.col("query_id"))
    score = _dot("own", "embedding") / (F.sqrt(_dot("own", "own")) * F.sqrt(_dot("embedding", "embedding")))
    scored = pairs.select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
