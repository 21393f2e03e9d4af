"""Near-duplicate detection by HyperMinHash sketches of word shingles.

A sketch splits the hash range into buckets and keeps, of each bucket's least hash, the count of
leading zeros and the bits after them.  Bands of consecutive registers are keys; documents that
share a key are candidates.  Identical sets are one node from the start.  Candidates are first
held to the Jaccard similarity that their registers estimate, less the matches that chance
gives, and then confirmed on the full shingle sets.

No group is ever paired within itself.  Shingles that no other candidate holds bound what a node
can share with any partner, and with it the partner's size; nodes that bound rules out leave.
Then each node meets one node only, the one of its bands that is shared the most; then, among
the bands whose nodes are not all in one component yet, those outside a band's largest component
meet the others in blocks.  A block counts common shingles by a product of incidence matrices and
gives back no more links than join its components, so a group's links never grow with its square.
That finds every link that the bands can show up to connection, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import WEIGHTS, WordHashes, bounded_batches, discard, materialise, mix, only, row_key, same, windows
from siteloom.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets below this size are not judged by estimate; shingles in a block of a band, those counted in one product, and pairs counted at once.
SMALL, CHUNK, COUNTED, PAIRS = REGISTERS // 2, 100_000, 1024, 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _probes() -> np.ndarray:
    """For each register the order in which it asks the others when it is empty."""
    rng = np.random.Generator(np.random.PCG64(11))
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


PROBES = _probes()


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (UTF-8); fewer words than a shingle: the whole as one."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = hashes.of(words)
    if len(w) >= SHINGLE:
        return np.unique(windows(w, SHINGLE))
    return mix((w * WEIGHTS[: len(w)]).sum(keepdims=True) + np.full(1, len(w), dtype=np.uint64) * _GOLD)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch (uint16 each: leading zeros, then MANTISSA bits) of a sorted, non-empty set; empty buckets borrow from others in a fixed order."""
    spread = (shingles >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (spread >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(bucket, np.arange(REGISTERS))
    full = first < len(bucket)
    full[full] = bucket[first[full]] == np.flatnonzero(full)
    least = (spread[first[full]] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    m, e = np.frexp(least)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[full] = (33 - e) * (1 << MANTISSA) + ((2 * m - 1) * (1 << MANTISSA)).astype(np.int64)
    if not full.all():
        empty = np.flatnonzero(~full)
        ask = PROBES[empty]
        out[empty] = out[ask[np.arange(len(empty)), full[ask].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = (parts * WEIGHTS[:ROWS]).sum(axis=-1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    return mix(keys).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of registers that agree by chance in sketches of disjoint sets of n and m shingles."""
    zeros = np.arange(34)[:, None]
    high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)

    def share(size):
        k = np.maximum(size / REGISTERS, 1)[None, :]
        return (1 - low) ** k - (1 - high) ** k

    return (share(n) * share(m)).sum(axis=0) / (1 << MANTISSA)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "rk", "n_shingles", "key", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        take = pa.array(np.repeat(np.arange(len(regs)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), batch.column(0).take(take), batch.column(1).take(take)], names=["band", "node", "n"])


def _likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, sigmas: float = 5.0) -> np.ndarray:
    """Whether the estimate, with ``sigmas`` standard deviations of doubt, reaches ``least``; small sets always may.

    A set fills some registers of its own and the others borrow from them, so the doubt grows as the filled ones get fewer."""
    if not len(a):
        return np.empty(0, dtype=bool)
    c = chance(n, m)
    j = ((a == b).mean(axis=1) - c) / (1 - c)
    filled = REGISTERS * -np.expm1(-np.minimum(n, m) / REGISTERS)
    doubt = sigmas * np.sqrt(least * (1 - least) * (1 / filled + (REGISTERS - filled) / REGISTERS**2))
    return (j >= least - doubt) | (np.minimum(n, m) < SMALL)


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(_likely(a, b, n, m, least)))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets by 32 bits of each hash: never fewer in common than there are, seldom one more."""
    for batch in batches:
        short = [np.frombuffer(x, dtype=np.uint64).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["node", "short"])


def _columns(entries: pa.ListScalar) -> tuple:
    rows = entries.values
    own = [rows.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
    return *own, [np.frombuffer(x, dtype=np.uint32) for x in rows.field(4).to_pylist()]


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of ``left`` has in common with each of ``right``.

    Numbers that many sets hold are counted by products of incidence matrices, the others pair by pair."""
    n, m = len(left), len(right)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros(n * m, dtype=np.float32)
    if not len(both):
        return out.reshape(n, m)
    sides = []
    for own in (left, right):
        which, value = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        hit = both[at] == value
        order = np.argsort(at[hit], kind="stable")
        sides.append((which[hit][order], at[hit][order]))
    (l_which, l_at), (r_which, r_at) = sides
    l_count, r_count = np.bincount(l_at, minlength=len(both)), np.bincount(r_at, minlength=len(both))
    often = 1000 * l_count * r_count > n * m
    # rare numbers: each holder on the left with each on the right
    rare = np.flatnonzero(~often[l_at])
    begin = np.cumsum(r_count) - r_count
    ends = np.cumsum(r_count[l_at[rare]])
    for part in np.split(np.arange(len(rare)), np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) if len(ends) else []):
        if len(part):
            at, times = l_at[rare[part]], r_count[l_at[rare[part]]]
            place = np.repeat(begin[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            out += np.bincount(np.repeat(l_which[rare[part]], times) * m + r_which[place], minlength=n * m)
    out = out.reshape(n, m)
    columns = np.cumsum(often) - 1
    for part in range(0, int(often.sum()), COUNTED):
        dense = []
        for (which, at), k in zip(sides, (n, m), strict=True):
            here = often[at] & (columns[at] >= part) & (columns[at] < part + COUNTED)
            d = np.zeros((k, COUNTED), dtype=np.float32)
            d[which[here], columns[at[here]] - part] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out


def _joining(u: np.ndarray, v: np.ndarray, r_u: np.ndarray, r_v: np.ndarray) -> list[int]:
    """Places of the links that join components, one for each join; links in a fixed order."""
    order = np.lexsort((v, u))
    pairs = np.stack([np.minimum(r_u, r_v), np.maximum(r_u, r_v)], axis=1)[order]
    _, first = np.unique(pairs, axis=0, return_index=True)
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    keep = []
    for i in np.sort(first).tolist():
        a, b = find(int(pairs[i, 0])), find(int(pairs[i, 1]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(int(order[i]))
    return keep


def _meet(percent: int):
    """Links of a band's minor nodes to others of another component that their sets show, as many as join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for main, minors, others in zip(*batch.columns, strict=True):
                v, n_v, most_v, r_v, s_v = _columns(minors)
                u, n_u, most_u, r_u, s_u = _columns(others)
                ok = (r_v[:, None] != r_u) & ((r_u == main.as_py()) | (u < v[:, None]))
                ok &= (100 * np.minimum(n_v[:, None], n_u) >= percent * np.maximum(n_v[:, None], n_u)) & (n_u <= most_v[:, None]) & (n_v[:, None] <= most_u)
                i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                if not len(i):
                    continue
                both = common([s_v[k] for k in i], [s_u[k] for k in j])
                x, y = np.nonzero(ok[np.ix_(i, j)] & (100 * both >= percent * (n_v[i][:, None] + n_u[j] - both)))
                x, y = i[x], j[y]
                low, high = np.minimum(v[x], u[y]), np.maximum(v[x], u[y])
                keep = _joining(low, high, r_v[x], r_u[y])
                us.append(low[keep])
                vs.append(high[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


class _Finder:
    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int):
        self.docs, self.nodes, self.percent = docs, nodes, percent

    def sets(self, nodes: DataFrame) -> DataFrame:
        """Shingle sets of the nodes (column node), from one document of each."""
        found = nodes.join(self.nodes.select("node", "doc_id", "rk"), "node")
        texts = same(self.docs, found, "inner").select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])
        return materialise(texts.mapInArrow(_sets, "node long, shingles binary"), "shingle-sets")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v of nodes) that their registers make likely and that hold on the full sets."""
        side = self.nodes.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("s_u"))
        other = side.withColumnsRenamed({"u": "v", "n_u": "n_v", "s_u": "s_v"})
        pairs = pairs.join(side, "u").join(other, "v").where(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        likely = pairs.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(_estimate(self.percent / 100), "u long, v long")
        return self.confirmed(materialise(likely, "likely-pairs"), sets)

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that hold on the full sets."""
        x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
        full = pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y")
        return materialise(full.mapInArrow(_confirm(self.percent), "u long, v long"), "links")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = np.frombuffer(raw, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), node, dtype=np.int64))], names=["shingle", "node"])


def _largest_partner(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node, most: the most shingles that a partner of it among ``sets`` can have.

    With u of its n shingles in no other of the sets, a pair shares n - u at most, and
    100 * shared >= percent * (n + m - shared) bounds the partner's m."""
    alone = sets.mapInArrow(_spread, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    own = sets.select("node").join(nodes.select("node", "n"), "node").join(alone.groupBy("node").agg(F.count(F.lit(1)).alias("u")), "node", "left")
    shared = F.col("n") - F.coalesce("u", F.lit(0).cast("long"))
    return own.select("node", F.floor(((100 + percent) * shared - percent * F.col("n")) / percent).alias("most"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, kept for every row.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its
    distinct five-word shingles (fewer words: the whole as one; no words or null: empty, linked
    with nothing).  Two documents are linked when 100 * intersection >= percent * union.
    component_id: the smallest doc_id reachable, null if the component has none; kept: doc_id is
    that.  Equality of shingles is that of 64-bit hashes, equality of sets that of 128 bits.  A pair at
    the threshold is missed where it shares fewer than two of the 32 bands: by reckoning a chance of two in
    ten million at 85 and of five in a hundred thousand at 80 (in 72 000 simulated pairs of 7 to 800
    shingles none at 85, four at 80), and next to nothing above the threshold.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rk", row_key())
    signed = keyed.select("doc_id", "rk", F.col("text").cast("binary").alias("text"))
    signed = materialise(signed.mapInArrow(_sign, "doc_id long, rk long, n_shingles long, key binary, sketch binary"), "sketches")
    least = F.min(F.struct("doc_id", "rk"))
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), least.alias("d"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    # numbered once and written, so that a node has one number of its own
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "low", F.col("d.doc_id").alias("doc_id"), F.col("d.rk").alias("rk"), "n", "sketch"), "nodes")
    finder = _Finder(keyed, nodes, percent)

    bands = nodes.select("node", "n", "sketch").mapInArrow(_bands, "band long, node long, n long")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head")).where("size > 1").select("band", "head")
    members = members_1 = materialise(bands.join(shared, "band"), "band-members")
    # a pair at the threshold shares fourteen bands (ten at 80); a node with one shared band has no such partner
    often = members.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("node")
    members = members_2 = materialise(members.join(often, "node"), "often-members")
    sets = finder.sets(members.select("node").distinct())
    bounds = materialise(_largest_partner(sets, nodes, percent), "bounds")
    members = members.drop("head").join(bounds, "node").where(100 * F.col("most") >= percent * F.col("n"))
    # each node meets the most shared node of its bands, for its size
    fit = F.col("most") / F.col("n")
    heads = members.groupBy("band").agg(F.max(F.struct(fit.alias("fit"), "node")).alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "head")
    # short tables of their own, here and below, so that a join need not gather a band that very many nodes share
    heads = materialise(heads, "heads")
    members = materialise(members.join(heads, "band"), "able-members")
    stars = members.where(F.col("node") != F.col("head.node")).groupBy("node").agg(F.max("head").alias("head"))
    links = finder.links(stars.select(F.col("head.node").alias("u"), F.col("node").alias("v")), sets)
    # what the bands can still tell: nodes outside the largest component of a band against the others
    roots = components(links)
    named = members.drop("head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "named-members")
    per = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("band").agg(F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    open_bands = materialise(per.where("roots > 1").select("band", F.col("most.root").alias("main")), "open-bands")
    able = able_1 = materialise(named.join(open_bands, "band"), "open-members")
    sizes = materialise(able.groupBy("band").agg(F.sum("n").alias("size")), "band-sizes")
    short = materialise(sets.join(able.select("node").distinct(), "node").select("node", "shingles").mapInArrow(_short, "node long, short binary"), "short-sets")
    able = able.join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK))).join(short, "node")
    entry = F.collect_list(F.struct("node", "n", "most", "root", "short"))
    others = able.groupBy("band", "chunk", "main").agg(entry.alias("others")).drop("chunk")
    minors = able.where(F.col("root") != F.col("main")).groupBy("band", "chunk").agg(entry.alias("minors")).drop("chunk")
    met = minors.join(others, "band").select("main", "minors", "others")
    rest = materialise(met.mapInArrow(_meet(percent), "u long, v long").distinct(), "rest-pairs")
    every = links.union(finder.confirmed(rest, sets))
    roots = components(every)

    final = nodes.select("node", "key", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = final.groupBy("root").agg(F.min("low").alias("component_id"))
    final = materialise(final.join(lows, "root").select("key", "component_id"), "components")
    discard(nodes, sets, members_1, members_2, bounds, named, able_1, short)
    out = signed.drop("sketch").join(final, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "rk", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their own columns; repeats of one row all stay or go."""
    return only(docs, near_duplicates(docs, **options).where("kept").select("doc_id", "rk").dropDuplicates())
