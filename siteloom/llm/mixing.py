"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into permuted blocks.  A source's target fixes how often all its
blocks are taken and how many words more come from blocks in permuted order; the one block that
the target cuts is filled document by document.  The blocks drawn from each source are that
source's quota.  A binary tree over the output shards splits the quotas exactly: each node draws
its left half's share of every source from a multivariate hypergeometric distribution, so the
leaves hold what a random deal of all drawn blocks would give.  A leaf takes the next blocks of
each source, disjoint from all others, and is ordered by a local key.

The driver holds no rows: tables of sources and of at most BLOCKS blocks a source are Spark tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import WORD, materialise, row_key, same

#: Most blocks of a source; documents that a block aims at; rows of a cut block beyond which it is cut again.
BLOCKS, BLOCK_DOCS, CUT_DOCS = 4096, 128, 1024


def _zero() -> Column:
    return F.lit(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size -> sid, source, source_size, target.

    Sources by code point, null last, take ``weights`` in turn and share all words.  A target
    stops at ``cap`` times its source's size; what is over goes to the others by weight.  That
    has a closed form: in order of cap over weight, sources are capped while their cap is below
    their weight's share of what is left.  One row a source; a source is not a unit of data.
    """
    every = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.col("sid") % len(weights))
    df = sizes.withColumn("sid", turn).withColumn("w", w)
    df = df.withColumns({"most": cap * F.col("source_size"), "total": F.sum("source_size").over(every)})
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    df = df.withColumns(
        {
            "left": F.col("total") - (F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")),
            "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    df = df.withColumn("below", F.col("most") * F.col("rest") <= F.col("left") * F.col("w"))
    df = df.withColumn("capped", F.min("below").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    free = F.min(F.when(~F.col("capped"), F.struct(-F.col("rest"), "left"))).over(every)  # the first that is not capped
    share = F.col("free")["left"] * F.col("w") / -F.col("free")["col1"]
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share)
    return df.withColumn("free", free).select("sid", "source", "source_size", target.alias("target"))


def _slice(position: Column, n: Column) -> Column:
    """A block number below n from the leading bits of a hash."""
    return F.shiftright(F.shiftrightunsigned(position, 33) * n, 31).cast("int")


def _cut(rows: DataFrame, rest: DataFrame, seed: int, level: int) -> tuple[DataFrame, DataFrame]:
    """rows: sid, at, size, n_blocks; rest: sid, rest (words still wanted).

    Blocks in permuted order (sid, block, n, perm, drawn), and the cut one of each source: its block and the words wanted of it."""
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.join(rest, "sid").withColumn("perm", F.xxhash64(F.lit(seed + 7 * level), "sid", "block"))
    w = Window.partitionBy("sid").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("words").over(w)).withColumn("drawn", F.col("upto") <= F.col("rest"))
    blocks = materialise(blocks, f"mix-blocks{level}")
    cut = blocks.where(~F.col("drawn") & (F.col("upto") - F.col("words") < F.col("rest")))
    first = F.min(F.struct("perm", "block", "n", (F.col("rest") - F.col("upto") + F.col("words")).alias("gap")))
    cut = cut.groupBy("sid").agg(first.alias("c")).select("sid", F.col("c.block").alias("block"), F.col("c.n").alias("n"), F.col("c.gap").alias("rest"))
    return blocks.drop("rest", "upto", "words"), materialise(cut, f"mix-cut{level}")


def _fill(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """sid, at of the documents that fill what is wanted of a cut block: largest first while they fit,
    then the smallest other one if that comes nearer.  Rows of one hash go together."""
    units = rows.groupBy("sid", "at").agg(F.sum("size").alias("size"))
    groups = units.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("size", "at")), asc=False).alias("docs")).join(rest, "sid")
    state = F.struct(F.col("rest").alias("gap"), F.array().cast("array<bigint>").alias("at"))

    def add(s, d, most):
        return F.when((d["size"] <= most) & (d["size"] > 0), F.struct((s["gap"] - d["size"]).alias("gap"), F.concat(s["at"], F.array(d["at"])).alias("at"))).otherwise(s)

    picked = F.aggregate("docs", state, lambda s, d: add(s, d, s["gap"]))
    groups = groups.withColumn("s", picked)
    others = F.filter("docs", lambda d: ~F.array_contains(F.col("s.at"), d["at"]) & (d["size"] > 0))
    groups = groups.withColumn("o", F.element_at(F.concat(F.array(F.lit(None).cast("struct<size:bigint,at:bigint>")), others), -1))
    more = F.when(F.col("o.size") < 2 * F.col("s.gap"), F.concat(F.col("s.at"), F.array(F.col("o.at")))).otherwise(F.col("s.at"))
    return groups.select("sid", F.explode(more).alias("at"))


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric number by inversion, summed outwards from the mode (eight standard deviations and eight)."""
    N, K, n = (c.cast("double") for c in (population, good, draws))
    low, high = F.greatest(F.lit(0.0), n - (N - K)), F.least(n, K)
    mode = F.least(F.greatest(F.floor((n + 1) * (K + 1) / (N + 2)).cast("double"), low), high)
    sd = F.sqrt(F.coalesce(F.try_divide(n * K * (N - K) * (N - n), N * N * (N - 1)), F.lit(0.0)))
    reach = F.ceil(8 * sd + 8).cast("double")
    top, bottom = F.least(high, mode + reach), F.greatest(low, mode - reach)
    entry = "array<struct<k:double,w:double>>"

    def walk(first, last, up):
        steps = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        if not up:
            steps = F.reverse(steps)

        def step(s, k):
            k = k.cast("double")
            w = s["w"] * ((K - k + 1) * (n - k + 1) / (k * (N - K - n + k)) if up else (k + 1) * (N - K - n + k + 1) / ((K - k) * (n - k)))
            return F.struct(w.alias("w"), F.concat(s["out"], F.array(F.struct(k.alias("k"), w.alias("w")))).alias("out"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.array().cast(entry).alias("out")), step, lambda s: s["out"])

    chances = F.concat(F.array(F.struct(mode.alias("k"), F.lit(1.0).alias("w"))), walk(mode + 1, top, True), walk(bottom, mode - 1, False))
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x["w"])

    def pick(s, x):
        left = s["left"] - x["w"]
        return F.struct(left.alias("left"), F.when((s["left"] > 0) & (x["w"] > 0), x["k"]).otherwise(s["k"]).alias("k"))

    return F.aggregate(chances, F.struct((u * total).alias("left"), mode.alias("k")), pick, lambda s: s["k"].cast("long"))


def _split_step(seed: int, level: int):
    def step(s, k):
        x = hypergeometric(s["pop"], k, s["want"], _uniform(F.lit(seed), F.lit(level), F.col("leaf"), s["i"]))
        return F.struct((s["pop"] - k).alias("pop"), (s["want"] - x).alias("want"), F.concat(s["out"], F.array(x)).alias("out"), (s["i"] + 1).alias("i"))

    return step


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: one row, q = array of blocks drawn of each source -> leaf, q: what each shard gets of each source.

    ``shards`` is a power of two; leaves differ by one block at most in all."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    nodes = quotas.select(F.lit(0).alias("leaf"), "q")
    sum_of = lambda q: F.aggregate(q, _zero(), lambda a, x: a + x)
    for level in range(levels):
        total = F.col("total")
        nodes = nodes.withColumn("total", sum_of("q"))
        state = F.struct(total.alias("pop"), F.floor(total / 2).cast("long").alias("want"), F.array().cast("array<bigint>").alias("out"), F.lit(0).alias("i"))

        nodes = nodes.withColumn("left", F.aggregate("q", state, _split_step(seed, level), lambda s: s["out"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        children = F.array(F.struct((F.col("leaf") * 2).alias("leaf"), F.col("left").alias("q")), F.struct((F.col("leaf") * 2 + 1).alias("leaf"), right.alias("q")))
        nodes = nodes.select(F.explode(children).alias("c")).select("c.*")
    return nodes


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, shards: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, rk, source, size, source_size, target, copies, taken for every row.

    size: words of the text (null: 0); see ``targets``.  copies: array of (epoch, shard), one for
    each time that the mix takes the document; taken: size times their number.  A source's taken
    words miss its target by less than half of the smallest untaken document of one block.  The
    draw depends on ``seed``, doc_id and text alone.  Rows equal in doc_id and text go together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialise(rows.withColumn("at", F.xxhash64(F.lit(seed), "rk")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = targets(sizes.drop("n"), weights, cap).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    goals = goals.withColumn("epochs", F.least(epochs, F.lit(cap))).withColumns(
        {"n_blocks": F.least(F.ceil(F.col("n") / BLOCK_DOCS), F.lit(BLOCKS)).cast("int"), "rest": F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")}
    )
    goals = materialise(goals.drop("n"), "mix-goals")

    named = goals.withColumnRenamed("source", "s")
    of_source = lambda df: df.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = of_source(rows).withColumn("block", _slice(F.col("at"), F.col("n_blocks")))
    blocks, cut = _cut(placed.select("sid", "block", "at", "size"), goals.select("sid", "rest"), seed, 0)
    part = placed.select("sid", "block", "at", "size").join(cut.select("sid", "block"), ["sid", "block"])
    last, picks, level = cut, [], 0
    while (last.agg(F.max("n")).first()[0] or 0) > CUT_DOCS and level < 4:
        level += 1
        part = materialise(part.drop("block").withColumn("block", _slice(F.xxhash64("at", F.lit(level)), F.lit(BLOCKS))), f"mix-part{level}")
        finer, last = _cut(part, last.select("sid", "rest"), seed, level)
        picks.append(part.join(finer.where("drawn").select("sid", "block"), ["sid", "block"]).select("sid", "at"))
        part = part.join(last.select("sid", "block"), ["sid", "block"])
    chosen = _fill(part, last.select("sid", "rest"))
    for more in picks:
        chosen = chosen.union(more)
    chosen = chosen.distinct().withColumn("picked", F.lit(True))

    # units of the deal: every block once an epoch, then the drawn ones and the cut one
    cut_key = cut.select("sid", "block", F.lit(True).alias("is_cut"))
    units = blocks.join(cut_key, ["sid", "block"], "left").join(goals.select("sid", "epochs"), "sid")
    last_epoch = F.col("epochs") + F.when(F.col("drawn") | F.coalesce("is_cut", F.lit(False)), 1).otherwise(0)
    units = units.select("sid", "block", "epochs", F.explode(F.when(last_epoch > 0, F.sequence(F.lit(0), last_epoch - 1))).alias("epoch"))
    nth = F.row_number().over(Window.partitionBy("sid").orderBy("epoch", F.xxhash64(F.lit(seed), "epoch", "block"), "block")) - 1
    units = materialise(units.withColumn("d", nth), "mix-units")
    quota = goals.select("sid").join(units.groupBy("sid").agg(F.count(F.lit(1)).alias("q")), "sid", "left")
    quotas = quota.agg(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("q", _zero()).alias("q")))).alias("a")).select(F.col("a.q").alias("q"))
    leaves = split_tree(quotas, shards, seed).select("leaf", F.posexplode("q").alias("sid", "got"))
    ends = leaves.withColumn("end", F.sum("got").over(Window.partitionBy("sid").orderBy("leaf")))
    ends = ends.groupBy("sid").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    dealt = units.join(ends, "sid").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("d"))))
    copy = F.struct("epoch", "shard")
    whole = F.array_sort(F.collect_list(F.when(~is_partial(), copy)))
    dealt = dealt.join(cut_key, ["sid", "block"], "left").groupBy("sid", "block").agg(whole.alias("copies"), F.max(F.when(is_partial(), copy)).alias("extra"))
    dealt = materialise(dealt, "mix-dealt")

    out = placed.drop("n_blocks", "rest", "epochs").join(dealt, ["sid", "block"], "left").join(chosen, ["sid", "at"], "left")
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    copies = F.concat(F.coalesce("copies", none), F.when(F.col("picked") & F.col("extra").isNotNull(), F.array("extra")).otherwise(none))
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "rk", "source", "size", "source_size", "target", "copies", (F.col("size") * F.size("copies")).alias("taken"))


def is_partial() -> Column:
    """The draw of a cut block in its last epoch: only chosen documents of it go along."""
    return F.coalesce("is_cut", F.lit(False)) & (F.col("epoch") == F.col("epochs"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's columns once for each copy, with epoch, shard and order_key.

    Written as it stands, it is laid out as dealt: shard after shard, each in the order of order_key, the
    local shuffle.  epoch, shard and order_key of the input are replaced, other columns pass through."""
    docs = docs.drop("epoch", "shard", "order_key")
    copies = draw(docs, **options).where(F.size("copies") > 0).select("doc_id", "rk", F.col("copies").alias("__copies")).dropDuplicates(["doc_id", "rk"])
    out = same(docs.withColumn("__rk", row_key()), copies, "inner", "__rk").withColumn("__copy", F.explode("__copies"))
    place = [F.col("__copy.epoch").alias("epoch"), F.col("__copy.shard").alias("shard"), F.xxhash64("__copy.shard", "__copy.epoch", "__rk").alias("order_key")]
    dealt = out.select(*(F.col(f"`{c}`") for c in docs.columns), *place)
    return dealt.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")
