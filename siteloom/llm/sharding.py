"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``nodes`` places on a ring of 64-bit positions; a row goes to the first place
clockwise from its own position whose shard is not full, so rows that meet a full shard go on
clockwise.  Rows are only counted per ring cell (a fixed number of cells); the walk along the
ring is one higher-order aggregate over those counts, and yields runs of ring ranks with their
shard and first slot.  Rows learn their rank within a cell from a window, cells being even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialise

#: Cells are cut from the ring by the leading bits of a position; a place on the ring is a cell's beginning.
CELL_BITS = 13


def _cell(position: Column) -> Column:
    return F.shiftrightunsigned(position, 64 - CELL_BITS).cast("int")


def _places(cells: DataFrame, shards: int, nodes: int) -> DataFrame:
    """The ring: each place (cell) of a virtual node with its shard; places in one cell follow each other by position."""
    spark = cells.sparkSession
    ring = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("node"), "id").alias("at"))
    return ring.select(_cell(F.col("at")).alias("place"), "at", "shard")


def _walk(arcs: Column, total: Column, shards: int) -> Column:
    """Along the ring, twice: each place takes from the queue of waiting rows what its shard has
    room for.  The queue is always a range of ring ranks, so its state is where it begins.

    arcs: array of (shard, upto), in ring order; upto: rows up to and with this arc.
    Returns an array of runs (upto, shard, base): ranks before upto go to shard, the first of the run to slot base.
    """
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0)).cast("long"))
    run = "array<struct<upto:bigint,first:bigint,shard:int,base:bigint>>"
    start = F.struct(room.alias("room"), room.alias("cap"), F.lit(0).cast("bigint").alias("done"), F.array().cast(run).alias("runs"))

    def step(s, arc):
        shard = arc["shard"]
        left = F.get(s["room"], shard)
        take = F.least(left, F.greatest(arc["upto"] - s["done"], F.lit(0).cast("bigint")))
        base = F.get(s["cap"], shard) - left
        new = F.struct((s["done"] + take).alias("upto"), s["done"].alias("first"), shard.alias("shard"), base.alias("base"))
        return F.when(
            take > 0,
            F.struct(
                F.transform(s["room"], lambda x, i: F.when(i == shard, x - take).otherwise(x)).alias("room"),
                s["cap"].alias("cap"),
                (s["done"] + take).alias("done"),
                F.concat(s["runs"], F.array(new)).alias("runs"),
            ),
        ).otherwise(s)

    second = F.transform(arcs, lambda a: F.struct(a["shard"].alias("shard"), total.alias("upto")))
    return F.aggregate(F.concat(arcs, second), start, step, lambda s: s["runs"])


def shard_documents(docs: DataFrame, shards: int = 24, nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    law is ``rows``: counts per shard are at most one apart (shard i holds one more than the
    least if i < count mod shards).  size: UTF-8 bytes of the text (null: none) plus 8;
    text_crc32: of the text's UTF-8 bytes (null: of none).  slot: gapless from 0 in each shard.
    grown_shard is null, as under this law.  A row's position is a hash of doc_id and text; rows
    equal in both have one position and are ranked in no set order, which no reader can see.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", F.col("text").isNull(), "text").alias("at"),
    ).withColumn("cell", _cell(F.col("at")))
    rows = materialise(rows, "ring-rows")
    # a fixed number of cells: 2 ** CELL_BITS at most
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    ring = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.withColumn("upto", F.sum("n").over(ring)).withColumn("begin", F.col("upto") - F.col("n"))
    cells = materialise(cells, "ring-cells")
    # the arc that ends at a place holds the cells after the place before it, up to the place's own
    places = _places(cells, shards, nodes).withColumnRenamed("place", "cell")
    marked = places.join(cells.select("cell", "upto"), "cell", "full")
    filled = marked.withColumn("upto", F.coalesce(F.max("upto").over(ring), F.lit(0).cast("long")))
    arcs = filled.where("shard is not null").agg(F.array_sort(F.collect_list(F.struct("cell", F.shiftrightunsigned("at", 1).alias("at"), "shard", "upto"))).alias("arcs"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))
    both = arcs.join(total, how="cross")  # one row each
    walked = both.select("total", F.explode(_walk(F.transform("arcs", lambda a: F.struct(a["shard"].alias("shard"), a["upto"].alias("upto"))), F.col("total"), shards)).alias("run"))
    runs = materialise(walked.select("run.*"), "ring-runs")
    # runs by cell: a cell's ranks lie in the runs that begin in it, and the one that was open before
    points = cells.select(F.col("begin").alias("v"), F.lit(1).alias("kind"), "cell", F.lit(None).cast(runs.schema.simpleString()).alias("run"))
    points = points.union(runs.select("first", F.lit(0), F.lit(None).cast("int"), F.struct("upto", "first", "shard", "base")))
    back = Window.orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"open": F.last("run", True).over(back), "home": F.last("cell", True).over(back)})
    opened = points.where("kind = 1").select("cell", F.col("open").alias("run"))
    begun = points.where("kind = 0 and home is not null").select(F.col("home").alias("cell"), "run")
    by_cell = opened.union(begun).groupBy("cell").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    offsets = cells.select("cell", "begin").join(by_cell, "cell")
    within = Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, "cell").withColumn("rank", F.col("rank") + F.col("begin"))
    run = F.element_at(F.filter("runs", lambda r: r["upto"] > F.col("rank")), 1)
    placed = ranked.withColumn("run", run)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.base") + F.col("rank") - F.col("run.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
