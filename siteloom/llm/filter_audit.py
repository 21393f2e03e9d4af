"""What filters remove in every order they may be applied in: an audit of how they interact.

A document matters only through its mask, the set of filters it fails, so each part of the
corpus comes down to at most 2^k cells (part, mask) with counts.  Each cell then meets the array of all orders
(broadcast with the masks) and folds over each of them with SQL's higher-order functions: a running state says
whether the cell still stands, and every step appends a structure of counts.  The cells of a
part are merged by sums element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import BLANK

_EDGE = " \t\n\x0b\x0c\r"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> list[Column]:
    """Whether a whole text (null: empty) fails A (under 100 words), B (under 80 % of them distinct), C (over 10 % capitals A-Z), D (holds one of #$%&*|)."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(_EDGE))
    words = F.when(trimmed != "", F.split(trimmed, BLANK)).otherwise(F.array().cast("array<string>"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def _bits(flags: list[Column]) -> Column:
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags[1:], 1)), F.when(flags[0], F.lit(1)).otherwise(F.lit(0)))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of ``mask`` (bit i: the i-th letter).

    Filter E: the text is that of a document with a smaller doc_id.  Copies of one text share every other bit, so a text is one
    row for each part and label it comes with, and only its smallest id is told apart; however often a text
    is repeated, no row is spread over its copies.  Texts are equal if 128 bits of them are.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _bits(failures(F.col("text"))).alias("low"),
        F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("again")).alias("h2"),
    )
    rows = narrow.groupBy("doc_id", "part", "low", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # rows of one id and text are one by now, so the least structure counts how many documents bear the least id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy("h1", "h2", "low", "part", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), nameless.alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("h1", "h2"))
    texts = texts.withColumn("first", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0) + F.col("nameless"))
    both = texts.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("low").alias("mask"), F.col("first").alias("n")), F.struct((F.col("low") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    counted = both.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def fold(cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, the counts and shapley from (part, mask, n, good, toxic): one row for each part, order and step."""
    spark, k = cell.sparkSession, len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    # one row for each mask: the letters it fails, and the array of all orders
    letters = F.filter(F.transform(F.array(*(F.struct(F.lit(x).alias("f"), F.lit(1 << i).alias("bit")) for i, x in enumerate(filters))), lambda s: F.when(F.col("mask").bitwiseAND(s["bit"]) != 0, s["f"])), lambda f: f.isNotNull())
    masks = spark.range(1 << k).select(F.col("id").cast("int").alias("mask")).select("mask", letters.alias("fails"), F.lit(orders).alias("orders"))
    zero = F.lit(0).cast("long")
    n, good, toxic = F.col("n"), F.col("good"), F.col("toxic")

    def step(state: Column, f: Column) -> Column:
        fails, stands = F.array_contains("fails", f), state["stands"]
        hit = stands & fails
        told = F.struct(
            f.alias("f"), F.when(stands & ~fails, n).otherwise(zero).alias("kept"), F.when(hit, n).otherwise(zero).alias("removed"), F.when(~stands & fails, n).otherwise(zero).alias("redundant"),
            F.when(fails & (F.size("fails") == 1), n).otherwise(zero).alias("unique_fails"), F.when(hit, good).otherwise(zero).alias("good_lost"), F.when(hit, toxic).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((stands & ~fails).alias("stands"), F.array_append(state["told"], told).alias("told"))

    kind = "array<struct<f:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("stands"), F.array().cast(kind).alias("told"))
    walked = F.flatten(F.transform("orders", lambda o: F.aggregate(F.split(o, ""), start, step, lambda s: s["told"])))
    told = cell.join(F.broadcast(masks), "mask").select("part", walked.alias("told"))
    # 2^k arrays a part at most
    arrays = told.groupBy("part").agg(F.collect_list("told").alias("all"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x["f"].alias("f"), *((x[c] + y[c]).alias(c) for c in COUNTS)))
    merged = arrays.select("part", F.aggregate(F.slice("all", 2, 1 << k), F.element_at("all", 1), add).alias("told"))
    shares = F.map_from_entries(F.transform(F.array(*map(F.lit, filters)), lambda f: F.struct(f, F.aggregate(F.filter("told", lambda x: x["f"] == f), zero, lambda a, x: a + x["removed"]))))
    rows = merged.select("part", shares.alias("shares"), F.posexplode("told").alias("at", "x"))
    return rows.select(
        "part", F.element_at(F.lit(orders), F.floor(F.col("at") / k).cast("int") + 1).alias("filter_order"), (F.col("at") % k + 1).cast("int").alias("step"),
        *(F.col(f"x.{c}").alias(c) for c in COUNTS), F.element_at("shares", F.col("x.f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of five filters in all 120 orders for each lang value (null: empty string), from whole ``documents`` and ``labels``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  Null texts are empty texts;
    repeated rows count each, and of several rows with a text's smallest id none fails E; a null doc_id is smaller than none.
    A doc_id labelled twice has a label if one of its rows says so.  Extra columns do not matter; an empty table has no parts, so no rows.
    """
    return fold(cells(docs, labels))
