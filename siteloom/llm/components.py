"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: everyone hangs its neighbours (larger ones, or smaller ones) on its least neighbour."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """links: u, v (long) -> node, root: every node of a link with the least node it is connected to.

    Each round is written out; the driver sees a count and a checksum.  The number of rounds grows
    with the logarithm of the longest chain; beyond ``most`` rounds it raises rather than return part.
    """
    edges = materialise(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(most):
        edges = materialise(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = now
    raise RuntimeError("components did not settle")
