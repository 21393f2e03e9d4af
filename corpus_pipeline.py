"""A training-data pipeline: quality rules, line and near deduplication, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from siteloom.llm.common import discard, materialise
from siteloom.llm.queries import rank_file

_READ = {"doc_id", "text", "lang", "source", "n_chars"}


def _apart(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """What ``stage`` makes of the columns that stages know; any others come along under names that no operator uses."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in _READ}
    out = stage(docs.withColumnsRenamed(names))
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; repeated rows stay or go together."""
    return _apart(quality_rules.keep_good, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text.  A null text becomes empty; rows that repeat a document count once."""

    def stage(docs: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(docs)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns)

    return _apart(stage, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; linked are those with a
    similarity of 0.8 or more.  Texts without words are linked with nothing and stay; repeats of one row all stay or go."""
    return _apart(lambda d: near_dedup.keep_one(d, percent=80), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the shards and of their local shuffles.
    Texts without words have no size and may come or stay away with their block; rows equal in doc_id and text go together."""
    return _apart(lambda d: mixing.mix(d).select(*d.columns), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with their digests; the text is what they decode to.  A null text has no ids."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in _READ}
    out = byte_bpe.encode(docs.withColumnsRenamed(names), rank_file()).drop("text", "n_chars")
    taken = set(out.columns)
    # what an added column would hide keeps a name of its own
    return out.withColumnsRenamed({v: k if k not in taken else f"input_{k}" for k, v in names.items()})


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Concentration steps, near duplicates and tokens have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
