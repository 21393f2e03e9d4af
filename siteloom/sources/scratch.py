"""A shared folder for stream output and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session names in spark.checkpoint.dir.  Without one only a local session gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/siteloom-{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Written to the shared folder and read again: what several aggregations read is computed once.  ``settings`` of the session hold while it is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a recursive query are not counted against a limit: they follow the input.
RECURSIVE = {"spark.sql.cteRecursionRowLimit": "-1"}
