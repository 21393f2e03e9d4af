"""Sinks of reports: a folder for each run and site, rewritten as a whole when the run is written again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OVERWRITE = "partitionOverwriteMode"


def write_documents(reports: DataFrame, path: str, column: str = "value", files: int | None = None) -> None:
    """One document (a string column) for each run and site, as a text file below ``path``/run_id=.../site=.../.

    The folders of the runs and sites at hand are replaced when the job commits, those of others are left alone, so a run that is
    written twice, or again after a failure, leaves one document a site.  Rows are dealt by site over ``files`` tasks (the session's
    shuffle partitions by default), so that a task writes many small folders and no folder is written by two.  Several rows of a site are one
    document, in the order of their text.
    """
    keys = ["run_id", "site"]
    # line feeds inside a document stay: a row is a file's whole text
    whole = reports.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(column)), "\n").alias("value"))
    spread = whole.repartition(files, *keys) if files else whole
    spread.select("value", *keys).write.mode("overwrite").option(_OVERWRITE, "dynamic").partitionBy(*keys).text(path)


def read_documents(spark, path: str) -> DataFrame:
    """run_id, site, value as ``write_documents`` left them, a row for each document."""
    return spark.read.schema("value string, run_id string, site string").text(path, wholetext=True).select("run_id", "site", F.regexp_replace("value", "\n$", "").alias("value"))


def write_table(rows: DataFrame, path: str) -> None:
    """A typed table as Parquet by run, replaced run by run in the same way."""
    rows.write.mode("overwrite").option(_OVERWRITE, "dynamic").partitionBy("run_id").parquet(path)
