"""Tables of collected facts, read with their columns spelled out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.site_facts import entries, header_value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gate_html(fetches: DataFrame) -> DataFrame:
    """A fetch row as collected: html only of HTML responses, a failed fetch has status 0 and none."""
    kind = F.lower(header_value(entries(fetches), "content-type"))
    html = F.when(kind.contains("text/html"), F.coalesce("html", F.lit(""))).otherwise("")
    return fetches.withColumns({"status": F.coalesce("status", F.lit(0)), "html": html})


def ascii_urls(rows: DataFrame, *columns: str) -> DataFrame:
    """URL columns (``url`` by default) with their hosts in ASCII, as links are resolved, so that pages and links meet."""
    return rows.withColumns({c: urls.to_ascii(F.col(c)) for c in columns or ("url",)})
