"""The link graph of each site: edges, broken links, orphans, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls

KEY = ["run_id", "site"]


def edges(links: DataFrame) -> DataFrame:
    """Distinct internal edges by comparison key; links to the page itself count."""
    return links.where("internal").select(*KEY, urls.link_key(F.col("url")).alias("src"), urls.link_key(F.col("link_url")).alias("dst")).distinct()


def _missing(pages: DataFrame) -> DataFrame:
    return pages.where("status = 404").select(*KEY, urls.link_key(F.col("url")).alias("dst")).distinct()


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links whose target was fetched and not found."""
    keyed = links.where("internal").withColumn("dst", urls.link_key(F.col("link_url")))
    return keyed.join(_missing(pages), [*KEY, "dst"], "left_semi")


def broken_fan_in(broken: DataFrame) -> DataFrame:
    """For each broken target how many links and pages lead to it."""
    return broken.groupBy(*KEY, "link_url").agg(F.count(F.lit(1)).alias("link_count"), F.count_distinct("url").alias("page_count"), F.min("crawl_seq").alias("first_seen"))


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Fetched pages other than the root that no internal link names."""
    named = edges(links).select(*KEY, "dst").distinct()
    keyed = pages.where(urls.path(F.col("url")) != "/").withColumn("dst", urls.link_key(F.col("url")))
    return keyed.join(named, [*KEY, "dst"], "left_anti").select(*KEY, "crawl_seq", "url")


def uncrawled_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal targets that were not fetched."""
    known = pages.select(*KEY, urls.link_key(F.col("url")).alias("dst")).distinct()
    return edges(links).select(*KEY, "dst").distinct().join(known, [*KEY, "dst"], "left_anti")


def summary(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per site: distinct internal and external targets, pages not found, orphans."""
    per = links.groupBy(*KEY).agg(F.count_distinct(F.when(F.col("internal"), F.col("link_url"))).alias("internal_links"), F.count_distinct(F.when(~F.col("internal"), F.col("link_url"))).alias("external_links"))
    gone = pages.groupBy(*KEY).agg(F.count_if(F.col("status") == 404).alias("broken_pages"))
    lost = orphans(links, pages).groupBy(*KEY).agg(F.count(F.lit(1)).alias("orphan_pages"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return gone.join(per, KEY, "left").join(lost, KEY, "left").select(*KEY, *(zero(c) for c in ("internal_links", "external_links", "broken_pages", "orphan_pages")))
