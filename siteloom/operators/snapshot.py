"""A site's snapshot from its collected tables, as much of it as is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators import audit, collected, collectors, images, jsonld, link_graph, page_signals, site_facts
from siteloom.operators.site_facts import unknown

KEY = ["run_id", "site"]
#: Families of extraction and the collected tables that each reads.
READS = {
    "html_signals": ["fetches"], "schema": ["fetches"], "links": ["fetches"], "images": ["fetches"], "security_headers": ["roots"], "infra": ["chains", "tls", "dns_records"], "perf": ["lighthouse"],
    "coverage": ["sampled_pages", "dataset_flags", "sitemap_errors", "sitemap_urls"], "urlset": ["fetches", "sitemap_urls"],
}


def _flag(value: Column, reason: str) -> Column:
    """A boolean as a present state, unknown where there is none."""
    return F.when(value.isNotNull(), site_facts.present(value.cast("string"))).otherwise(unknown(reason))


def host_states(sites: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, site, https_enforced, host_consistency, www_preference as states: unknown without redirects, and the preference where hosts differ."""
    rules = site_facts.host_rules(chains).select(*KEY, "https_enforced", "www_consistent", "www_preference")
    df = sites.select(*KEY).distinct().join(rules, KEY, "left")
    mixed = F.col("www_consistent").isNotNull() & F.col("www_preference").isNull()
    return df.select(
        *KEY, _flag(F.col("https_enforced"), "No redirect data").alias("https_enforced"), _flag(F.col("www_consistent"), "No redirect data").alias("host_consistency"),
        F.when(mixed, unknown("Inconsistent www usage")).otherwise(_flag(F.col("www_preference"), "No redirect data")).alias("www_preference"),
    )


def infra(sites: DataFrame, chains: DataFrame, tls: DataFrame, records: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Host states, certificate states, delivery network and hosting of each site.

    tls: rows of ``collectors.tls_facts``; records: DNS records (rtype, pos, value), of which aliases are looked at before addresses; as_of: now by default.
    """
    moment = F.current_timestamp() if as_of is None else as_of
    place = lambda late, pos: F.struct(late.cast("int").alias("late"), pos.cast("long").alias("pos")).alias("pos")
    named = records.where(F.col("rtype").isin("A", "CNAME")).select(*KEY, place(F.col("rtype") == "A", F.col("pos")), "value", F.lit(None).cast("string").alias("issuer"))
    named = named.unionByName(tls.select(*KEY, place(F.lit(-1), F.lit(-1)), F.lit("").alias("value"), F.col("cert_issuer").alias("issuer")))
    states = collectors.certificate_states(site_facts.certificates(tls, moment))
    df = host_states(sites, chains).join(site_facts.infrastructure(named), KEY, "left").join(states, KEY, "left")
    return df.withColumns({c: F.coalesce(c, unknown("No TLS data")) for c in states.columns if c not in KEY})


def site_wide(sites: DataFrame, headers: DataFrame | None, hosts: DataFrame | None, robots: DataFrame, sitemaps: DataFrame, url_set: DataFrame | None, templates: DataFrame | None) -> DataFrame:
    """One row a site; what was not extracted is unknown, empty or zero.

    headers: states by header; hosts: ``host_states``; robots: status and body; sitemaps: run_id and site of the sites
    whose sitemaps were collected; url_set and templates as ``site_facts`` has them.
    """
    df = sites.select(*KEY).distinct()
    valid = robots.groupBy(*KEY).agg(F.bool_or(F.coalesce((F.col("status") == 200) & (F.length("body") > 0), F.lit(False))).alias("robots_valid"))
    df = df.join(valid, KEY, "left").join(sitemaps.select(*KEY).distinct().withColumn("sitemap_count", F.lit(1)), KEY, "left")
    if headers is not None:
        states = headers.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "state")))).alias("security_headers"))
        df = df.join(states, KEY, "left")
    if hosts is not None:
        df = df.join(hosts.select(*KEY, "https_enforced", "host_consistency", "www_preference"), KEY, "left")
    if url_set is not None:
        df = df.join(url_set.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_urls")), KEY, "left")
        df = df.join(templates.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pattern"))), lambda x: x["pattern"]).alias("template_patterns")), KEY, "left")
    kind = unknown("Not extracted")
    for c in ("https_enforced", "host_consistency", "www_preference"):
        df = df.withColumn(c, kind if hosts is None else F.coalesce(c, unknown("No redirect data")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<state:string,value:string,reason:string>>"))
    total = F.lit(0).cast("long") if url_set is None else F.coalesce("total_urls", F.lit(0).cast("long"))
    patterns = F.array().cast("array<string>")
    return df.select(
        *KEY, (none if headers is None else F.coalesce("security_headers", none)).alias("security_headers"), "https_enforced", "host_consistency", "www_preference",
        F.coalesce("robots_valid", F.lit(False)).alias("robots_valid"), F.lit(0).cast("long").alias("robots_blocking_count"), F.coalesce("sitemap_count", F.lit(0)).alias("sitemap_count"),
        # the set holds each URL once
        total.alias("total_urls"), total.alias("unique_urls"), (patterns if url_set is None else F.coalesce("template_patterns", patterns)).alias("template_patterns"),
    )


def extract(raw: Mapping[str, Callable[[], DataFrame]], sites: DataFrame, only: Iterable[str] | None = None, as_of: Column | None = None) -> dict[str, DataFrame]:
    """The parts of the snapshot that the families asked for give (all by default), as tables.

    raw: names of collected tables to functions that read them.  Only the tables of the families asked for are read (``READS``; robots and
    sitemap_urls for the site's row too), so nothing else enters a plan.  Parts: ``pages``, ``schema``, ``links``, ``images``, ``perf``, ``coverage``,
    ``url_set`` with ``templates``, and ``site_wide`` where headers or infrastructure are asked for.  An unknown family raises.
    """
    wanted = set(READS if only is None else only)
    if strange := wanted - set(READS):
        raise ValueError(f"unknown families: {sorted(strange)}")
    read: dict[str, DataFrame] = {}

    def of(name: str) -> DataFrame:
        if name not in read:
            read[name] = raw[name]()
        return read[name]

    out: dict[str, DataFrame] = {}
    if "html_signals" in wanted:
        out["pages"] = page_signals.extract(of("fetches"))
    if "schema" in wanted:
        out["schema"] = jsonld.summary(page_signals.extract(of("fetches"), ["schema"]))
    if "links" in wanted:
        out["links"] = link_graph.summary(page_signals.page_links(of("fetches"), texts=False), of("fetches").select(*KEY, "crawl_seq", "url", "status"))
    if "images" in wanted:
        out["images"] = images.summary(images.inventory(of("fetches")))
    if "perf" in wanted:
        out["perf"] = collected.ratings(collected.lighthouse(of("lighthouse")))
    if "coverage" in wanted:
        out["coverage"] = audit.coverage_report(of("sampled_pages"), of("dataset_flags"), of("sitemap_errors"), of("sitemap_urls"))
    if "urlset" in wanted:
        urls = of("fetches").select(*KEY, "crawl_seq", "url")
        out["url_set"] = site_facts.url_set(urls, of("sitemap_urls"))
        # the place of first sight stands for the crawl's order
        out["templates"] = site_facts.url_templates(out["url_set"].withColumnRenamed("at", "crawl_seq"))
    if wanted & {"security_headers", "infra"}:
        headers = site_facts.security_headers(of("roots")) if "security_headers" in wanted else None
        hosts = None
        if "infra" in wanted:
            out["infra"] = infra(sites, of("chains"), of("tls"), of("dns_records"), as_of)
            hosts = out["infra"]
        out["site_wide"] = site_wide(sites, headers, hosts, of("robots"), of("sitemap_urls"), out.get("url_set"), out.get("templates"))
    return out
