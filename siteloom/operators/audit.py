"""The audit of a site as a whole: findings of all audits in one table, and the site's row from all its datasets."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import checks
from siteloom.operators.findings import evidence
from siteloom.operators.site_facts import template

KEY = ["run_id", "site"]
#: Audits in the order in which they run, each with its checks in the order in which it emits them; the last two are answers of models.
EMISSION = {**{a: [c.check_id for c in held] for a, held in checks.AUDITS.items()}, "visual": ["visual.model"], "serp": ["serp.model"]}
FAILED = "audit.failed"
#: Datasets that a collection run leaves for a site (fixed values).
DATASETS = ["root_fetch", "redirect_map", "robots_txt", "sitemaps", "sampling_plan", "html_samples", "tls_facts", "dns_facts", "well_known", "lighthouse", "screenshots", "serp_raw", "scan"]


def _place(audit: Column, check: Column) -> Column:
    """An audit's number times a hundred, and the check's number in it."""
    order = [f"{a}|{c}" for a, checks in EMISSION.items() for c in checks]
    number = [100 * i + j for i, checks in enumerate(EMISSION.values()) for j in range(len(checks))]
    failed = [(f"{a}|{FAILED}", 100 * i) for i, a in enumerate(EMISSION)]
    places = F.create_map(*(F.lit(x) for kv in [*zip(order, number, strict=True), *failed] for x in kv))
    return F.coalesce(F.try_element_at(places, F.concat(audit, F.lit("|"), check)), F.lit(9999))


def failures(jobs: DataFrame) -> DataFrame:
    """A finding for each rule audit (run_id, site, audit, error) that did not complete.  A model audit that fails gives none, and costs no score."""
    rows = jobs.where(F.col("audit").isin(*checks.AUDITS))
    message = F.concat("audit", F.lit(" audit failed to complete"))
    return rows.select(
        *KEY, "audit", F.lit(FAILED).alias("check_id"), F.lit("crawl_unreachable").alias("type"), F.lit("critical").alias("severity"), message.alias("message"),
        F.lit(None).cast("array<string>").alias("affected_urls"), evidence(detail=F.col("error")).alias("evidence"), F.lit(0).cast("long").alias("place"),
    )


def _rows(audit: str, t: DataFrame) -> DataFrame:
    """Findings in the common shape; message, evidence, affected_urls and place are optional."""
    have = set(t.columns)
    urls_ = F.col("affected_urls") if "affected_urls" in have else F.lit(None).cast("array<string>")
    basis = F.col("evidence") if "evidence" in have else evidence()
    place = F.col("place").cast("long") if "place" in have else F.lit(0).cast("long")
    message = F.col("message") if "message" in have else F.lit(None).cast("string")
    return t.select(*KEY, F.lit(audit).alias("audit"), "check_id", "type", "severity", message.alias("message"), urls_.alias("affected_urls"), basis.alias("evidence"), place.alias("place"))


def united(families: dict[str, list[DataFrame]], failed: DataFrame | None = None) -> DataFrame:
    """Findings of all audits in one table, in no order: what scores and counts need.  An audit listed in ``failed`` has its failure, if it has one, in place of its findings."""
    parts = [_rows(audit, t) for audit, tables in families.items() for t in tables]
    whole = functools.reduce(DataFrame.unionByName, parts)
    if failed is None:
        return whole
    return whole.join(failed.select(*KEY, "audit").distinct(), [*KEY, "audit"], "left_anti").unionByName(failures(failed))


def merged(families: dict[str, list[DataFrame]], failed: DataFrame | None = None) -> DataFrame:
    """Findings of all audits: run_id, site, ordinal, audit, check_id, type, severity, message, affected_urls, evidence.

    families: audit -> tables of findings (evidence, affected_urls and place, the order within one check, are optional).
    ordinal: the order in which a run emits them, audit after audit, from 1 in each site.
    """
    order = Window.partitionBy(*KEY).orderBy(_place(F.col("audit"), F.col("check_id")), "place", "message")
    return united(families, failed).withColumn("ordinal", F.row_number().over(order)).drop("place")


def run_checks(tables: Mapping[str, Callable[[], DataFrame]], sites: DataFrame, only: Iterable[str] | None = None, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings of the audits and checks asked for (by name; all rule audits by default), as ``merged`` has them, and the run's totals.

    Totals: run_id, site, completed and failed (the names asked for, in that order), total_findings.  A name that neither an audit nor a check has counts
    as failed; a name of an audit that did not complete for a site (``failed``: run_id, site, audit, error) is failed there.
    """
    names = list(checks.AUDITS) if only is None else list(dict.fromkeys(only))
    asked, unknown = checks.resolve(names)
    stopped = None if failed is None else failed.where(F.col("audit").isin(*asked))
    families = checks.compile(tables, names)
    if families:
        found = merged(families, stopped)
    else:
        found = merged({"crawl": [failures(sites.limit(0).select(*KEY, F.lit("crawl").alias("audit"), F.lit("").alias("error")))]})
    owner = {n: n if n in checks.AUDITS else checks.REGISTRY[n][0] for n in names if n not in unknown}
    spine = sites.select(*KEY).distinct()
    if stopped is not None:
        spine = spine.join(stopped.groupBy(*KEY).agg(F.collect_set("audit").alias("stopped")), KEY, "left")
    else:
        spine = spine.withColumn("stopped", F.lit(None).cast("array<string>"))
    gone = lambda n: F.coalesce(F.array_contains("stopped", owner[n]), F.lit(False))
    some = lambda cells: F.array_compact(F.array(*cells).cast("array<string>"))
    done = some(F.when(~gone(n), F.lit(n)) for n in names if n in owner)
    lost = some(F.lit(n) if n in unknown else F.when(gone(n), F.lit(n)) for n in names)
    totals = spine.select(*KEY, done.alias("completed"), lost.alias("failed")).join(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_findings")), KEY, "left")
    return found, totals.withColumn("total_findings", F.coalesce("total_findings", F.lit(0).cast("long")))


def datasets(found: DataFrame) -> DataFrame:
    """run_id, site, dataset, has_data, has_error for every dataset of every site: found holds (dataset, data, error) as they came; what did not come has neither."""
    spine = found.select(*KEY).distinct().select(*KEY, F.explode(F.array(*(F.lit(d) for d in DATASETS))).alias("dataset"))
    rows = spine.join(found, [*KEY, "dataset"], "left")
    return rows.select(*KEY, "dataset", (F.col("data").isNotNull() & F.col("error").isNull()).alias("has_data"), F.col("error").isNotNull().alias("has_error"))


def sampled(pages: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` pages of each site."""
    return pages.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("crawl_seq", "url"))).where(F.col("__r") <= most).drop("__r")


def sampling_plan(found: DataFrame, most: int = 50) -> DataFrame:
    """Groups by first path segment of each site's first ``most`` sitemap URLs: pattern, sample_size, first URL."""
    rows = found.where(F.col("seq") <= most).where(urls.host(F.col("url")) != "")
    segment = F.regexp_extract(urls.path(F.col("url")), "^/+([^/]+)", 1)
    pattern = F.when(segment == "", "/").otherwise(F.concat(F.lit("/"), segment, F.lit("/*")))
    return rows.groupBy(*KEY, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("sample_size"), F.min_by("url", "seq").alias("first_url"))


def page_kinds(pages: DataFrame) -> DataFrame:
    """Which kinds of page a site's templates show.  has_blog asks for types named blog or article, as published; blog posts have a flag of their own."""
    kind = template(urls.path(F.col("url")))["type"]
    some = lambda *names: F.coalesce(F.bool_or(F.col("k").isin(*names)), F.lit(False))
    return pages.select(*KEY, kind.alias("k")).groupBy(*KEY).agg(
        some("product", "pdp").alias("has_product_pages"), some("blog", "article").alias("has_blog_pages"), some("collection", "category").alias("has_collection_pages"),
        some("category").alias("has_category_pages"), some("blog-post").alias("has_blog_posts"),
    )


def matches_template(url: Column, pattern: Column) -> Column:
    """Whether a URL ends in what a pattern with {slots} stands for."""
    return F.regexp_like(url, F.concat(F.regexp_replace(pattern, r"\{[^}]+\}", "[^/]+"), F.lit("$")))


def coverage_flags(sites: DataFrame, found: DataFrame, dns: DataFrame, tls: DataFrame, results: DataFrame, screenshots: DataFrame) -> DataFrame:
    """run_id, site and what was done: sitemaps, dns_resolved (an address), tls_verified (facts without an error), lighthouse_run, screenshots_captured (desktop or mobile),
    serp_checked (a result), scan_run.

    found: datasets as they came (dataset, data, error), which count where they hold data, even beside an error; dns: ``dns_facts``; tls: rows with error;
    results: search results; screenshots: desktop, mobile.
    """
    held = lambda n: F.coalesce(F.bool_or((F.col("dataset") == n) & F.col("data").isNotNull()), F.lit(False))
    data = found.groupBy(*KEY).agg(held("sitemaps").alias("sitemaps"), held("lighthouse").alias("lighthouse_run"), held("scan").alias("scan_run"))
    parts = [
        data, dns.select(*KEY, F.col("resolved").alias("dns_resolved")), tls.groupBy(*KEY).agg((F.count("error") == 0).alias("tls_verified")),
        results.groupBy(*KEY).agg(F.lit(True).alias("serp_checked")), screenshots.select(*KEY, (F.col("desktop").isNotNull() | F.col("mobile").isNotNull()).alias("screenshots_captured")),
    ]
    df = sites.select(*KEY).distinct()
    for t in parts:
        df = df.join(t, KEY, "left")
    return df.fillna(False)


def coverage_report(pages: DataFrame, facts: DataFrame, problems: DataFrame, found: DataFrame, plan: DataFrame) -> DataFrame:
    """What a run covered of each site, from its sampled pages and facts: lists, rates, the histogram of errors, limitations and warnings as they are told.

    pages: run_id, site, crawl_seq, url, status and whether the page was parsed, the answer rate limited, oversized and drawn by script;
    facts: ``coverage_flags``; problems: messages of sitemaps; found: URLs they list; plan: ``sampling_plan``, whose URLs are all that was attempted.
    Texts are fixed values.
    """
    p = F.col
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("crawl_seq", "url")))), lambda x: x["url"])
    ok = p("status").between(200, 299)
    per = pages.groupBy(*KEY).agg(
        F.count_if(ok).alias("pages_sampled"), F.count_if(ok & p("parsed")).alias("pages_parsed"), listed(p("status").isin(401, 403)).alias("blocked_urls"),
        F.transform(F.array_sort(F.collect_list(F.when(p("status") >= 400, F.struct("crawl_seq", "url", "status")))), lambda x: F.concat(x["url"], F.lit(": HTTP "), x["status"].cast("string"))).alias("fetch_errors"),
        listed(p("status").isin(0, 408, 524)).alias("timeout_urls"), listed(p("oversized")).alias("oversized_urls"), F.bool_or("by_script").alias("script_suspected"), F.bool_or("rate_limited").alias("rate_limiting"),
    )
    kinds = pages.where(p("status") >= 400).groupBy(*KEY, "status").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("HTTP "), p("status").cast("string")).alias("error"), "n")))).alias("error_breakdown"))
    errors = problems.groupBy(*KEY).agg(F.array_sort(F.collect_list("message")).alias("sitemap_errors"))
    listed_urls = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sitemap_urls"))
    attempted = plan.groupBy(*KEY).agg(F.sum("sample_size").alias("pages_total"))
    df = per.join(facts, KEY, "left")
    for t in (errors, listed_urls, attempted, kinds):
        df = df.join(t, KEY, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    df = df.withColumns({"sitemap_errors": F.coalesce("sitemap_errors", F.array().cast("array<string>")), "error_breakdown": F.coalesce("error_breakdown", none)}).fillna(0, ["sitemap_urls", "pages_total"])
    rate = lambda a, b: F.coalesce(F.try_divide(p(a).cast("double"), p(b)), F.lit(0.0))
    n = lambda c: F.size(c).cast("string")
    issues = F.array_compact(F.array(
        F.when(~p("sitemaps"), "No sitemap found"), F.when(p("sitemaps") & (F.size("sitemap_errors") > 0), F.concat(F.lit("Sitemap errors: "), F.array_join("sitemap_errors", ", "))),
        F.when(p("sitemaps") & (p("sitemap_urls") == 0), "Sitemap is empty")))
    blocked = F.array_compact(F.array(F.when(F.size("blocked_urls") > 0, F.concat(n("blocked_urls"), F.lit(" pages blocked by robots.txt")))))
    other = F.array_compact(F.array(F.when(p("rate_limiting"), "Rate limiting detected during crawl"), F.when(~p("lighthouse_run"), "Lighthouse performance audit failed")))
    warnings = F.array_compact(F.array(
        F.when(p("script_suspected"), "JavaScript rendering may be required for complete content"), F.when(F.size("timeout_urls") > 0, F.concat(n("timeout_urls"), F.lit(" URLs timed out during fetch"))),
        F.when(F.size("oversized_urls") > 0, F.concat(n("oversized_urls"), F.lit(" pages exceeded size limit")))))
    processed = p("sitemaps") & (p("sitemap_urls") > 0)
    return df.withColumns(
        {
            "limitations": F.concat(blocked, issues, other), "warnings": warnings, "sitemaps_processed": F.when(processed, 1).otherwise(0), "sitemaps_failed": F.when(p("sitemaps"), F.size("sitemap_errors")).otherwise(0),
            "coverage_rate": rate("pages_sampled", "pages_total"), "parse_rate": rate("pages_parsed", "pages_sampled"),
        }
    )
