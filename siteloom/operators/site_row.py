"""A site's row from all that was collected of it, by one shuffle.

Every dataset becomes long rows (run_id, site, a struct under the dataset's name); their union is grouped once, and each
figure is an aggregate over its own dataset's struct.  No dataset is joined, so their number does not matter and a
dataset that is missing, for a site or for all, leaves nulls or zeros.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import report

KEY = ["run_id", "site"]


def _c(dataset: str, name: str) -> Column:
    return F.col(f"{dataset}.{name}")


def _of(dataset: str, when: Column, value: Column) -> Column:
    return F.max(F.when(when, value))


def _some(when: Column) -> Column:
    return F.coalesce(F.bool_or(when), F.lit(False))


def _final(variant: str) -> Column:
    """Where a variant's chain ends: the URL of its last hop."""
    return F.max_by(_c("hops", "url"), F.when(_c("hops", "variant") == variant, _c("hops", "hop"))).alias(f"final_{variant}")


def _header(name: str, alias: str) -> Column:
    return _of("header_states", _c("header_states", "header") == name, _c("header_states", "state")).alias(alias)


#: Datasets, the columns (SQL text) that their rows bring, and the figures that come of them.
DATASETS: dict[str, tuple[dict[str, str], list[Column]]] = {}


def _declare() -> None:
    there = lambda d: F.count_if(F.col(d).isNotNull())
    status = _c("pages", "status")
    ok = status.between(200, 299)
    DATASETS.update(
        {
            "header_states": (
                {"header": "header", "state": "state.state"},
                [_header("strict-transport-security", "hsts"), _header("content-security-policy", "csp"), _header("x-frame-options", "xframe"), F.count_if(_c("header_states", "state") == "present").alias("headers_present")],
            ),
            "hops": (
                {"variant": "variant", "hop": "hop", "url": "url"},
                [F.bool_or(_c("hops", "variant").isin("httpRoot", "httpWww") & _c("hops", "url").startswith("https://")).alias("https_enforced"), *map(_final, ("httpRoot", "httpsRoot", "httpWww", "httpsWww"))],
            ),
            "robots": ({"ok": "coalesce(status = 200 and length(body) > 0, false)"}, [_some(_c("robots", "ok")).alias("robots_valid")]),
            "sitemap_urls": ({"seq": "seq"}, [there("sitemap_urls").alias("sitemap_urls")]),
            "sitemap_errors": ({"message": "message"}, [there("sitemap_errors").alias("sitemaps_failed")]),
            "plan": ({"n": "sample_size"}, [F.coalesce(F.sum(_c("plan", "n")), F.lit(0)).alias("pages_total")]),
            "pages": (
                {"status": "status"},
                [F.count_if(ok).alias("pages_sampled"), F.count_if(status.isin(401, 403)).alias("robots_blocking_count"), F.count_if(status >= 400).alias("fetch_errors"), F.count_if(status.isin(0, 408, 524)).alias("timeouts")],
            ),
            "signals": (
                {"mixed": "mixed_content", "product": "has_product_schema", "invalid": "invalid_schema_count", "images": "image_count", "bare": "images_without_alt"},
                [_some(_c("signals", "mixed")).alias("mixed"), F.count_if(_c("signals", "product")).alias("product_pages"), *(F.coalesce(F.sum(_c("signals", c)), F.lit(0)).cast("long").alias(n) for c, n in (("invalid", "invalid_schema"), ("images", "images"), ("bare", "images_without_alt")))],
            ),
            "links": ({"internal": "internal"}, [F.count_if(_c("links", "internal")).alias("internal_links"), F.count_if(~_c("links", "internal")).alias("external_links")]),
            "url_set": ({"url": "url"}, [there("url_set").alias("total_urls")]),
            "templates": ({"rank": "rank", "pattern": "pattern"}, [F.transform(F.array_sort(F.collect_list("templates")), lambda x: x["pattern"]).alias("patterns")]),
            "certificates": (
                {"protocol": "protocol", "issuer": "cert_issuer", "days": "days_ceil", "named": "size(sans) > 0"},
                [F.max(_c("certificates", "protocol")).alias("tls_protocol"), F.max(_c("certificates", "issuer")).alias("cert_issuer"), F.max(_c("certificates", "days")).alias("cert_days_left"), F.bool_or(_c("certificates", "named")).alias("cert_names")],
            ),
            "dns": ({"rtype": "rtype"}, [_some(_c("dns", "rtype") == "A").alias("dns_resolved"), _some(_c("dns", "rtype") == "AAAA").alias("has_ipv6")]),
            "well_known": ({"ok": "path = '/.well-known/security.txt' and status = 200"}, [_some(_c("well_known", "ok")).alias("security_txt")]),
            "lighthouse": ({c: c for c in ("score", "lcp", "cls", "tbt")}, [F.max(_c("lighthouse", c)).alias(n) for c, n in (("score", "performance_score"), ("lcp", "lcp"), ("cls", "cls"), ("tbt", "tbt"))]),
            "screenshots": ({"any": "desktop is not null or mobile is not null"}, [_some(_c("screenshots", "any")).alias("screenshots_captured")]),
            "serp_results": ({"position": "position"}, [there("serp_results").alias("serp_results")]),
            "dataset_states": ({"ok": "has_data"}, [F.avg(_c("dataset_states", "ok").cast("double")).alias("data_share")]),
            "findings": ({"severity": "severity"}, [there("findings").alias("findings")]),
        }
    )


def assembled(sites: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each site of ``sites`` with the figures of all ``DATASETS``; tables: those that there are, by name."""
    if not DATASETS:
        _declare()
    if strange := set(tables) - set(DATASETS):
        raise ValueError(f"unknown datasets: {sorted(strange)}")
    long = [sites.select(*KEY, F.struct(F.lit(True).alias("asked")).alias("spine")).distinct()]
    for name, (columns, _) in DATASETS.items():
        if name in tables:
            long.append(tables[name].select(*KEY, F.struct(*(F.expr(text).alias(c) for c, text in columns.items())).alias(name)))
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), long)
    figures = [f for name, (_, fs) in DATASETS.items() if name in tables for f in fs]
    return rows.groupBy(*KEY).agg(F.max("spine.asked").alias("asked"), *figures).where("asked").drop("asked")


def site_rows(sites: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``assembled`` rows of all datasets with what follows from them: hosts, scores, confidence, notes, quality."""
    df = assembled(sites, tables)
    c, absent = F.col, lambda h: F.when(F.col(h) == "absent", 1).otherwise(0)
    finals = F.filter(F.array(*(c(f"final_{v}") for v in ("httpRoot", "httpsRoot", "httpWww", "httpsWww"))), lambda u: u.isNotNull())
    www = F.transform(finals, lambda u: urls.host(u).startswith("www."))
    every, never = F.forall(www, lambda v: v), F.forall(www, lambda v: ~v)
    known = F.size(finals) > 0
    # enforcement that is known and false counts as absent
    score = report.security_score(F.coalesce(c("https_enforced"), F.lit(True)), absent("hsts") + absent("csp") + absent("xframe"), c("mixed"))
    figures = [c("pages_sampled"), c("pages_total"), c("fetch_errors"), c("findings")]
    quality = F.when(c("data_share") >= 0.8, "high").when(c("data_share") >= 0.5, "medium").when(c("data_share").isNotNull(), "low")
    out = df.withColumns(
        {
            "www_consistent": F.when(known, every | never), "www_preference": F.when(known & every, "www").when(known & never, "non-www"), "security_score": score, "first_template": F.try_element_at("patterns", F.lit(1)),
            "has_sitemap": c("sitemap_urls") > 0, "sitemaps_processed": F.when(c("sitemap_urls") > 0, 1).otherwise(0), "quality": quality, "confidence": report.confidence(*figures), "notes": report.reviewer_notes(*figures),
        }
    )
    return out.drop("data_share", "final_httpRoot", "final_httpsRoot", "final_httpWww", "final_httpsWww")
