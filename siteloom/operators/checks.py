"""The registry of checks: rules as data over several inputs, compiled to one pass for each input.

An input is a table of facts with a row a site (a row a page for ``pages``), made from collected tables by its builder in
``INPUTS``.  A rule's parts are SQL text over the columns of its input.  Only the inputs of checks that are asked for are built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators import collected, collectors, findings, site_facts
from siteloom.operators.findings import PageCheck

KEY = ["run_id", "site"]


@dataclass(frozen=True)
class Check:
    """A rule over one input.  All parts but the names are SQL text: ``when`` it fires, its severity and message, and what it rests on:
    a count, samples (array of structs url, value), a detail and the URLs affected."""

    check_id: str
    input: str
    type: str
    severity: str
    when: str
    message: str
    count: str = "null"
    samples: str = "array()"
    detail: str = "null"
    urls: str = "cast(null as array<string>)"


def _shown(array: str, n: int, url: str = "x.url", value: str = "cast(null as string)") -> str:
    """SQL text for the first ``n`` entries of an array as samples."""
    return f"transform(slice({array}, 1, {n}), x -> named_struct('url', cast({url} as string), 'value', cast({value} as string)))"


_GROUPED = {"count": "n", "samples": "samples", "urls": "urls"}
#: The checks of each audit in the order in which it emits them.  Ids, types, severities, messages, limits and caps are fixed values.
CRAWL = [
    Check("crawl.robots_blocked", "robots", "crawl_robots_blocked", "if(home, 'critical', 'warning')", "size(s) > 0", "concat('robots.txt blocks important sections: ', array_join(transform(s, x -> x.section), ', '))", "size(s)", _shown("s", 10, "null", "x.line")),
    Check("crawl.sitemap_missing", "crawl", "crawl_sitemap_missing", "'warning'", "refs = 0 and found = 0", "'No sitemap.xml found or referenced in robots.txt'"),
    Check("crawl.sitemap_empty", "crawl", "crawl_sitemap_empty", "'warning'", "refs > 0 and found = 0", "'Sitemap referenced but could not be parsed or is empty'"),
    Check("crawl.sitemap_foreign_host", "crawl", "crawl_sitemap_missing", "'info'", "foreign > 0", "'Sitemap contains URLs with non-canonical hostnames'", "foreign", _shown("foreign_urls", 5)),
    Check("crawl.redirect_chain", "crawl", "crawl_unreachable", "'warning'", "long > 0", "format_string('Excessive redirect chains detected (%d chains with >3 hops)', long)", "long", _shown("long_chain", 5, value="x.status")),
    Check("crawl.host_conflict", "crawl", "crawl_unreachable", "'warning'", "host_conflict", "'Inconsistent host configuration: www and non-www hosts serve different content'"),
    Check("crawl.http_no_https", "crawl", "crawl_unreachable", "'critical'", "http_stays", "'HTTP root does not redirect to HTTPS'"),
    Check("crawl.param_urls", "crawl", "crawl_unreachable", "'info'", "params > 0", "format_string('Detected %d URLs with query parameters', params)", "params", _shown("param_urls", 10)),
]
_PAGE = {c.check_id: c for c in findings.page_checks()}
TECHNICAL = [
    _PAGE["tech.missing_title"],
    Check("tech.duplicate_title", "titles", "tech_duplicate_title", "'warning'", "n > 0", "format_string('%d pages have duplicate titles (%d unique duplicates)', n, `groups`)", **_GROUPED),
    *(_PAGE[f"tech.{x}"] for x in ("title_long", "title_short", "missing_desc")),
    Check("tech.duplicate_desc", "descriptions", "tech_duplicate_meta_desc", "'warning'", "n > 0", "format_string('%d pages have duplicate meta descriptions', n)", **_GROUPED),
    *(_PAGE[f"tech.{x}"] for x in ("desc_long", "missing_h1", "multiple_h1", "heading_hierarchy", "missing_canonical", "canonical_mismatch", "product_schema", "schema_invalid")),
    Check("tech.broken_links", "links", "tech_broken_links", "'warning'", "n > 0", "format_string('%d broken internal links found across %d pages', n, pages)", **_GROUPED),
    *(_PAGE[f"tech.{x}"] for x in ("mixed_content", "viewport", "charset", "lang")),
]
SECURITY = [
    Check("sec.hsts", "headers", "sec_missing_hsts", "'critical'", "array_contains(m, 'strict-transport-security')", "'Missing Strict-Transport-Security (HSTS) header'"),
    Check("sec.csp", "headers", "sec_missing_csp", "'warning'", "array_contains(m, 'content-security-policy')", "'Missing Content-Security-Policy header'"),
    Check("sec.xframe", "headers", "sec_missing_xframe", "'warning'", "array_contains(m, 'x-frame-options')", "'Missing X-Frame-Options header'"),
    Check("sec.other_headers", "headers", "sec_missing_csp", "'info'", "size(rest) > 0", "concat(size(rest), ' additional security headers missing')", "size(rest)", detail="array_join(rest, ', ')"),
    Check("sec.https", "hosts", "sec_missing_https", "'critical'", "not https_enforced", "'HTTPS is not properly enforced'", detail="'false'"),
    Check("sec.cert_expired", "certificates", "sec_expired_cert", "'critical'", "days_floor < 0", "cert_finding", detail="expiry_date"),
    Check("sec.cert_expiring", "certificates", "sec_expired_cert", "'warning'", "days_floor >= 0 and days_floor < 30", "cert_finding", detail="expiry_date"),
    Check("sec.weak_tls", "certificates", "sec_weak_tls", "'warning'", "weak_protocol", "concat('Weak TLS protocol detected: ', protocol)", detail="protocol"),
    Check("sec.security_txt", "well_known", "sec_missing_csp", "'info'", "path = '/.well-known/security.txt' and not coalesce(status = 200, false)", "'security.txt not found at /.well-known/security.txt'", detail="coalesce(cast(status as string), 'not found')"),
    Check("sec.exposure_notice", "exposure", "sec_missing_csp", "'warning'", "n > 0", "'Potential exposure observed, requires review'", "n", detail="array_join(types, ', ')"),
]
_POOR = "if({0}_number > {1}, 'critical', 'warning')".format
PERFORMANCE = [
    Check("perf.lcp", "lighthouse", "perf_poor_lcp", _POOR("lcp", 4000), "lcp_number > 2500", "concat('Largest Contentful Paint (LCP) is ', lcp_shown, ' (threshold: 2500ms)')"),
    Check("perf.cls", "lighthouse", "perf_poor_cls", _POOR("cls", 0.25), "cls_number > 0.1", "concat('Cumulative Layout Shift (CLS) is ', cls_shown, ' (threshold: 0.1)')"),
    Check("perf.tbt", "lighthouse", "perf_poor_fid", _POOR("tbt", 600), "tbt_number > 200", "concat('Total Blocking Time (TBT) is ', tbt_shown, ' (threshold: 200ms)')"),
    Check("perf.fcp", "lighthouse", "perf_slow_ttfb", "'info'", "fcp_number > 1800", "concat('First Contentful Paint (FCP) is ', fcp_shown)"),
    Check("perf.ttfb", "lighthouse", "perf_slow_ttfb", "'warning'", "ttfb_number > 800", "concat('Time to First Byte (TTFB) is ', ttfb_shown, ' (threshold: 800ms)')"),
    Check("perf.score", "lighthouse", "perf_large_html", "if(score < 50, 'critical', 'warning')", "score < 90", "concat('Performance score is ', score, '/100')"),
    Check("perf.opportunities", "lighthouse", "perf_unoptimized_images", "'warning'", "top_savings > 1000", "concat(size(savings), ' optimization opportunities identified (potential ', savings_kb, 'KB savings)')"),
    Check("perf.render_blocking", "lighthouse", "perf_render_blocking", "'warning'", "blocking > 0", "concat(blocking, ' render-blocking resources detected')"),
    Check("perf.images", "lighthouse", "perf_unoptimized_images", "'warning'", "size(image_issues) > 0", "concat('Image optimization issues: ', array_join(image_issues, ', '))"),
    Check("perf.bootup", "lighthouse", "perf_large_html", "'warning'", "bootup > 1000", "concat('High JavaScript bootup time (', bootup_s, 's)')"),
    Check("perf.mainthread", "lighthouse", "perf_large_html", "'warning'", "mainthread > 3000", "concat('Excessive main thread work (', mainthread_s, 's)')"),
    Check("perf.caching", "lighthouse", "perf_large_html", "'info'", "uncached > 0", "concat(uncached, ' static assets lack efficient cache policies')"),
]
AUDITS: dict[str, list[Check | PageCheck]] = {"crawl": CRAWL, "technical": TECHNICAL, "security": SECURITY, "performance": PERFORMANCE}
#: Checks by id, with their audit.
REGISTRY = {c.check_id: (audit, c) for audit, held in AUDITS.items() for c in held}


@dataclass(frozen=True)
class Input:
    """A table of facts: the collected tables it is made of, and how; ``brief``: how, where only the firing of rules matters."""

    tables: list[str] = field(default_factory=list)
    build: Callable[..., DataFrame] = lambda t: t
    brief: Callable[..., DataFrame] | None = None


INPUTS = {
    "pages": Input(["signals"]),
    "titles": Input(["signals"], lambda s: findings.duplicate_facts(s, "title", 60), lambda s: findings.duplicate_facts(s, "title", brief=True)),
    "descriptions": Input(["signals"], lambda s: findings.duplicate_facts(s, "meta_description", 100), lambda s: findings.duplicate_facts(s, "meta_description", brief=True)),
    "links": Input(["broken_links"], findings.broken_link_facts, lambda b: findings.broken_link_facts(b, brief=True)),
    "robots": Input(["robots"], lambda r: collected.robots_facts(collected.robots_blocking(r))),
    "crawl": Input(["sites", "sitemap_refs", "sitemap_urls", "chains", "urls"], lambda sites, refs, found, chains, urls: collectors.crawl_facts(refs, found, sites, chains, site_facts.host_rules(chains), collectors.parameterised_count(urls))),
    "headers": Input(["header_states"], site_facts.header_facts),
    "hosts": Input(["chains"], site_facts.host_rules),
    "certificates": Input(["certificates"]),
    "well_known": Input(["sites", "responses"], collectors.well_known),
    "exposure": Input(["private_flags"], site_facts.exposure_facts),
    "lighthouse": Input(["lighthouse"], collected.lighthouse_facts),
}


def checks_of(name: str) -> list[Check | PageCheck]:
    """The checks over an input."""
    return [c for _, c in REGISTRY.values() if (c.input if isinstance(c, Check) else "pages") == name]


def apply(name: str, facts: DataFrame, only: Iterable[str] | None = None, brief: bool = False) -> DataFrame:
    """run_id, site, check_id, type, severity, n, message, affected_urls, evidence of the rules over one input that fire: a single pass over its rows.
    ``brief``: the first five only."""
    wanted = [c for c in checks_of(name) if only is None or c.check_id in set(only)]
    if name == "pages":
        out = findings.run_page_checks(facts, [c.check_id for c in wanted], brief)
        return out.drop("n") if brief else out

    def row(c: Check) -> Column:
        e = F.expr
        if brief:
            return F.when(e(c.when), F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.type).alias("type"), e(c.severity).alias("severity")))
        basis = findings.evidence(e(c.count), e(c.samples), e(c.detail))
        held = F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.type).alias("type"), e(c.severity).alias("severity"), e(c.count).cast("long").alias("n"), e(c.message).alias("message"), e(c.urls).alias("affected_urls"), basis.alias("evidence"))
        return F.when(e(c.when), held)

    return facts.select(*KEY, F.explode(F.array_compact(F.array(*map(row, wanted)))).alias("f")).select(*KEY, "f.*")


def resolve(only: Iterable[str] | None = None) -> tuple[dict[str, list[str]], list[str]]:
    """Names of audits and of checks to the check ids asked for, by audit in order of emission, and the names that are neither."""
    names = list(AUDITS) if only is None else list(dict.fromkeys(only))
    ids = {c.check_id for n in names if n in AUDITS for c in AUDITS[n]} | (set(names) & set(REGISTRY))
    asked = {a: [c.check_id for c in held if c.check_id in ids] for a, held in AUDITS.items()}
    return {a: held for a, held in asked.items() if held}, [n for n in names if n not in AUDITS and n not in REGISTRY]


def compile(tables: Mapping[str, Callable[[], DataFrame]], only: Iterable[str] | None = None, brief: bool = False) -> dict[str, list[DataFrame]]:
    """Findings of the checks asked for, by audit: one table for each input that they need.  No other input is built, and no table that only others need is read.

    ``brief``: run_id, site, check_id, type, severity, all that scores and counts need: no URL lists, samples or messages are made.
    """
    read: dict[str, DataFrame] = {}

    def of(name: str) -> DataFrame:
        if name not in read:
            read[name] = tables[name]()
        return read[name]

    out: dict[str, list[DataFrame]] = {}
    for audit, ids in resolve(only)[0].items():
        for name in dict.fromkeys(REGISTRY[i][1].input if isinstance(REGISTRY[i][1], Check) else "pages" for i in ids):
            build = (INPUTS[name].brief if brief else None) or INPUTS[name].build
            out.setdefault(audit, []).append(apply(name, build(*map(of, INPUTS[name].tables)), ids, brief))
    return out


def technical(signals: DataFrame) -> DataFrame:
    """All findings from page signals."""
    out = apply("pages", signals)
    for name in ("titles", "descriptions"):
        out = out.unionByName(apply(name, INPUTS[name].build(signals)))
    return out
