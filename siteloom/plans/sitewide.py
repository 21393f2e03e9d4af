"""Queries over a site as a whole: what a run covered, and the site's row from all datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import audit, collected, collectors, site_facts, site_row
from siteloom.plans.audit import _INPUTS, _SITE_MAP, _SMERR, AS_OF, MERGED, _counted, _tables
from siteloom.plans.extraction import _CERTIFICATES
from siteloom.plans.inputs import CTES, frame, with_inputs
from siteloom.plans.site import ORACLE_SQL as SITES
from siteloom.sources.scratch import keep

_S = f"({CTES['sites']}) s"
CTES["tls_checks"] = f"select run_id, site, case when sid % 6 = 1 then 'handshake failed' end as error from {_S} where sid % 8 <> 3"


def _sampled(spark, d):
    """The sampled pages with what coverage asks of each."""
    limited = frame(spark, d, "page_headers").where((F.lower("name").isin("retry-after", "x-ratelimit-limit")) & (F.coalesce("value", F.lit("")) != "")).select("crawl_seq", F.lit(True).alias("limited")).distinct()
    html = F.coalesce("html", F.lit(""))
    return audit.sampled(frame(spark, d, "fetches")).join(limited, "crawl_seq", "left").select(
        "run_id", "site", "crawl_seq", "url", "status", (html.contains("<html") & html.contains("</html>")).alias("parsed"), (F.length(html) > site_facts.MAX_HTML).alias("oversized"), site_facts.needs_script(html).alias("by_script"),
        ((F.col("status") == 429) | F.col("limited").isNotNull()).alias("rate_limited"),
    )


def _flags(spark, d):
    dns = collectors.dns_facts(frame(spark, d, "dns"))
    return audit.coverage_flags(frame(spark, d, "sites"), frame(spark, d, "dataset_rows"), dns, frame(spark, d, "tls_checks"), frame(spark, d, "site_results"), frame(spark, d, "shots"))


def q_coverage_flags(spark, d):
    return _flags(spark, d).drop("run_id")


def q_coverage_report(spark, d):
    t = _tables(spark, d)
    found = t["sitemap_urls"]()
    out = audit.coverage_report(_sampled(spark, d), _flags(spark, d), collected.sitemap_errors(t["walk"]()), found, audit.sampling_plan(found))
    lists = ["blocked_urls", "fetch_errors", "timeout_urls", "oversized_urls", "limitations", "warnings"]
    histogram = F.array_join(F.transform(F.array_sort(F.map_entries("error_breakdown")), lambda e: F.concat(e["key"], F.lit(" x"), e["value"].cast("string"))), "\n")
    return out.drop("run_id", "sitemap_errors").withColumns({**{c: F.array_join(c, "\n") for c in lists}, "error_breakdown": histogram})


def _datasets(spark, d) -> dict:
    """The tables of a site's row; what takes a long way to make is written first."""
    t = _tables(spark, d, whole=True)
    counted = keep(_counted(spark, d, t)[0], "counted-findings")
    found = t["sitemap_urls"]()
    fetches = frame(spark, d, "fetches")
    certificates = site_facts.certificates(collectors.tls_facts(frame(spark, d, "tls_rows")), F.to_timestamp(F.lit(AS_OF)))
    links = t["links"]().select("run_id", "site", "link_url", "internal").distinct()
    return {
        "header_states": t["header_states"](), "hops": frame(spark, d, "hops"), "robots": frame(spark, d, "robots"), "sitemap_urls": found, "sitemap_errors": keep(collected.sitemap_errors(t["walk"]()), "sitemap-errors"),
        "plan": keep(audit.sampling_plan(found), "plan"), "pages": keep(audit.sampled(fetches).select("run_id", "site", "crawl_seq", "url", "status"), "sampled-pages"),
        "signals": t["signals"](), "links": keep(links, "distinct-links"), "url_set": keep(site_facts.url_set(fetches, found), "url-set"),
        "templates": keep(site_facts.url_templates(frame(spark, d, "urls")), "templates"), "certificates": certificates, "dns": frame(spark, d, "dns"), "well_known": frame(spark, d, "responses"),
        "lighthouse": collected.ratings(collected.lighthouse(frame(spark, d, "site_lighthouse"))), "screenshots": frame(spark, d, "shots"), "serp_results": frame(spark, d, "site_results"),
        "dataset_states": keep(audit.datasets(frame(spark, d, "dataset_rows")), "dataset-states"), "findings": counted,
    }


def q_site_rows(spark, d):
    out = site_row.site_rows(frame(spark, d, "sites"), _datasets(spark, d)).drop("run_id")
    return out.withColumns({"patterns": F.array_join("patterns", ","), "notes": F.array_join("notes", "\n"), "confidence": F.round("confidence", 6)})


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_")}

# ---- the same in DuckDB -------------------------------------------------------------------

_BY_SCRIPT = r"""regexp_matches(html, '(?i)(ng-app|data-reactroot|data-reactid|__next|__nuxt|__vue)')
    or (length(trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '<[^>]+>', '', 'g'))) < 100 and regexp_matches(html, '(?i)(loading|spinner|skeleton|please wait)'))"""
_join = lambda e, w: f"coalesce(string_agg({e}, chr(10) order by crawl_seq) filter ({w}), '')"
_SAMPLED = "sampled as (select * from (select *, row_number() over (partition by site order by crawl_seq) as r from fetches) where r <= 50)"
_FLAGS = """flags as (
  select s.site,
    exists (select 1 from dataset_rows r where r.site = s.site and dataset = 'sitemaps' and data is not null) as sitemaps,
    exists (select 1 from dns r where r.site = s.site and rtype = 'A') as dns_resolved,
    exists (select 1 from tls_checks r where r.site = s.site and error is null) as tls_verified,
    exists (select 1 from dataset_rows r where r.site = s.site and dataset = 'lighthouse' and data is not null) as lighthouse_run,
    exists (select 1 from shots r where r.site = s.site and (desktop is not null or mobile is not null)) as screenshots_captured,
    exists (select 1 from site_results r where r.site = s.site) as serp_checked,
    exists (select 1 from dataset_rows r where r.site = s.site and dataset = 'scan' and data is not null) as scan_run
  from sites s)"""
_PLAN = f"planned as (select site, count(*) as n from {_SITE_MAP} where seq <= 50 group by site)"
_LISTED = f"smerr as (select site, string_agg(message, ', ' order by message) as m, count(*) as n from ({_SMERR}) group by site), smn as (select site, count(*) as n from {_SITE_MAP} group by site)"
_SMALL = "list_filter([{}], lambda x: x is not null)"
_LIMITS = _SMALL.format(
    "case when n_blocked > 0 then concat(n_blocked, ' pages blocked by robots.txt') end, case when not f.sitemaps then 'No sitemap found' end, "
    "case when f.sitemaps and coalesce(e.n, 0) > 0 then concat('Sitemap errors: ', e.m) end, case when f.sitemaps and coalesce(n.n, 0) = 0 then 'Sitemap is empty' end, "
    "case when rate_limiting then 'Rate limiting detected during crawl' end, case when not f.lighthouse_run then 'Lighthouse performance audit failed' end"
)
_WARN = _SMALL.format(
    "case when script_suspected then 'JavaScript rendering may be required for complete content' end, case when n_late > 0 then concat(n_late, ' URLs timed out during fetch') end, case when n_large > 0 then concat(n_large, ' pages exceeded size limit') end"
)
_COVERED = f"""{_SAMPLED}, {_FLAGS}, {_PLAN}, {_LISTED},
cov as (
  select site, count(*) filter (status between 200 and 299) as pages_sampled, count(*) filter (status between 200 and 299 and contains(html, '<html') and contains(html, '</html>')) as pages_parsed,
    {_join('url', 'status in (401, 403)')} as blocked_urls, {_join("concat(url, ': HTTP ', status)", 'status >= 400')} as fetch_errors, {_join('url', 'status in (0, 408, 524)')} as timeout_urls,
    {_join('url', 'length(html) > 2097152')} as oversized_urls, bool_or({_BY_SCRIPT}) as script_suspected, bool_or(status = 429 or crawl_seq in (select crawl_seq from page_headers where value <> '')) as rate_limiting,
    count(*) filter (status in (401, 403)) as n_blocked, count(*) filter (status in (0, 408, 524)) as n_late, count(*) filter (length(html) > 2097152) as n_large
  from sampled group by site),
kinds as (select site, string_agg(concat('HTTP ', status, ' x', n), chr(10) order by status) as error_breakdown from (select site, status, count(*) as n from sampled where status >= 400 group by all) group by site)
select c.site, pages_sampled, pages_parsed, coalesce(p.n, 0)::bigint as pages_total, blocked_urls, fetch_errors, timeout_urls, oversized_urls, script_suspected, rate_limiting, f.* exclude (site), coalesce(n.n, 0) as sitemap_urls,
  coalesce(k.error_breakdown, '') as error_breakdown, array_to_string({_LIMITS}, chr(10)) as limitations, array_to_string({_WARN}, chr(10)) as warnings,
  case when f.sitemaps and coalesce(n.n, 0) > 0 then 1 else 0 end as sitemaps_processed, case when f.sitemaps then coalesce(e.n, 0) else 0 end::int as sitemaps_failed,
  coalesce(pages_sampled / nullif(p.n, 0), 0) as coverage_rate, coalesce(pages_parsed / nullif(pages_sampled, 0), 0) as parse_rate
from cov c join flags f on f.site = c.site left join smerr e on e.site = c.site left join smn n on n.site = c.site left join planned p on p.site = c.site left join kinds k on k.site = c.site"""
_COVIN = ("fetches", "page_headers", "dataset_rows", "dns", "sites", "tls_checks", "shots", "site_results", "robots", "sitemap_files")

_IMG_SRC = r"""(?i)src=["'']([^"'']*)["'']"""
_IMG_ALT = r"""(?i)alt=["'']([^"'']*)["'']"""
_TLS = _CERTIFICATES.replace("certs", "tls_certs")  # the findings have a table of that name
_SITE_ROWS = f"""with {MERGED}, {_TLS}, {_SAMPLED}, {_PLAN}, {_LISTED},
heads as (
  select site, max(state) filter (header = 'strict-transport-security') as hsts, max(state) filter (header = 'content-security-policy') as csp, max(state) filter (header = 'x-frame-options') as xframe,
    count(*) filter (state = 'present') as headers_present from states group by site),
pg as (
  select site, count(*) filter (status between 200 and 299) as pages_sampled, count(*) filter (status in (401, 403)) as robots_blocking_count, count(*) filter (status >= 400) as fetch_errors,
    count(*) filter (status in (0, 408, 524)) as timeouts from sampled group by site),
im as (
  select site, sum(len(list_filter(t, lambda x: regexp_extract(x, '{_IMG_SRC}', 1) <> '')))::bigint as images,
    sum(len(list_filter(t, lambda x: regexp_extract(x, '{_IMG_SRC}', 1) <> '' and regexp_extract(x, '{_IMG_ALT}', 1) = '')))::bigint as images_without_alt
  from (select site, regexp_extract_all(html, '(?i)<img[^>]*>') as t from fetches) group by site),
sg as (select site, bool_or(mixed_content) as mixed, count(*) filter (has_product_schema) as product_pages, sum(invalid_schema_count)::bigint as invalid_schema from signals group by site),
lk as (select site, count(*) filter (internal) as internal_links, count(*) filter (not internal) as external_links from (select distinct site, link_url, internal from links) group by site),
un as (select site, count(distinct url) as total_urls from (select site, url from fetches union all select site, url from {_SITE_MAP}) group by site),
tp as (select site, string_agg(pattern, ',' order by rank) as patterns, arg_min(pattern, rank) as first_template from ({SITES['url_templates']}) group by site),
ct as (select site, max(protocol) as tls_protocol, max(cert_issuer) as cert_issuer, max(left_) as cert_days_left, bool_or(len(sans) > 0) as cert_names from tls_certs group by site),
dn as (select site, bool_or(rtype = 'A') as dns_resolved, bool_or(rtype = 'AAAA') as has_ipv6 from dns group by site),
lt as (
  select site, floor(try_cast(json_extract_string(f, '$.categories.performance.score') as double) * 100 + 0.5)::int as performance_score,
    try_cast(json_extract_string(f, '$.audits."largest-contentful-paint".numericValue') as double) as lcp, try_cast(json_extract_string(f, '$.audits."cumulative-layout-shift".numericValue') as double) as cls,
    coalesce(try_cast(json_extract_string(f, '$.audits."total-blocking-time".numericValue') as double), try_cast(regexp_extract(json_extract_string(f, '$.audits."total-blocking-time".displayValue'), '[0-9.]+') as double)) as tbt
  from (select site, case when json_valid(full_json) then full_json end as f from site_lighthouse)),
lt1 as (select site, max(performance_score) as performance_score, max(lcp) as lcp, max(cls) as cls, max(tbt) as tbt from lt group by site),
ds as (
  select s.site, avg((r.data is not null and r.error is null)::int) as share
  from (select distinct site from dataset_rows) s cross join (select unnest({audit.DATASETS}) as d) k left join dataset_rows r on r.site = s.site and r.dataset = k.d group by s.site),
fc as (select site, count(*) as n from merged group by site),
figures as (
  select s.site, hsts, csp, xframe, coalesce(headers_present, 0) as headers_present, fi.w, fi.nw, case when fi.site is not null then coalesce(secured, false) end as https_enforced,
    coalesce(r.status = 200 and length(r.body) > 0, false) as robots_valid, coalesce(n.n, 0) as sitemap_urls, coalesce(e.n, 0) as sitemaps_failed, coalesce(p.n, 0)::bigint as pages_total,
    coalesce(pages_sampled, 0) as pages_sampled, coalesce(robots_blocking_count, 0) as robots_blocking_count, coalesce(fetch_errors, 0) as fetch_errors, coalesce(timeouts, 0) as timeouts,
    coalesce(mixed, false) as mixed, coalesce(product_pages, 0) as product_pages, coalesce(invalid_schema, 0) as invalid_schema, coalesce(images, 0) as images, coalesce(images_without_alt, 0) as images_without_alt,
    coalesce(internal_links, 0) as internal_links, coalesce(external_links, 0) as external_links, coalesce(total_urls, 0) as total_urls, coalesce(patterns, '') as patterns, first_template,
    tls_protocol, cert_issuer, cert_days_left, cert_names, coalesce(dns_resolved, false) as dns_resolved, coalesce(has_ipv6, false) as has_ipv6,
    exists (select 1 from responses x where x.site = s.site and x.path = '/.well-known/security.txt' and x.status = 200) as security_txt, performance_score, lcp, cls, tbt,
    exists (select 1 from shots x where x.site = s.site and (desktop is not null or mobile is not null)) as screenshots_captured, (select count(*) from site_results x where x.site = s.site) as serp_results,
    ds.share, coalesce(fc.n, 0) as findings
  from sites s left join heads h on h.site = s.site left join finals fi on fi.site = s.site left join robots r on r.site = s.site left join smn n on n.site = s.site left join smerr e on e.site = s.site
    left join planned p on p.site = s.site left join pg on pg.site = s.site left join sg on sg.site = s.site left join im on im.site = s.site left join lk on lk.site = s.site left join un on un.site = s.site left join tp on tp.site = s.site
    left join ct on ct.site = s.site left join dn on dn.site = s.site left join lt1 on lt1.site = s.site left join ds on ds.site = s.site left join fc on fc.site = s.site)
select * exclude (w, nw, share), w or nw as www_consistent, case when w then 'www' when nw then 'non-www' end as www_preference,
  greatest(0, 100 - case when https_enforced then 0 else 30 end - 10 * ((hsts = 'absent')::int + (csp = 'absent')::int + (xframe = 'absent')::int) - case when mixed then 20 else 0 end)::int as security_score,
  sitemap_urls > 0 as has_sitemap, case when sitemap_urls > 0 then 1 else 0 end as sitemaps_processed, case when share >= 0.8 then 'high' when share >= 0.5 then 'medium' when share is not null then 'low' end as quality,
  round(greatest(0.0::double, least(1.0::double, 1.0::double - case when pages_sampled < pages_total then 0.1::double else 0 end - case when fetch_errors > 0 then 0.1::double * least(fetch_errors / 10.0::double, 0.3::double) else 0 end
    - case when findings > 50 then 0.1::double else 0 end)), 6) as confidence,
  array_to_string(list_filter([case when pages_sampled < pages_total then concat('Sampled ', pages_sampled, ' of ', pages_total, ' pages') end, case when fetch_errors > 0 then concat(fetch_errors, ' URLs failed to fetch') end,
    case when findings > 30 then 'High finding count - verify data quality' end], lambda x: x is not null), chr(10)) as notes
from figures"""

ORACLE_SQL = {
    "coverage_flags": with_inputs(f"with {_FLAGS} select * from flags", "sites", "dataset_rows", "dns", "tls_checks", "shots", "site_results"),
    "coverage_report": with_inputs(f"with {_COVERED}", *_COVIN),
    "site_rows": with_inputs(_SITE_ROWS, *_INPUTS, "tls_rows", "dns", "site_lighthouse", "shots", "site_results", "dataset_rows"),
}
