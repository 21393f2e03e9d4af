"""Queries over sites: headers, redirects, certificates, DNS, coverage, URL set, exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import checks, page_signals, site_facts
from siteloom.plans.inputs import CTES, frame, with_inputs
from siteloom.plans.pages import SIGNALS, _path, _q

CTES["sites"] = "select 'r1' as run_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as site, min(page_id) as sid, count(*) as n from pages group by lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_S = f"({CTES['sites']}) s"
CTES["headers"] = f"""select run_id, site, sid, case when h = 1 then 'Strict-Transport-Security' when h = 2 then 'content-security-policy' when h = 3 then 'X-Frame-Options' when h = 4 then 'referrer-policy' else 'X-Content-Type-Options' end as name,
  case when h = 1 then case when sid % 2 = 0 then 'max-age=31536000; includeSubDomains; preload' else 'max-age=600' end
       when h = 2 then 'default-src self; img-src * data:; script-src a.example; IMG-SRC b.example' when h = 3 then case when sid % 9 = 4 then '' else 'DENY' end when h = 4 then 'no-referrer' else 'nosniff' end as value
  from {_S} cross join (select 1 as h union all select 2 union all select 3 union all select 4 union all select 5) k where (sid + h) % 3 <> 0"""
CTES["hops"] = f"""select run_id, site, variant, hop, case when hop = (sid + v) % 7 then concat(case when v <= 2 and sid % 5 <> 0 then 'https://' when v > 2 then 'https://' else 'http://' end, case when v % 2 = 0 and sid % 4 <> 1 then 'www.' else '' end, case when sid % 11 = 3 and v = 4 then 'other.example' else site end, case when sid % 6 = 2 then '/home/' else '/' end)
    else concat('http://', site, '/r', cast(case when sid % 8 = 1 then 0 else hop end as varchar(10))) end as url,
    case when hop = (sid + v) % 7 then 200 else 301 end as status
  from {_S} cross join (select 1 as v, 'httpRoot' as variant union all select 2, 'httpWww' union all select 3, 'httpsRoot' union all select 4, 'httpsWww') x
  cross join (select 0 as hop union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) y where hop <= (sid + v) % 7"""
CTES["tls"] = f"""select run_id, site, case sid % 4 when 0 then 'TLSv1.3' when 1 then 'TLSv1.1' when 2 then 'SSLv3' else 'TLSv1.2' end as protocol,
  case sid % 5 when 0 then '2024-01-20T12:00:00Z' when 1 then '2024-02-20T00:00:00Z' when 2 then '2025-06-01T00:00:00Z' when 3 then 'unknown' else '2024-03-02T00:00:00Z' end as expiry_date from {_S}"""
CTES["records"] = f"""select run_id, site, pos, case (sid + pos) % 6 when 0 then 'x.cloudfront.net' when 1 then concat('lb.', site, '.amazonaws.com') when 2 then '192.0.2.7' when 3 then 'd.fastly.net' when 4 then 'vm.hetzner.de' else site end as value,
  case sid % 3 when 0 then 'Let''s Encrypt' when 1 then 'Cloudflare Inc' else 'Other CA' end as issuer from {_S} cross join (select 0 as pos union all select 1 union all select 2) p where pos <= sid % 3""".replace("Let''s", "Lets")
CTES["urls"] = """select run_id, site, page_id as crawl_seq, case page_id % 12 when 0 then replace(url, '/en/', '/products/') when 1 then replace(url, '/de/', '/collections/') when 2 then replace(url, '/fr/', '/blog/') when 3 then replace(url, '/es/', '/2024/05/')
   when 4 then replace(url, '/en/', '/about') when 5 then replace(url, '/en/', '/category/') else url end as url, html from (select 'r1' as run_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as site, page_id, url, html from pages) p"""


def _states(spark, d):
    roots = frame(spark, d, "sites").join(frame(spark, d, "headers").groupBy("site").agg(F.collect_list(F.struct(F.col("name").alias("key"), "value")).alias("headers")), "site", "left")
    return site_facts.security_headers(roots)


def q_security_headers(spark, d):
    return _states(spark, d).select("site", "header", F.col("state.state").alias("state"), F.col("state.value").alias("value"))


def q_header_findings(spark, d):
    return checks.apply("headers", site_facts.header_facts(_states(spark, d))).select("site", "check_id", "type", "severity", "message")


def q_hsts(spark, d):
    return _states(spark, d).where("header = 'strict-transport-security' and state.state = 'present'").select("site", site_facts.hsts(F.col("state.value")).alias("h")).select("site", "h.*")


def q_csp_directives(spark, d):
    rows = _states(spark, d).where("header = 'content-security-policy' and state.state = 'present'")
    return rows.select("site", F.explode(site_facts.csp(F.col("state.value"))).alias("directive", "v")).select("site", "directive", F.array_join("v", " ").alias("sources"))


def _chains(spark, d):
    return site_facts.redirect_chains(frame(spark, d, "hops"))


def q_redirect_health(spark, d):
    return site_facts.redirect_health(_chains(spark, d)).drop("run_id")


def q_host_rules(spark, d):
    out = site_facts.host_rules(_chains(spark, d)).drop("run_id")
    return out.withColumnsRenamed({"httpRoot": "http_root", "httpsRoot": "https_root", "httpsWww": "https_www", "httpWww": "http_www"})


def q_cert_expiry(spark, d):
    return site_facts.certificates(frame(spark, d, "tls"), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).drop("run_id")


def q_infra_detect(spark, d):
    return site_facts.infrastructure(frame(spark, d, "records")).drop("run_id")


def q_coverage(spark, d):
    return site_facts.coverage(frame(spark, d, "fetches")).drop("run_id")


def q_fetch_errors(spark, d):
    return site_facts.error_histogram(frame(spark, d, "fetches")).drop("run_id")


def q_unknown_rates(spark, d):
    return site_facts.unknown_rates(page_signals.page_signals(frame(spark, d, "fetches"))).drop("run_id")


def q_url_templates(spark, d):
    return site_facts.url_templates(frame(spark, d, "urls")).drop("run_id").withColumn("sample_urls", F.array_join("sample_urls", "\n"))


def q_path_groups(spark, d):
    return site_facts.path_groups(frame(spark, d, "urls")).drop("run_id")


def q_param_histogram(spark, d):
    return site_facts.parameters(frame(spark, d, "urls")).drop("run_id")


def q_platform_hints(spark, d):
    pages = frame(spark, d, "fetches").drop("url").join(frame(spark, d, "urls").select("crawl_seq", "url"), "crawl_seq")
    return site_facts.platforms(pages).select("site", F.array_join("hints", ",").alias("hints"), "platform")


def q_exposure_flags(spark, d):
    return site_facts.private_flags(frame(spark, d, "fetches")).drop("run_id")


def q_exposure_notice(spark, d):
    facts = site_facts.exposure_facts(site_facts.private_flags(frame(spark, d, "fetches")))
    out = checks.apply("exposure", facts).select("site", "check_id", "type", "severity", "message", "n", F.replace("evidence.detail", F.lit(", "), F.lit(",")).alias("types"))
    return out


QUERIES = {
    k[2:]: v
    for k, v in dict(globals()).items()
    if k.startswith("q_")
}


def _sql(body, *names):
    return with_inputs(body, *names)


_STATES = f"states as (select s.run_id, s.site, x as header, case when h.has is null then 'unknown' when coalesce(v.value, '') <> '' then 'present' else 'absent' end as state, nullif(v.value, '') as value from sites s cross join (select unnest({site_facts.HEADERS}) as x) l left join (select distinct site, true as has from headers) h on h.site = s.site left join headers v on v.site = s.site and lower(v.name) = x)"
_MISSING = f"missing as (select site, list(header) as m from states where state <> 'present' and header in {tuple(site_facts.CHECKED)} group by site)"
_CH = """chains as (select site, variant, list(url order by hop) as c, arg_max(url, hop) as final_url from hops group by site, variant),
finals as (select site, max(final_url) filter (variant = 'httpRoot') as http_root, max(final_url) filter (variant = 'httpsRoot') as https_root, max(final_url) filter (variant = 'httpsWww') as https_www, max(final_url) filter (variant = 'httpWww') as http_www,
  bool_and(final_url like '%://www.%') as w, bool_and(final_url not like '%://www.%') as nw, bool_and(final_url like '%/home/') as sl, bool_and(final_url not like '%/home/') as ns,
  bool_or(variant in ('httpRoot', 'httpWww') and (final_url like 'https://%' or len(list_filter(c, lambda x: x like 'https://%')) > 0)) as secured, coalesce(max(len(c)) filter (variant in ('httpRoot', 'httpWww')), 0)::int as http_chain from chains group by site)"""
_h = lambda c: f"regexp_extract({c}, '^https?://([^/]*)', 1)"
_TPL = "case " + " ".join(f"when regexp_matches(p, {_q('(?i)' + r)}) then {{'type': '{t}', 'pattern': '{n}'}}" for r, t, n in site_facts.TEMPLATES) + " end"
_NAMED = lambda names: "case " + " ".join(f"when contains(lower(value), '{k}') then '{v}' end" if False else f"when contains(lower(value), '{k}') then '{v}'" for k, v in names.items()) + " end"
_FLAGS = r"""flags as (select * from (
  select site, 'exposed_sourcemaps' as category, 'data_quality' as type, 'medium' as severity, count(*) filter (regexp_matches(html, '(?i)sourceMappingURL\s*=\s*(\S+)') or len(list_filter(regexp_extract_all(html, '(?i)<script[^>]+src\s*=\s*["'']([^"'']+)["'']', 1), lambda x: x like '%.map' or contains(x, '.js.map'))) > 0) as n from fetches group by site
  union all select site, 'stack_traces_exposed', 'data_quality', 'high', count(*) filter (regexp_matches(html, '(?i)at\s+[\w.]+\s+\([^)]+:\d+:\d+\)|stack trace:|exception in thread|traceback\s*\(|in\s+`[^'']*''\s+at\s+')) from fetches group by site
  union all select site, 'exposed_secrets', 'confidence', 'high', count(*) filter (regexp_matches(html, 'AKIA[0-9A-Z]{16}|-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----') or regexp_matches(html, '(?i)["'']api[_-]?key["'']\s*[:=]\s*["''][a-zA-Z0-9]{20,}["'']|["'']bearer\s+[a-zA-Z0-9_\-.]{20,}["'']|basic\s+[a-zA-Z0-9]{20,}')) from fetches group by site
  union all select site, 'internal_hostnames_exposed', 'data_quality', 'medium', count(distinct h) from (select site, unnest(list_concat(regexp_extract_all(html, '(?i)https?://([a-z0-9-]+\.(?:internal|local|corp|private|intranet)[/\s"''])', 1), regexp_extract_all(html, 'https?://([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', 1))) as h from fetches) group by site) where n > 0)"""
_HINTS = ", ".join([
    "case when bool_or(regexp_matches(url, '/products/|/collections/')) then 'shopify:url-patterns' end", "case when bool_or(regexp_matches(url, '/wp-content/|/wp-json/|/category/|/tag/')) then 'wordpress:url-patterns' end",
    *(f"case when bool_or({' or '.join(f'contains(html, {_q(m)})' for m in ms)}) then '{n}' end" for n, ms in site_facts.SIGNATURES.items())])

ORACLE_SQL = {
    "security_headers": _sql(f"with {_STATES} select site, header, state, value from states", "sites", "headers"),
    "header_findings": _sql(f"""with {_STATES}, {_MISSING} select site, 'sec.hsts' as check_id, 'sec_missing_hsts' as type, 'critical' as severity, 'Missing Strict-Transport-Security (HSTS) header' as message from missing where list_contains(m, 'strict-transport-security')
      union all select site, 'sec.csp', 'sec_missing_csp', 'warning', 'Missing Content-Security-Policy header' from missing where list_contains(m, 'content-security-policy')
      union all select site, 'sec.xframe', 'sec_missing_xframe', 'warning', 'Missing X-Frame-Options header' from missing where list_contains(m, 'x-frame-options')
      union all select site, 'sec.other_headers', 'sec_missing_csp', 'info', concat(k, ' additional security headers missing') from (select site, len(list_filter(m, lambda x: x not in ('strict-transport-security', 'content-security-policy', 'x-frame-options'))) as k from missing) where k > 0""", "sites", "headers"),
    "hsts": _sql("select site, cast(regexp_extract(lower(value), 'max-age=([0-9]+)', 1) as bigint) as max_age, contains(lower(value), 'includesubdomains') as include_subdomains, contains(lower(value), 'preload') as preload from headers where name = 'Strict-Transport-Security'", "headers"),
    "csp_directives": _sql("""select site, directive, arg_max(sources, i) as sources from (select site, lower(split_part(t, ' ', 1)) as directive, case when contains(t, ' ') then regexp_replace(t, '^[^ ]* ', '') else '' end as sources, i from (
      select site, trim(unnest(string_split(value, ';'))) as t, generate_subscripts(string_split(value, ';'), 1) as i from headers where name = 'content-security-policy')) group by site, directive""", "headers"),
    "redirect_health": _sql(f"""with {_CH} select *, case when loops > 0 or max_chain > 5 then 'critical' when max_chain > 2 then 'warning' else 'healthy' end as health from (
      select site, max(len(c))::int as max_chain, sum(len(c) - len(list_distinct(c)))::bigint as loops, count(*) filter (len(c) > 3) as long_chains from chains group by site)""", "hops"),
    "host_rules": _sql(f"""with {_CH} select site, http_root, https_root, https_www, http_www, http_chain, coalesce(secured, false) as https_enforced, w or nw as www_consistent, case when w then 'www' when nw then 'non-www' end as www_preference,
      sl or ns as slash_consistent, case when sl then 'slash' when ns then 'no-slash' end as slash_preference, {_h('https_root')} <> {_h('https_www')} and {_h('https_root')} <> concat('www.', {_h('https_www')}) and {_h('https_www')} <> concat('www.', {_h('https_root')}) as host_conflict, http_root like 'http://%' as http_stays from finals""", "hops"),
    "cert_expiry": _sql("""select *, days_ceil > 0 as valid, case when days_floor < 0 then 'TLS certificate has expired' when days_floor < 30 then concat('TLS certificate expires in ', days_floor, ' days') end as cert_finding,
      regexp_matches(lower(protocol), 'ssl|tlsv1[.]0|tlsv1[.]1') as weak_protocol from (select site, protocol, expiry_date, ceil(l)::bigint as days_ceil, floor(l)::bigint as days_floor from (
      select *, (epoch_ms(try_cast(replace(replace(expiry_date, 'T', ' '), 'Z', '') as timestamp)) - epoch_ms(timestamp '2024-02-01 00:00:00')) / 86400000.0 as l from tls))""", "tls"),
    "infra_detect": _sql(f"""select site, coalesce(c, case when contains(i, 'cloudflare') then 'Cloudflare' end) as cdn, coalesce(h, case when contains(i, 'let') then 'Let''s Encrypt' end) as hosting from (
      select site, arg_max(c, pos) filter (c is not null) as c, arg_max(h, pos) filter (h is not null) as h, max(lower(issuer)) as i from (select *, {_NAMED(site_facts.CDNS)} as c, {_NAMED(site_facts.HOSTS)} as h from records) group by site)""", "records"),
    "coverage": _sql("""select *, fetched / attempted as fetch_rate, coalesce(parsed / nullif(fetched, 0), 0) as parse_rate from (select site, count(*) as attempted, count(*) filter (ok) as fetched, count(*) filter (ok and contains(html, '<html') and contains(html, '</html>')) as parsed,
      count(*) filter (status in (401, 403)) as blocked, count(*) filter (status >= 400) as errors, count(*) filter (status in (0, 408, 524)) as timeouts, count(*) filter (status = 429) as rate_limited, count(*) filter (length(html) > 2097152) as oversized,
      bool_or(regexp_matches(html, '(?i)(ng-app|data-reactroot|data-reactid|__next|__nuxt|__vue)') or (length(trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '<[^>]+>', '', 'g'))) < 100 and regexp_matches(html, '(?i)(loading|spinner|skeleton|please wait)'))) as script_suspected
      from (select *, status between 200 and 299 as ok from fetches) group by site)""", "fetches"),
    "fetch_errors": _sql("select site, status, count(*) as n from fetches where status = 0 or status >= 400 group by all", "fetches"),
    "unknown_rates": _sql(f"with {SIGNALS} select site, avg((title is null)::int) as title, avg((meta_description is null)::int) as description, avg((canonical is null)::int) as canonical, avg((len(ld_json) = 0)::int) as schema from signals group by site", "fetches"),
    "url_templates": _sql(f"""select site, t.pattern as pattern, t.type as type, count(*) as n, row_number() over (partition by site order by count(*) desc, min(crawl_seq), t.pattern)::int as rank, array_to_string((list(url order by crawl_seq, url))[1:5], chr(10)) as sample_urls
      from (select site, crawl_seq, url, {_TPL} as t from (select *, {_path('url')} as p from urls)) where t is not null group by site, t""", "urls"),
    "path_groups": _sql(f"select site, case when s = '' then '/' else concat('/', s, '/') end as prefix, count(*) as n, min(crawl_seq) as first_seen from (select *, regexp_extract({_path('url')}, '^/([^/]*)', 1) as s from urls) group by 1, 2", "urls"),
    "param_histogram": _sql(f"""select site, case when k in {tuple(site_facts.PARAMETERS)} then k else 'other' end as parameter, count(*) as n from (select site, lower(split_part(unnest(string_split(q, '&')), '=', 1)) as k from (
      select *, row_number() over (partition by site order by crawl_seq) as r2 from (select *, regexp_extract(url, '[?]([^#]*)', 1) as q, row_number() over (partition by site order by crawl_seq) as r from urls) where r <= 200 and q <> '') where r2 <= 50) where k <> '' group by 1, 2""", "urls"),
    "platform_hints": _sql(f"""select site, hints, case when contains(hints, 'shopify') then 'shopify' when contains(hints, 'woocommerce') or (contains(hints, 'wordpress') and contains(hints, 'ecommerce')) then 'woocommerce' when contains(hints, 'wordpress') then 'wordpress' when contains(hints, 'magento') then 'magento'
      when a and b then 'shopify' when w then 'wordpress' when contains(hints, 'ecommerce') or c then 'generic' end as platform from (select f.site, array_to_string(list_filter([{_HINTS.replace('url,', 'u.url,').replace('html,', 'f.html,')}], lambda x: x is not null), ',') as hints,
      bool_or(regexp_matches(u.url, '/products/[^/]+')) as a, bool_or(regexp_matches(u.url, '/collections/[^/]+')) as b, bool_or(contains(u.url, '/wp-content/')) as w, bool_or(regexp_matches(u.url, '/product/[^/]+')) as c
      from fetches f join urls u on f.crawl_seq = u.crawl_seq group by f.site)""", "fetches", "urls"),
    "exposure_flags": _sql(f"with {_FLAGS} select * from flags", "fetches"),
    "exposure_notice": _sql(f"with {_FLAGS} select site, 'sec.exposure_notice' as check_id, 'sec_missing_csp' as type, 'warning' as severity, 'Potential exposure observed, requires review' as message, count(*) as n, string_agg(distinct type, ',' order by type) as types from flags group by site", "fetches"),
}
