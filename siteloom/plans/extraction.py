"""Queries over extraction by choice: families of page signals, parts of a site's snapshot, infrastructure."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import collected, collectors, page_signals, site_facts, snapshot
from siteloom.plans.audit import AS_OF
from siteloom.plans.collected import _SM
from siteloom.plans.inputs import CTES, frame, with_inputs
from siteloom.plans.pages import SIGNALS, _q
from siteloom.plans.site import _CH, _NAMED, _STATES, _TPL, _path, _states
from siteloom.sources.tables import ascii_urls

#: Three choices of page families, and three of a snapshot's.
PAGE_CHOICES = {"head": ["title", "description", "flags"], "structure": ["canonical", "headings", "words"], "data": ["schema", "images", "mixed_content"]}
SITE_CHOICES = {"headers": ["security_headers"], "hosts": ["infra", "urlset"], "both": ["security_headers", "infra", "coverage"]}
_NAMES = {
    "head": ["title", "title_length", "meta_description", "meta_description_length", "has_viewport", "has_lang", "has_charset"],
    "structure": ["canonical", "canonical_self", "h1", "h1_count", "h2_count", "h3_count", "h4_count", "h5_count", "h6_count", "word_count"],
    "data": ["invalid_schema_count", "has_product_schema", "image_count", "images_without_alt", "mixed_content"],
}


def q_selected_signals(spark, d):
    """A row for each page, choice of families and signal."""
    out = None
    for choice, families in PAGE_CHOICES.items():
        rows = page_signals.extract(frame(spark, d, "fetches"), families)
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).cast("string").alias("value")) for n in _NAMES[choice])))
        rows = rows.select(F.lit(choice).alias("choice"), "site", "crawl_seq", cells.alias("c")).select("choice", "site", "crawl_seq", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _raw(spark, d) -> dict:
    """What is collected of the sites, each read when a family asks for it."""
    sitemap = lambda: collected.sitemap_urls(frame(spark, d, "sitemap_files"), collected.sitemap_refs(frame(spark, d, "robots")))
    headers = lambda: frame(spark, d, "headers").groupBy("site").agg(F.collect_list(F.struct(F.col("name").alias("key"), "value")).alias("headers"))
    return {
        "fetches": lambda: frame(spark, d, "fetches"), "roots": lambda: frame(spark, d, "sites").join(headers(), "site", "left"), "chains": lambda: site_facts.redirect_chains(frame(spark, d, "hop_variants")),
        "tls": lambda: collectors.tls_facts(frame(spark, d, "tls_rows")), "dns_records": lambda: frame(spark, d, "infra_records"), "lighthouse": lambda: frame(spark, d, "site_lighthouse"), "robots": lambda: frame(spark, d, "robots"),
        "sitemap_urls": sitemap,
    }


_TRI = ["https_enforced", "host_consistency", "www_preference"]


def q_selected_snapshot(spark, d):
    """The site's row for three choices of families; coverage is a part of its own and leaves the row alone."""
    out, moment = None, F.to_timestamp(F.lit(AS_OF))
    for choice, families in SITE_CHOICES.items():
        rows = snapshot.extract(_raw(spark, d), frame(spark, d, "sites"), [f for f in families if f != "coverage"], moment)["site_wide"]
        rows = rows.select(
            F.lit(choice).alias("choice"), "site", F.size("security_headers").alias("headers"), F.try_element_at("security_headers", F.lit("strict-transport-security"))["state"].alias("hsts"),
            *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in _TRI for f in ("state", "value", "reason")), "robots_valid", "sitemap_count", "total_urls", F.array_join("template_patterns", ",").alias("patterns"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def q_infra_states(spark, d):
    raw = _raw(spark, d)
    out = snapshot.infra(frame(spark, d, "sites"), raw["chains"](), raw["tls"](), raw["dns_records"](), F.to_timestamp(F.lit(AS_OF)))
    states = ["days_left", "valid", "sans_include_domain", "issuer", "protocol"]
    return out.select("site", "cdn", "hosting", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in states for f in ("state", "value", "reason")))


def q_certificate_states(spark, d):
    out = collectors.certificate_states(site_facts.certificates(collectors.tls_facts(frame(spark, d, "tls_rows")), F.to_timestamp(F.lit(AS_OF))))
    return out.select("site", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("days_left", "valid", "sans_include_domain", "issuer", "protocol") for f in ("state", "value", "reason")))


def q_ascii_hosts(spark, d):
    """International hosts in ASCII: of the URL itself, in its normal form and in links from it."""
    rows = ascii_urls(frame(spark, d, "foreign_urls").withColumn("typed", F.col("url")))
    return rows.select("page_id", "url", urls.normalise(F.col("typed")).alias("normal"), urls.resolve(F.col("url"), F.col("href")).alias("link"))


#: Hosts of several scripts, and what they are in ASCII (samples of the encoding's standard among them).
_HOSTS = {"Bücher.example": "xn--bcher-kva.example", "münchen.de:8080": "xn--mnchen-3ya.de:8080", "例え.テスト": "xn--r8jz45g.xn--zckzah", "почемужеонинеговорятпорусски.example": "xn--b1abfaaepdrnnbgefbadotcwatmq2g4l.example", "Plain.Example": "plain.example", "www.españa。example": "www.xn--espaa-rta.example"}
_pick = lambda names: " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
CTES["foreign_urls"] = f"select page_id, concat('https://', case page_id % 6 {_pick(_HOSTS)} end, '/p', cast(page_id as varchar(20))) as url, case page_id % 4 when 0 then '//правда.example/x' when 1 then 'HTTP://Faß.example/y?q' when 2 then '/local' else 'mailto:a@b' end as href from pages"
_S = f"({CTES['sites']}) s"
CTES["infra_records"] = f"""select run_id, site, case when (sid + pos) % 4 = 0 then 'A' when (sid + pos) % 4 = 3 then 'AAAA' else 'CNAME' end as rtype, pos,
  case (sid + 2 * pos) % 6 when 0 then 'x.CloudFront.net' when 1 then concat('lb.', site, '.amazonaws.com') when 2 then '192.0.2.7' when 3 then 'd.fastly.net' when 4 then 'vm.hetzner.de' else site end as value
  from {_S} cross join (select 0 as pos union all select 1 union all select 2) p where pos <= sid % 3"""

QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_")}

# ---- the same in DuckDB -------------------------------------------------------------------

_IMAGES = f"""pictured as (
  select site, crawl_seq, len(list_filter(tags, lambda t: {{src}} <> '')) as image_count, len(list_filter(tags, lambda t: {{src}} <> '' and {{alt}} = '')) as images_without_alt
  from (select site, crawl_seq, regexp_extract_all(html, '(?i)<img[^>]*>') as tags from fetches))""".format(
    src=f"regexp_extract(t, {_q('(?i)src=[\"' + chr(39) + ']([^\"' + chr(39) + ']*)[\"' + chr(39) + ']')}, 1)", alt=f"regexp_extract(t, {_q('(?i)alt=[\"' + chr(39) + ']([^\"' + chr(39) + ']*)[\"' + chr(39) + ']')}, 1)"
)


def _long(choice: str, source: str) -> str:
    return "\nunion all ".join(f"select '{choice}' as choice, site, crawl_seq, '{n}' as signal, {n}::varchar as value from {source}" for n in _NAMES[choice])


_CERTIFICATES = """names as (
  select *, case when subject_cn is not null and not list_contains(found, subject_cn) then list_concat([subject_cn], found) else found end as sans
  from (select *, coalesce(issuer_o, issuer_cn, 'unknown') as cert_issuer, regexp_extract_all(coalesce(san, ''), 'DNS:([^, ]+)', 1) as found from tls_rows)),
certs as (
  select *, ceil((epoch_ms(try_cast(replace(replace(expiry_date, 'T', ' '), 'Z', '') as timestamp)) - epoch_ms(timestamp '2024-02-01 00:00:00')) / 86400000.0)::bigint as left_
  from names),
certified as (
  select site,
    case when left_ is null then 'unknown' else 'present' end as days_left_state, left_::varchar as days_left_value, case when left_ is null then 'No expiry date' end as days_left_reason,
    case when left_ is null then 'unknown' else 'present' end as valid_state, (left_ > 0)::varchar as valid_value, case when left_ is null then 'Cannot determine validity' end as valid_reason,
    case when len(sans) > 0 then 'present' else 'unknown' end as sans_include_domain_state, case when len(sans) > 0 then 'true' end as sans_include_domain_value, case when len(sans) = 0 then 'No SANs data' end as sans_include_domain_reason,
    'present' as issuer_state, cert_issuer as issuer_value, null::varchar as issuer_reason, 'present' as protocol_state, protocol as protocol_value, null::varchar as protocol_reason
  from certs)"""
_PROVIDERS = f"""provided as (
  select site, arg_max(c, place) filter (c is not null) as c, arg_max(h, place) filter (h is not null) as h
  from (select site, {_NAMED(site_facts.CDNS)} as c, {_NAMED(site_facts.HOSTS)} as h, {{'late': (rtype = 'A')::int, 'pos': pos}} as place from infra_records where rtype <> 'AAAA') group by site)"""
_TOLD = """told as (
  select s.site,
    case when w is null then 'unknown' else 'present' end as known, coalesce(secured, false) as secured, w, nw
  from sites s left join finals f on f.site = s.site)"""
_WIDE = f"""{_SM}, {_STATES}, {_CH.replace('from hops', 'from hop_variants')}, {_TOLD},
headed as (select site, count(*) as n, max(state) filter (header = 'strict-transport-security') as hsts from states group by site),
robotted as (select site, bool_or(status = 200 and length(body) > 0) as ok from robots group by site),
listed as (select site, 1 as n from sitemap_urls group by site),
united as (select site, url, min({{'src': src, 'seq': seq}}) as seen from (select site, url, 0 as src, crawl_seq as seq from fetches union all select site, url, 1, seq from sitemap_urls) group by site, url),
counted as (select site, count(*) as n from united group by site),
templated as (
  select site, string_agg(pattern, ',' order by r) as patterns
  from (select site, t.pattern as pattern, row_number() over (partition by site order by count(*) desc, min(seen), t.pattern) as r from (select *, {_TPL} as t from (select *, {_path('url')} as p from united)) where t is not null group by site, t) group by site),
rows_ as (
  select s.site, coalesce(r.ok, false) as robots_valid, coalesce(l.n, 0) as sitemap_count, h.n as headers, h.hsts, c.n as total_urls, coalesce(p.patterns, '') as patterns, t.*  exclude (site)
  from sites s left join robotted r on r.site = s.site left join listed l on l.site = s.site left join headed h on h.site = s.site left join counted c on c.site = s.site left join templated p on p.site = s.site join told t on t.site = s.site)"""


def _wide(choice: str) -> str:
    """A choice's rows of the snapshot query."""
    headers, hosts, urls = ("security_headers" in SITE_CHOICES[choice], "infra" in SITE_CHOICES[choice], "urlset" in SITE_CHOICES[choice])
    state = "known" if hosts else "'unknown'"
    reason = "case when known = 'unknown' then 'No redirect data' end" if hosts else "'Not extracted'"
    value = lambda e: f"case when known = 'present' then {e} end" if hosts else "null::varchar"
    mixed = "w is not null and not w and not nw"
    preferred = ("case when known = 'unknown' or " + mixed + " then 'unknown' else 'present' end", "case when w then 'www' when nw then 'non-www' end", f"case when known = 'unknown' then 'No redirect data' when {mixed} then 'Inconsistent www usage' end") if hosts else ("'unknown'", "null::varchar", "'Not extracted'")
    return f"""select '{choice}' as choice, site, {'headers' if headers else '0'}::int as headers, {'hsts' if headers else 'null'}::varchar as hsts,
      {state} as https_enforced_state, {value('secured::varchar')} as https_enforced_value, {reason} as https_enforced_reason,
      {state} as host_consistency_state, {value('(w or nw)::varchar')} as host_consistency_value, {reason} as host_consistency_reason,
      {preferred[0]} as www_preference_state, {preferred[1]} as www_preference_value, {preferred[2]} as www_preference_reason,
      robots_valid, sitemap_count::int as sitemap_count, {'total_urls' if urls else '0'}::bigint as total_urls, {'patterns' if urls else "''"} as patterns
    from rows_"""


ORACLE_SQL = {
    "selected_signals": with_inputs(
        f"with {SIGNALS}, {_IMAGES}, data as (select * from signals join pictured using (site, crawl_seq)) {_long('head', 'signals')} union all {_long('structure', 'signals')} union all {_long('data', 'data')}", "fetches"
    ),
    "selected_snapshot": with_inputs(f"{_WIDE} " + " union all ".join(map(_wide, SITE_CHOICES)), "robots", "sitemap_files", "sites", "headers", "hop_variants", "fetches"),
    "infra_states": with_inputs(
        f"""with {_CERTIFICATES}, {_PROVIDERS}, issued as (select site, lower(cert_issuer) as i from names)
        select s.site, coalesce(p.c, case when contains(i, 'cloudflare') then 'Cloudflare' end) as cdn, coalesce(p.h, case when contains(i, 'let') then 'Let''s Encrypt' end) as hosting, c.* exclude (site)
        from sites s left join provided p on p.site = s.site left join issued i on i.site = s.site left join certified c on c.site = s.site""",
        "sites", "tls_rows", "infra_records",
    ),
    "ascii_hosts": with_inputs(
        f"""select page_id, case when page_id % 6 = 4 then url else concat('https://', h, '/p', page_id) end as url, concat('https://', h, '/p', page_id) as normal,
          case page_id % 4 when 0 then 'https://xn--80aafi6cg.example/x' when 1 then 'http://xn--fa-hia.example/y?q' when 2 then concat('https://', h, '/local') end as link
        from (select *, case page_id % 6 {_pick(_HOSTS.values())} end as h from foreign_urls)""",
        "foreign_urls",
    ),
    "certificate_states": with_inputs(f"with {_CERTIFICATES} select * from certified", "tls_rows"),
}
