"""Queries over pages: signals, technical findings, scores, links, images, JSON-LD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import SPACES, WS
from siteloom.operators import checks, findings, images, jsonld, link_graph, page_signals
from siteloom.plans.inputs import frame, with_inputs
from siteloom.sources.scratch import keep


def _signals(spark, d) -> DataFrame:
    return page_signals.page_signals(frame(spark, d, "fetches"))


def _kept(spark, d, images: bool = False):
    """What the checks read of each page, written once; with ``images`` also how many images it has."""
    families = ["title", "description", "canonical", "headings", "schema", "mixed_content", "flags", *(["images"] if images else [])]
    columns = dict.fromkeys([*findings.READ, *(["has_product_schema", "image_count", "images_without_alt"] if images else [])])
    return keep(page_signals.extract(frame(spark, d, "fetches"), families).select(*columns), "page-signals")


def _pages(spark, d) -> DataFrame:
    return frame(spark, d, "fetches").select("run_id", "site", "crawl_seq", "url", "status")


def _links(spark, d) -> DataFrame:
    return page_signals.page_links(frame(spark, d, "fetches"))


def _targets(spark, d) -> DataFrame:
    """Links without their texts, for those who ask where they lead."""
    return page_signals.page_links(frame(spark, d, "fetches"), texts=False)


def _kept_links(spark, d) -> DataFrame:
    return keep(_targets(spark, d), "page-links")


def q_page_signals(spark, d):
    s = _signals(spark, d)
    sizes = [F.size(f"headings.h{k}").alias(f"h{k}_count") for k in range(2, 7)]
    return s.select("site", "crawl_seq", "url", "title", "title_length", "meta_description", "meta_description_length", "meta_robots", "canonical", "canonical_self",
                    "h1", "h1_count", *sizes, F.size("ld_json").alias("ld_json_blocks"), "mixed_content", "has_viewport", "has_lang", "has_charset", "word_count")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("site", "check_id", "type", "severity", "n", "message", F.array_join("affected_urls", "\n").alias("urls"), *flat_evidence())


def flat_evidence():
    shown = F.transform("evidence.samples", lambda x: F.concat(F.coalesce(x["url"], F.lit("")), F.lit("|"), F.coalesce(x["value"], F.lit(""))))
    return [F.col("evidence.affected_count").alias("affected_count"), F.array_join(shown, "\n").alias("samples"), F.col("evidence.detail").alias("detail")]


GROUPS = {
    "title_findings": ["tech.missing_title", "tech.title_long", "tech.title_short"],
    "desc_findings": ["tech.missing_desc", "tech.desc_long"],
    "heading_findings": ["tech.missing_h1", "tech.multiple_h1", "tech.heading_hierarchy"],
    "canonical_findings": ["tech.missing_canonical", "tech.canonical_mismatch"],
    "meta_findings": ["tech.viewport", "tech.charset", "tech.lang", "tech.mixed_content"],
    "schema_findings": ["tech.product_schema", "tech.schema_invalid"],
}


def _group(name):
    return lambda spark, d: _flat(findings.run_page_checks(_kept(spark, d), GROUPS[name]))


def q_duplicate_findings(spark, d):
    s = _kept(spark, d)
    titles, descriptions = (checks.apply(name, checks.INPUTS[name].build(s)) for name in ("titles", "descriptions"))
    return _flat(titles.unionByName(descriptions))


def q_page_links(spark, d):
    return _links(spark, d).drop("run_id")


def q_link_graph(spark, d):
    return link_graph.edges(_targets(spark, d)).drop("run_id")


def q_broken_links(spark, d):
    return link_graph.broken_fan_in(link_graph.broken_links(_targets(spark, d), _pages(spark, d))).drop("run_id")


def q_broken_link_findings(spark, d):
    return _flat(checks.apply("links", findings.broken_link_facts(keep(link_graph.broken_links(_targets(spark, d), _pages(spark, d)), "broken-links"))))


def q_orphan_pages(spark, d):
    return link_graph.orphans(_kept_links(spark, d), _pages(spark, d)).drop("run_id")


def q_uncrawled_targets(spark, d):
    return link_graph.uncrawled_targets(_targets(spark, d), _pages(spark, d)).drop("run_id")


def q_link_summary(spark, d):
    return link_graph.summary(_kept_links(spark, d), _pages(spark, d)).drop("run_id")


def q_image_inventory(spark, d):
    return images.inventory(frame(spark, d, "fetches")).drop("run_id", "url")


def q_image_summary(spark, d):
    return images.summary(images.inventory(frame(spark, d, "fetches"))).drop("run_id")


def q_jsonld_types(spark, d):
    return jsonld.all_types(page_signals.page_signals(frame(spark, d, "fetches"))).groupBy("site", "schema_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("crawl_seq").alias("pages"))


def q_schema_summary(spark, d):
    out = jsonld.summary(page_signals.page_signals(frame(spark, d, "fetches")))
    return out.drop("run_id").withColumn("types", F.array_join("types", ","))


QUERIES = {
    "page_signals": q_page_signals, **{n: _group(n) for n in GROUPS}, "duplicate_findings": q_duplicate_findings, "page_links": q_page_links, "link_graph": q_link_graph, "broken_links": q_broken_links,
    "broken_link_findings": q_broken_link_findings, "orphan_pages": q_orphan_pages, "uncrawled_targets": q_uncrawled_targets, "link_summary": q_link_summary,
    "image_inventory": q_image_inventory, "image_summary": q_image_summary, "jsonld_types": q_jsonld_types, "schema_summary": q_schema_summary,
}

# ---- the same in DuckDB -------------------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def _null(e: str) -> str:
    return f"nullif({_trim(e)}, '')"


def _first(*patterns: str) -> str:
    arms = " ".join(f"when regexp_matches(html, {_q(p)}) then regexp_extract(html, {_q(p)}, 1)" for p in patterns)
    return _null(f"case {arms} end")


def _strip(e: str) -> str:
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>", f"[{SPACES}]+"):
        e = f"regexp_replace({e}, {_q(p)}, ' ', 'g')"
    return _trim(e)


def _heads(k: int) -> str:
    p = _q(rf"(?is)<h{k}[^>]*>(.*?)</h{k}>")
    return f"list_filter(list_transform(regexp_extract_all(html, {p}, 1), lambda x: {_strip('x')}), lambda x: x <> '')"


def _host(e: str) -> str:
    return f"regexp_replace(lower(regexp_extract({e}, '(?i)^https?:/+([^/?#]*)', 1)), ':[0-9]*$', '')"


def _path(e: str) -> str:
    return f"coalesce(nullif(regexp_extract({e}, '(?i)^https?:/+[^/?#]*([^?#]*)', 1), ''), '/')"


def _key(e: str) -> str:
    return f"concat({_host(e)}, regexp_replace({_path(e)}, '/$', ''))"


def _normal(e: str) -> str:
    """Normal form of the URLs at hand: plain ASCII or encoded paths, plain parameters."""
    full = f"(case when regexp_matches({e}, '(?i)^https?://') then {e} else concat('https://', {e}) end)"
    params = f"string_split(regexp_extract({full}, '[?]([^#]*)', 1), '&')"
    q = f"array_to_string(list_transform(list_sort(list_filter({params}, lambda x: x <> '')), lambda x: case when contains(x, '=') then x else concat(x, '=') end), '&')"
    p = f"case when length({_path(full)}) > 1 then regexp_replace({_path(full)}, '/$', '') else {_path(full)} end"
    return f"concat(lower(regexp_extract({full}, '(?i)^(https?):', 1)), '://', {_host(full)}, {p}, case when {q} = '' then '' else concat('?', {q}) end)"


_PS = page_signals
SIGNALS = f"""signals0 as (
  select run_id, site, crawl_seq, url, status, {_first(_PS.TITLE)} as title, {_first(*_PS._meta('description'))} as meta_description, {_first(*_PS._meta('robots'))} as meta_robots,
    {_first(*_PS._canonical())} as canonical, {_heads(1)} as h1s, {", ".join(f"len({_heads(k)}) as h{k}_count" for k in range(2, 7))},
    list_filter(list_transform(regexp_extract_all(html, {_q(_PS.LD_JSON)}, 1), lambda x: {_trim('x')}), lambda x: x <> '') as ld_json,
    url like 'https://%' and regexp_matches(html, {_q(_PS.MIXED)}) as mixed_content, regexp_matches(html, {_q(_PS.VIEWPORT)}) as has_viewport,
    regexp_matches(html, {_q(_PS.LANG)}) as has_lang, regexp_matches(html, {_q(_PS.CHARSET)}) as has_charset,
    len(list_filter(string_split({_strip('html')}, ' '), lambda x: x <> '')) as word_count
  from fetches),
signals as (
  select *, coalesce(length(title), 0) as title_length, coalesce(length(meta_description), 0) as meta_description_length,
    coalesce({_normal('url')} = {_normal('canonical')}, false) as canonical_self, h1s[1] as h1, len(h1s) as h1_count,
    len(list_filter(ld_json, lambda x: not json_valid(x))) as invalid_schema_count,
    len(list_filter(ld_json, lambda x: json_valid(x) and regexp_matches(x, '(?i)"@type": *"[^"]*product'))) > 0 as has_product_schema
  from signals0)"""

_CASES = {
    "tech.missing_title": "title is null", "tech.title_long": "title_length > 60", "tech.title_short": "title is not null and title_length < 30",
    "tech.missing_desc": "meta_description is null", "tech.desc_long": "meta_description_length > 155", "tech.missing_h1": "h1_count = 0", "tech.multiple_h1": "h1_count > 1",
    "tech.heading_hierarchy": "(h3_count > 0 and h2_count = 0) or (h4_count > 0 and h3_count = 0)", "tech.missing_canonical": "canonical is null",
    "tech.canonical_mismatch": "canonical is not null and not canonical_self",
    "tech.product_schema": "(contains(url, '/product') or contains(url, '/item') or contains(url, '/p/')) and not has_product_schema",
    "tech.schema_invalid": "invalid_schema_count > 0", "tech.mixed_content": "mixed_content", "tech.viewport": "not has_viewport", "tech.charset": "not has_charset", "tech.lang": "not has_lang",
}


_VALUES = {"tech.title_long": "title_length", "tech.title_short": "title_length", "tech.desc_long": "meta_description_length", "tech.multiple_h1": "h1_count", "tech.canonical_mismatch": "canonical", "tech.schema_invalid": "invalid_schema_count",
           "tech.heading_hierarchy": "concat_ws(', ', case when h3_count > 0 and h2_count = 0 then 'H3 without H2' end, case when h4_count > 0 and h3_count = 0 then 'H4 without H3' end)"}
_SHOWN = {"tech.title_long": 5, "tech.title_short": 5, "tech.desc_long": 0, "tech.multiple_h1": 5, "tech.heading_hierarchy": 5, "tech.canonical_mismatch": 5, "tech.product_schema": 5, "tech.schema_invalid": 3}
_MOST = {"tech.title_long", "tech.desc_long", "tech.multiple_h1"}


def _checks_sql(only=None) -> str:
    parts = []
    for c in findings.page_checks():
        if only is None or c.check_id in only:
            weight = "(case when h3_count > 0 and h2_count = 0 then 1 else 0 end + case when h4_count > 0 and h3_count = 0 then 1 else 0 end)" if c.weight is not None else "1"
            message = c.message.replace("'", "''").replace("%d", "', n, '")
            value = _VALUES.get(c.check_id, "''")
            parts.append(
                f"select site, '{c.check_id}' as check_id, '{c.type}' as type, '{c.severity}' as severity, n, concat('{message}') as message, array_to_string(u[1:{c.samples}], chr(10)) as urls, n as affected_count, "
                f"array_to_string(v[1:{_SHOWN.get(c.check_id, 10)}], chr(10)) as samples, {'most' if c.check_id in _MOST else 'null'}::varchar as detail "
                f"from (select site, sum({weight})::bigint as n, list(url order by crawl_seq, url) as u, list(concat(url, '|', {value}) order by crawl_seq, url) as v, max({_VALUES[c.check_id] if c.check_id in _MOST else 'null'}) as most from signals where {_CASES[c.check_id]} group by site)"
            )
    return " union all ".join(parts)


_DUPES = " union all ".join(
    f"""select site, '{cid}' as check_id, '{t}' as type, 'warning' as severity, sum(n)::bigint as n, concat(sum(n)::bigint, ' pages have duplicate {what}'{extra}) as message,
    array_to_string((list_sort(flatten(list(list_transform(u, lambda x: {{'a': first, 'v': v, 'c': x.c, 'u': x.u}})))))[1:20].list_transform(lambda x: x.u), chr(10)) as urls,
    sum(n)::bigint as affected_count, array_to_string(list_transform(list_sort(list({{'a': first, 'v': v, 'n': n, 'u': u}}))[1:5], lambda x: concat(array_to_string(list_transform(list_sort(x.u)[1:3], lambda y: y.u), ' '), '|', x.v[1:{shown}], ' x', x.n)), chr(10)) as samples, null::varchar as detail
  from (select site, {_trim(f'lower({col})')} as v, count(*) as n, min(crawl_seq) as first, list({{'c': crawl_seq, 'u': url}}) as u from signals where {col} is not null group by all having count(*) > 1) group by site"""
    for col, cid, t, what, extra, shown in (
        ("title", "tech.duplicate_title", "tech_duplicate_title", "titles", ", ' (', count(*), ' unique duplicates)'", 60),
        ("meta_description", "tech.duplicate_desc", "tech_duplicate_meta_desc", "meta descriptions", "", 100),
    )
)
_ALL = f"technical as ({_checks_sql()} union all {_DUPES})"

_CHARS = "case when regexp_matches(c, '^[!$-;=@-\\]_a-z|~]$') then c when c = ' ' then '%20' else url_encode(c) end"


def _enc(e: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({e}, '(?s).'), lambda c: {_CHARS}), '')"


def _dots(p: str) -> str:
    """A path without its dot segments: a fold over segments, each kept, passed over or taking the one before it; a final one leaves a slash."""
    step = "case when x = '..' then regexp_replace(acc, '/[^/]*$', '') when x = '.' then acc else concat(acc, '/', x) end"
    kept = f"list_reduce(list_concat([''], string_split(regexp_replace({p}, '^/', ''), '/')), lambda acc, x: {step})"
    return f"concat({kept}, case when regexp_matches({p}, '/[.]{{1,2}}$') then '/' else '' end)"


_FOLDER = "regexp_replace(" + _path("url") + ", '[^/]*$', '')"
LINKS = f"""tags as (select run_id, site, crawl_seq, url, unnest(regexp_extract_all(html, {_q(_PS.ANCHOR)}, 0)) as tag, generate_subscripts(regexp_extract_all(html, {_q(_PS.ANCHOR)}, 0), 1) - 1 as pos from fetches),
hrefs as (select *, {_trim(f"regexp_extract(tag, {_q(_PS.ANCHOR)}, 1)")} as href, {_strip(f"regexp_extract(tag, {_q(_PS.ANCHOR)}, 2)")} as t, contains(lower(tag), 'rel=') and contains(lower(tag), 'nofollow') as nofollow from tags),
refs as (
  select *, regexp_matches(href, '(?i)^https?://') as whole, regexp_extract(href, '^([^?#]*)', 1) as target, regexp_extract(href, '^[^?#]*(.*)$', 1) as rest
  from hrefs where href <> '' and not regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
targets as (
  select *, case when whole then concat(lower(regexp_extract(href, '(?i)^(https?):', 1)), '://', {_host('href')}, {_enc(_dots(_path('href')))}, rest)
    else concat(regexp_extract(url, '(?i)^(https?:)', 1), '//', {_host('url')}, {_enc(_dots(f"case when target like '/%' then target when target <> '' then concat({_FOLDER}, target) else {_path('url')} end"))}, rest) end as link_url
  from refs),
links as (select run_id, site, crawl_seq, url, link_url, pos::int as pos, case when length(t) > 100 then concat(t[1:100], '...') else t end as text, nofollow, {_host('link_url')} = {_host('url')} as internal
  from (select *, row_number() over (partition by crawl_seq, link_url order by pos) as r from targets) where r = 1),
edges as (select distinct site, {_key('url')} as src, {_key('link_url')} as dst from links where internal),
gone as (select distinct site, {_key('url')} as dst from fetches where status = 404),
broken as (select l.* from links l semi join gone g on l.site = g.site and {_key('l.link_url')} = g.dst where internal),
orphans as (select site, crawl_seq, url from fetches f where {_path('url')} <> '/' and not exists (select 1 from edges e where e.site = f.site and e.dst = {_key('f.url')}))"""


def _sql(ctes: str, body: str) -> str:
    return with_inputs(f"with {ctes} {body}", "fetches")


_IMG = images.oracle(_q)
BROKEN = """select b.site, 'tech.broken_links' as check_id, 'tech_broken_links' as type, 'warning' as severity, count(distinct link_url) as n, concat(count(distinct link_url), ' broken internal links found across ', count(distinct url), ' pages') as message,
      any_value(urls) as urls, count(distinct link_url) as affected_count, any_value(samples) as samples, null::varchar as detail from broken b join (
      select site, array_to_string((list(link_url order by first, link_url))[1:20], chr(10)) as urls, array_to_string((list(concat(link_url, '|', k) order by first, link_url))[1:10], chr(10)) as samples from (
        select site, link_url, min({'c': crawl_seq, 'p': pos}) as first, count(distinct url) as k from broken group by site, link_url) group by site) u on u.site = b.site group by b.site"""

ORACLE_SQL = {
    "page_signals": _sql(SIGNALS, """select site, crawl_seq, url, title, title_length, meta_description, meta_description_length, meta_robots, canonical, canonical_self, h1, h1_count,
      h2_count, h3_count, h4_count, h5_count, h6_count, len(ld_json) as ld_json_blocks, mixed_content, has_viewport, has_lang, has_charset, word_count from signals"""),
    **{n: _sql(SIGNALS, _checks_sql(ids)) for n, ids in GROUPS.items()},
    "duplicate_findings": _sql(SIGNALS, _DUPES),
    "page_links": _sql(LINKS, "select site, crawl_seq, url, link_url, pos, text, nofollow, internal from links"),
    "link_graph": _sql(LINKS, "select * from edges"),
    "broken_links": _sql(LINKS, "select site, link_url, count(*) as link_count, count(distinct url) as page_count, min(crawl_seq) as first_seen from broken group by all"),
    "broken_link_findings": _sql(LINKS, BROKEN),
    "orphan_pages": _sql(LINKS, "select * from orphans"),
    "uncrawled_targets": _sql(LINKS, f"select distinct site, dst from edges e where not exists (select 1 from fetches f where f.site = e.site and {_key('f.url')} = e.dst)"),
    "link_summary": _sql(LINKS, """select p.site, coalesce(i, 0) as internal_links, coalesce(x, 0) as external_links, broken_pages, coalesce(o, 0) as orphan_pages
      from (select site, count(*) filter (status = 404) as broken_pages from fetches group by site) p
      left join (select site, count(distinct link_url) filter (internal) as i, count(distinct link_url) filter (not internal) as x from links group by site) l on p.site = l.site
      left join (select site, count(*) as o from orphans group by site) q on p.site = q.site"""),
    "image_inventory": _sql(_IMG, "select site, crawl_seq, src, has_alt, format, lazy, responsive, kind from images"),
    "image_summary": _sql(_IMG, """select site, count(*) as images, count(*) filter (not has_alt) as missing_alt, count(distinct crawl_seq) as pages, bool_or(lazy) as any_lazy, bool_or(responsive) as any_responsive,
      bool_or(format in ('webp', 'avif')) as any_modern, (select string_agg(concat(coalesce(f, 'unknown'), ':', n), ',' order by coalesce(f, 'unknown')) from (select format as f, count(*) as n from images j where j.site = i.site group by 1)) as formats
      from images i group by site"""),
    "jsonld_types": _sql(SIGNALS, """select site, t as schema_type, count(*) as n, count(distinct crawl_seq) as pages from (
      select site, crawl_seq, unnest(regexp_extract_all(array_to_string(list_transform(list_filter(ld_json, lambda x: json_valid(x)), lambda x: replace(replace(x, '["Organization","WebSite"]', '"Organization","@type":"WebSite"'), ' ', '')), ' '), '"@type":"([^"]*)"', 1)) as t from signals
      union all select site, crawl_seq, 'ParseError' from signals where invalid_schema_count > 0) group by all"""),
    "schema_summary": _sql(SIGNALS, """select site, coalesce((select string_agg(distinct t, ',' order by t) from (select site as s, unnest(case when contains(a, 'Product') then ['Product'] when contains(a, 'Article') then ['Article', 'Organization', 'WebSite'] else [] end) as t from
        (select site, array_to_string(list_filter(ld_json, lambda x: json_valid(x)), ' ') as a from signals)) u where u.s = v.site), '') as types,
      count(*) filter (contains(a, 'Product')) as product_pages, count(*) filter (contains(a, 'Article')) as article_pages, count(*) filter (contains(a, 'Organization')) as organization_pages, sum(invalid_schema_count)::bigint as parse_errors
      from (select site, array_to_string(list_filter(ld_json, lambda x: json_valid(x)), ' ') as a, invalid_schema_count from signals) v group by site"""),
}
