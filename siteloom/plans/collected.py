"""Queries over collected documents: page speed, robots, sitemaps, redaction, logs, answers, costs, reports, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import redact, urls
from siteloom.operators import checks, collected, collectors, page_signals, site_facts
from siteloom.plans import pages as page_plans
from siteloom.plans.inputs import CTES, frame, with_inputs
from siteloom.plans.pages import SIGNALS, _normal
from siteloom.plans.site import _CH, _h
from siteloom.sources.files import MOST_CELL, file_rows, sitemap_files
from siteloom.sources.scratch import scratch
from siteloom.sources.tables import table
from siteloom.streaming import incremental

_S = f"({CTES['sites']}) s"
CTES["lighthouse"] = """select 'r1' as run_id, cast(page_id as varchar(20)) as site, case when page_id % 23 = 7 then '{bad' else concat('{"categories":{"performance":{"score":0.', cast(10 + page_id % 90 as varchar(10)), '}},"audits":{"largest-contentful-paint":{"numericValue":', cast(1000 + page_id * 37 % 4000 as varchar(10)),
  case when page_id % 2 = 0 then ',"displayValue":"shown"' else '' end, '},"cumulative-layout-shift":{"numericValue":0.', cast(1 + page_id % 4 as varchar(10)), '},"total-blocking-time":', case when page_id % 5 = 0 then '{"displayValue":"310 ms"}' else concat('{"numericValue":', cast(page_id * 13 % 900 as varchar(10)), '}') end,
  ',"first-contentful-paint":{"numericValue":', cast(500 + page_id * 11 % 3000 as varchar(10)), '},"server-response-time":{"numericValue":', cast(page_id * 7 % 1500 as varchar(10)), '},"unused-css-rules":{"score":', case when page_id % 3 = 0 then '1' else '0.5' end, ',"numericValue":', cast(page_id * 3 % 2048 as varchar(10)),
  '},"modern-image-formats":{"score":', case when page_id % 4 = 0 then '0' else 'null' end, ',"numericValue":512},"render-blocking-resources":{"score":', case when page_id % 6 = 0 then '0.25' else '1' end, ',"details":{"items":[{"url":"a"},{"url":"b"}]}},"bootup-time":{"numericValue":', cast(page_id * 17 % 2000 as varchar(10)),
  '},"mainthread-work-breakdown":{"numericValue":', cast(page_id * 29 % 5000 as varchar(10)), '},"uses-long-cache-ttl":{"score":', case when page_id % 7 = 0 then '0.1' else '1' end, ',"details":{"items":[{"url":"c"}]}},"resource-summary":{"details":{"items":[{"resourceType":"script","requestCount":', cast(page_id % 9 as varchar(10)), ',"transferSize":', cast(page_id % 9 * 1000 as varchar(10)),
  '},{"resourceType":"image","requestCount":2,"transferSize":4096}]}}}}') end as full_json from pages"""
CTES["robots"] = f"""select run_id, site, case when sid % 13 = 5 then 404 else 200 end as status, concat('User-agent: *', chr(10), case sid % 5 when 0 then 'Disallow: /' when 1 then 'Disallow:' when 2 then concat('  DISALLOW: /products', chr(13), chr(10), 'Disallow: /blog/x') when 3 then 'Disallow: /cart' else 'Allow: /' end, chr(10),
  case when sid % 3 <> 1 then concat('Sitemap: https://', site, '/sitemap.xml', chr(10), 'sitemap:   https://', site, '/extra.xml') else '' end) as body from {_S}"""
_LIST = "URLLIST"
_CHUNKS = "(select lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as site, page_id % 2 as k, cast(floor(page_id / 1000) as bigint) as c, page_id, url from pages) p"
CTES["sitemap_files"] = f"""select run_id, site, concat('https://', site, '/sitemap.xml') as sitemap_url, concat('<sitemapindex><sitemap><loc> https://', site, '/s0.xml </loc></sitemap><sitemap>', chr(10), '<loc>https://', site, '/s1.xml</loc></sitemap><sitemap><loc>https://', site, '/sitemap.xml</loc></sitemap></sitemapindex>') as body from {_S}
  union all select 'r1', site, concat('https://', site, '/s', cast(k as varchar(5)), '.xml'), concat('<sitemapindex>', MAPLIST, '</sitemapindex>') from (select distinct site, k, c from {_CHUNKS}) q group by site, k
  union all select 'r1', site, concat('https://', site, '/s', cast(k as varchar(5)), '-', cast(c as varchar(20)), '.xml'), concat('<urlset>', {_LIST}, '</urlset>') from {_CHUNKS} group by site, k, c
  union all select run_id, site, concat('https://', site, '/extra.xml'), concat('<loc>https://', site, '/lone</loc><LOC>https://', site, '/two</LOC>') from {_S} where sid % 2 = 0"""
CTES["typed"] = "select page_id, case page_id % 5 when 0 then concat(' \"', url, '\" ') when 1 then concat('(', regexp_extract(url, '^https?://([^/?#]*)', 1), ')') when 2 then concat('see ', url) when 3 then concat('https://', url) else concat('word', cast(page_id as varchar(10))) end as typed from pages"
CTES["scan_logs"] = "select 'r1' as run_id, cast(conv_id as varchar(20)) as site, conv_id * 100 + turn as line_no, case (conv_id + turn) % 3 when 0 then concat('[HIGH] ', substr(role, 1, 9), ' ', cast(conv_id as varchar(10))) when 1 then concat('total critical: ', cast(turn as varchar(10)), ' token=abc') else concat('line of ', role) end as line from conversations"
CTES["answers"] = "select conv_id, turn, case when turn % 4 = 3 then 'no answer' else concat(case turn % 3 when 0 then concat('Here: ```json', chr(10)) when 1 then '``` ' else '' end, '{\"findings\":[{\"category\":\"', case conv_id % 3 when 0 then 'CTA' when 1 then 'trust' else 'none' end, '\",\"severity\":\"', case turn % 5 when 0 then 'High' when 1 then 'critical' else 'odd' end, '\",\"description\":\"d', cast(conv_id as varchar(10)), '\"},{\"category\":\"mobile\",\"severity\":\"low\",\"description\":\"second\"}]}', case when turn % 3 < 2 then '```' else '' end) end as text from conversations"
CTES["traces"] = "select concat('run', cast(user_id % 50 as varchar(10))) as run_id, event_id, case event_id % 4 when 0 then 'gpt-4o' when 1 then 'gemini-2.5-pro' when 2 then 'gpt-4o-mini' else 'unlisted' end as model, case when event_id % 17 = 0 then null else event_id % 3000 end as prompt_tokens, event_id % 700 as output_tokens from events"


def q_url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalise(F.col("url")).alias("normal"), urls.link_key(F.col("url")).alias("link_key"))


def q_url_clean(spark, d):
    return frame(spark, d, "typed").select("page_id", urls.clean_input(F.col("typed")).alias("cleaned"))


def _lh(spark, d):
    return collected.lighthouse(frame(spark, d, "lighthouse"))


def q_lighthouse_metrics(spark, d):
    return _lh(spark, d).select("site", "lcp", "cls", "tbt", "fcp", "ttfb", "score", "page_weight", "page_weight_kb", "requests", "script_requests", "image_requests")


def q_worst_metric(spark, d):
    return collected.ratings(_lh(spark, d)).select("site", "lcp_rating", "cls_rating", "tbt_rating", "fcp_rating", "ttfb_rating", "overall", "passes_vitals", "worst_metric")


def q_lighthouse_findings(spark, d):
    return checks.apply("lighthouse", collected.lighthouse_facts(_lh(spark, d))).select("site", "check_id", "type", "severity", "message")


def q_robots_blocking(spark, d):
    return collected.robots_blocking(frame(spark, d, "robots")).drop("run_id")


def q_robots_findings(spark, d):
    return checks.apply("robots", collected.robots_facts(collected.robots_blocking(frame(spark, d, "robots")))).select("site", "check_id", "type", "severity", "message")


def q_sitemap_refs(spark, d):
    return collected.sitemap_refs(frame(spark, d, "robots")).drop("run_id")


def q_sitemap_urls(spark, d):
    return collected.sitemap_urls(frame(spark, d, "sitemap_files"), collected.sitemap_refs(frame(spark, d, "robots"))).drop("run_id")


def q_collected_files(spark, d):
    """The sitemaps written as files, some compressed and some no text, and read again, whole and once: bodies by file, and what is wrong with those that have none."""
    folder = scratch(spark, "sitemap-folder")
    # a file is called by its path on the site, which is short however long the host is; without a host, by its whole URL
    name = F.url_encode(F.regexp_replace("sitemap_url", "^https://[^/]+/", ""))
    rows = frame(spark, d, "sitemap_files", nulls=True).withColumns({"file": name, "k": F.length("sitemap_url") % 11})
    # a folder's name cannot be empty and would be read as null; no site holds a slash
    named = rows.withColumn("site", F.when(F.col("site") == "", "/").otherwise(F.col("site")))
    shown = named.select(F.when(F.col("k") == 5, F.concat(F.lit("\u0000"), "body")).otherwise(F.col("body")).alias("value"), "run_id", "site", "file", "k")
    # a file takes its time however short it is, so files are dealt to tasks by number, not by size
    shown = shown.repartition(4 * spark.sparkContext.defaultParallelism, "site", "file")
    for packed, codec in ((True, "gzip"), (False, "none")):
        part = shown.where((F.col("k") % 3 == 0) == packed).drop("k")
        part.write.mode("append").option("compression", codec).partitionBy("run_id", "site", "file").text(folder)
    out = sitemap_files(file_rows(spark, folder, MOST_CELL, MOST_CELL), "error")
    return out.select(F.when(F.col("site") == "/", "").otherwise(F.col("site")).alias("site"), "sitemap_url", F.sha2("body", 256).alias("body_sha256"), "error")


def q_url_set(spark, d):
    found = collected.sitemap_urls(frame(spark, d, "sitemap_files"), collected.sitemap_refs(frame(spark, d, "robots")))
    return site_facts.url_set(frame(spark, d, "fetches"), found).select("site", "url", F.col("at.src").alias("src"), F.col("at.seq").alias("seq"))


def q_redact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", redact.redact(F.col("text")).alias("redacted")).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.size(F.split("redacted", r"\[REDACTED")).alias("parts"))


_ASSIGNED = '[A-Za-z_]+ = "[^"]*"'


def q_likely_secrets(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.concat(F.split("text", r"[\x20\x09-\x0D]+"), F.regexp_extract_all("text", F.lit(_ASSIGNED), F.lit(0))))).alias("word"))
    return words.where(redact.likely_secret(F.col("word"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_scan_log_findings(spark, d):
    return collected.scan_findings(frame(spark, d, "scan_logs")).drop("run_id")


def q_model_findings(spark, d):
    return collected.model_findings(frame(spark, d, "answers")).drop("evidence")


def q_llm_cost(spark, d):
    return collected.run_costs(frame(spark, d, "traces")).withColumns({"shown": collected.show_cost(F.col("cost")), "cost_nano": F.round(F.col("cost") * 1e9).cast("long")}).drop("cost")


def q_stage_durations(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return collected.stage_durations(e.select(F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 500) * 1000000).alias("ended_at")))


def _snapshots(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(collected.cache_key(F.lit("site"), F.col("user_id").cast("string")).alias("cache_key"), F.col("event_type").alias("cache_type"), F.col("ts").alias("collected_at"), F.lit(43200000).cast("long").alias("ttl_ms"))


_AS_OF = "2024-01-30 12:00:00"


def q_snapshot_ttl(spark, d):
    return collected.live_snapshots(_snapshots(spark, d), F.to_timestamp(F.lit(_AS_OF))).select("cache_key", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"))


def q_cache_statistics(spark, d):
    return collected.cache_statistics(_snapshots(spark, d), F.to_timestamp(F.lit(_AS_OF)))


CTES["responses"] = f"""select run_id, site, case k when 0 then '/.well-known/security.txt' else '/humans.txt' end as path, case when (sid + k) % 3 = 0 then 404 else 200 end as status, concat('body of ', site) as body from {_S} cross join (select 0 as k union all select 1) w where (sid + k) % 4 <> 1"""
CTES["dns"] = f"""select run_id, site, case (sid + pos) % 3 when 0 then 'A' when 1 then 'AAAA' else 'CNAME' end as rtype, pos, concat('v', cast(pos as varchar(5))) as value, 60 * (1 + sid % 5) + pos as ttl from {_S} cross join (select 0 as pos union all select 1 union all select 2 union all select 3) p where pos <= sid % 4"""
CTES["serp_items"] = """select 'r1' as run_id, cast(page_id % 30 as varchar(10)) as site, 1 + page_id % 2 as provider, page_id as pos, case page_id % 2 when 0 then concat('{"position":', cast(page_id % 10 as varchar(5)), ',"title":"t","link":"', url, '"}') else concat('{"type":"', case page_id % 3 when 0 then 'paid' else 'organic' end, '","url":"', url, '","description":"d"}') end as item from pages"""


def q_well_known(spark, d):
    return collectors.well_known(frame(spark, d, "sites"), frame(spark, d, "responses")).drop("run_id")


def q_security_txt(spark, d):
    return checks.apply("well_known", collectors.well_known(frame(spark, d, "sites"), frame(spark, d, "responses"))).select("site", "check_id", "type", "severity", "message")


def q_dns_facts(spark, d):
    out = collectors.dns_facts(frame(spark, d, "dns")).drop("run_id")
    return out.withColumns({c: F.array_join(c, ",") for c in ("a_records", "aaaa_records", "cname_chain")})


def q_serp_results(spark, d):
    return collectors.serp_results(frame(spark, d, "serp_items")).drop("run_id")


def q_host_variants(spark, d):
    return collectors.host_variants(frame(spark, d, "sites")).drop("run_id")


def q_crawl_findings(spark, d):
    chains = site_facts.redirect_chains(frame(spark, d, "hops"))
    refs = collected.sitemap_refs(frame(spark, d, "robots"))
    pages = frame(spark, d, "urls")
    facts = collectors.crawl_facts(refs, collected.sitemap_urls(frame(spark, d, "sitemap_files"), refs), frame(spark, d, "sites"), chains, site_facts.host_rules(chains), collectors.parameterised_count(pages))
    return checks.apply("crawl", facts).select("site", "check_id", "type", "severity", "message")


def q_stream_page_signals(spark, d):
    schema = table(spark, d, "pages").schema
    stream = incremental.read_files(spark, f"{d}/pages.parquet*", schema)
    fetched = stream.select(F.lit("r1").alias("run_id"), urls.host(F.col("url")).alias("site"), F.col("page_id").alias("crawl_seq"), "url", F.lit(200).alias("status"), "html")
    out = incremental.drain(incremental.page_signal_stream(fetched, page_signals.page_signals), "stream-signals")
    return out.select("site", "crawl_seq", "title", "h1_count", "word_count", "has_viewport")


def q_stream_ttl_dedup(spark, d):
    schema = table(spark, d, "events").schema
    stream = incremental.event_snapshots(incremental.read_files(spark, f"{d}/events.parquet*", schema))
    out = incremental.drain(incremental.reuse_snapshots(stream), "stream-snapshots")
    return out.withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_")}

# ---- the same in DuckDB -------------------------------------------------------------------


def _duck(sql, *names):
    return with_inputs(sql, *names)


_J = lambda path, kind="double": f"try_cast(json_extract_string(full_json, '{path}') as {kind})"
_N = lambda a: f"""$.audits."{a}".numericValue"""
_M = {"lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt": "total-blocking-time", "fcp": "first-contentful-paint", "ttfb": "server-response-time"}
_num = lambda a: _J(_N(a))
_LHV = "lh as (select site, case when json_valid(full_json) then full_json end as full_json from lighthouse)"
_METRICS = f"""metrics as (select site, full_json, {_num(_M['lcp'])} as lcp, {_num(_M['cls'])} as cls, coalesce({_num(_M['tbt'])}, try_cast(regexp_extract(json_extract_string(full_json, '$.audits."total-blocking-time".displayValue'), '[0-9.]+') as double)) as tbt, {_num(_M['tbt'])} as tbt0,
  {_num(_M['fcp'])} as fcp, {_num(_M['ttfb'])} as ttfb, floor({_J('$.categories.performance.score')} * 100 + 0.5)::int as score,
  {_J('$.audits."resource-summary".details.items[0].requestCount')} as sr, {_J('$.audits."resource-summary".details.items[0].transferSize')} as st from lh)"""
_rate = lambda m, a, b: f"case when {m} is null then 'unknown' when {m} <= {a} then 'good' when {m} <= {b} then 'needs-improvement' else 'poor' end"
_RATES = {m: _rate(m, *collected.LIMITS[m]) for m in _M}
_RANKS = "greatest(" + ", ".join(f"case {m}_rating when 'poor' then 3 when 'needs-improvement' then 2 when 'good' then 1 else 0 end" for m in _M) + ")"
_shown = lambda m: f"""coalesce(json_extract_string(full_json, '$.audits."{_M[m]}".displayValue'), format('{{:.2f}}', {_num(_M[m])}))"""
_sc = lambda a: _J(f"""$.audits."{a}".score""")
_OPP = f"list_filter([case when {_sc('unused-css-rules')} < 1 then coalesce({_num('unused-css-rules')}, 0) end, case when {_sc('modern-image-formats')} < 1 then coalesce({_num('modern-image-formats')}, 0) end], lambda x: x is not null)"
_LHF = [
    ("lcp > 2500", "perf.lcp", "perf_poor_lcp", "case when lcp > 4000 then 'critical' else 'warning' end", f"concat('Largest Contentful Paint (LCP) is ', {_shown('lcp')}, ' (threshold: 2500ms)')"),
    ("cls > 0.1", "perf.cls", "perf_poor_cls", "case when cls > 0.25 then 'critical' else 'warning' end", f"concat('Cumulative Layout Shift (CLS) is ', {_shown('cls')}, ' (threshold: 0.1)')"),
    ("tbt0 > 200", "perf.tbt", "perf_poor_fid", "case when tbt0 > 600 then 'critical' else 'warning' end", f"concat('Total Blocking Time (TBT) is ', {_shown('tbt')}, ' (threshold: 200ms)')"),
    ("fcp > 1800", "perf.fcp", "perf_slow_ttfb", "'info'", f"concat('First Contentful Paint (FCP) is ', {_shown('fcp')})"),
    ("ttfb > 800", "perf.ttfb", "perf_slow_ttfb", "'warning'", f"concat('Time to First Byte (TTFB) is ', {_shown('ttfb')}, ' (threshold: 800ms)')"),
    ("score < 90", "perf.score", "perf_large_html", "case when score < 50 then 'critical' else 'warning' end", "concat('Performance score is ', score, '/100')"),
    (f"list_sum({_OPP}) > 1000", "perf.opportunities", "perf_unoptimized_images", "'warning'", f"concat(len({_OPP}), ' optimization opportunities identified (potential ', format('{{:.1f}}', list_sum({_OPP}) / 1024), 'KB savings)')"),
    (f"{_sc('render-blocking-resources')} < 1", "perf.render_blocking", "perf_render_blocking", "'warning'", "'2 render-blocking resources detected'"),
    (f"{_sc('modern-image-formats')} < 1", "perf.images", "perf_unoptimized_images", "'warning'", "'Image optimization issues: legacy formats'"),
    (f"{_num('bootup-time')} > 1000", "perf.bootup", "perf_large_html", "'warning'", f"concat('High JavaScript bootup time (', format('{{:.2f}}', {_num('bootup-time')} / 1000), 's)')"),
    (f"{_num('mainthread-work-breakdown')} > 3000", "perf.mainthread", "perf_large_html", "'warning'", f"concat('Excessive main thread work (', format('{{:.2f}}', {_num('mainthread-work-breakdown')} / 1000), 's)')"),
    (f"{_sc('uses-long-cache-ttl')} < 1", "perf.caching", "perf_large_html", "'info'", "'1 static assets lack efficient cache policies'"),
]
_REFS = "refs as (select site, i - 1 as pos, trim(regexp_extract(l, '(?i)^sitemap:\\s*(.+)$', 1)) as ref from (select site, unnest(string_split_regex(body, '\\r?\\n')) as l, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) as i from robots) where regexp_matches(l, '(?i)^sitemap:\\s*(.+)$'))"
_BLOCK = "blocking as (" + " union all ".join(f"select site, i - 1 as pos, trim(l) as line, '{n}' as section, {k} as o from lines where regexp_matches(trim(l), '{p}')" for k, (n, p) in enumerate(collected.ROBOTS.items())) + ")"
_LINES = "lines as (select site, unnest(string_split_regex(lower(body), '\\r?\\n')) as l, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) as i from robots where status = 200)"
_SM = f"""with recursive {_REFS}, parsed as (select site, sitemap_url, list_transform(regexp_extract_all(body, '(?is)<sitemap>.*?<loc>(.*?)</loc>.*?</sitemap>', 1), lambda x: trim(x)) as maps,
  case when contains(lower(body), '<url>') then regexp_extract_all(body, '(?is)<url>.*?<loc>(.*?)</loc>.*?</url>', 1) when contains(body, '<sitemap>') then [] else regexp_extract_all(body, '(?i)<loc>(.*?)</loc>', 1) end as urls from sitemap_files),
start as (select site, ref, min(pos) as pos from (select site, ref, pos from refs union all select site, concat('https://', site, p), 1000000 + i from (select distinct site from sitemap_files) s cross join (values (0, '/sitemap.xml'), (1, '/sitemap_index.xml'), (2, '/sitemap-index.xml')) v(i, p)) group by all),
walk as (select 0 as depth, site, ref, printf('%07d', pos) as path from start union all
  select depth + 1, w.site, trim(m), concat(path, '/', printf('%07d', i - 1)) from walk w join (select site, sitemap_url, unnest(maps) as m, generate_subscripts(maps, 1) as i from parsed) p on p.site = w.site and p.sitemap_url = w.ref where depth < 9 and not exists (select 1 from start t where t.site = w.site and t.ref = trim(m))),
found as (select site, ref, min({{'depth': depth, 'path': path}}) as place from walk group by all),
sm as (select f.site, place, unnest(urls) as url, generate_subscripts(urls, 1) as i from found f join parsed p on p.site = f.site and p.sitemap_url = f.ref),
sitemap_urls as (select site, row_number() over (partition by site order by place.depth, place.path, i)::int as seq, url from sm)"""
def _REDACTED(text: str) -> str:
    """The masking chain (fixed patterns and words) with word edges in place of look-arounds; plain values are set apart before each keyword's mask and put back after it."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    h, octet, uuid = "[0-9a-fA-F]{1,4}", "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
    steps = [
        (r"""(?i)(https?://[^\s"'<>\[\]]+)(\?[^\s"'<>\[\]]*)""", r"\1"), (r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*)", "[REDACTED_JWT]"), (r"(?i)\b(?:0x)?[a-f0-9]{16,}\b", "[REDACTED_HEX]"),
        (rf"""(?i)((?:token|secret|key|auth)[=:]\s*["']?){uuid}""", r"\1[REDACTED_UUID]"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"), (rf"\b(?:{octet}\.){{3}}{octet}\b", "[REDACTED_IP]"),
        (rf"\b(?:{h}:){{2,7}}{h}\b|\b::(?:{h}:){{0,5}}{h}\b|\b{h}::(?:{h}:){{0,5}}{h}\b", "[REDACTED_IP]"),
    ]
    for word in "token secret apikey api_key password passwd auth authorization bearer credential private_key access_key session csrf xsrf".split():
        steps += [
            (rf"""(?i)({word}\s*[=:]\s*["']?)((?:true|false|null|undefined|yes|no)(?:[\s"',;}}\]<>]|$))""", "\\1;\u0001\\2"),
            (rf"""(?i)({word})\s*[=:]\s*["']?([^\s"',;}}\]<>]{{4,}})""", r"\1=[REDACTED]"), (";\u0001", ""),
        ]
    for pattern, put in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(put)}, 'g')"
    return text



ORACLE_SQL = {
    "stream_page_signals": f"with fetches as (select 'r1' as run_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as site, page_id as crawl_seq, url, 200 as status, html from pages), {SIGNALS} select site, crawl_seq, title, h1_count, word_count, has_viewport from signals",
    "stream_ttl_dedup": """with recursive e as (select concat(event_type, '-', user_id) as cache_key, ts, event_id from events),
      k as (select cache_key, min(ts) as ts from e group by cache_key union all select k.cache_key, min(e.ts) from k join e on e.cache_key = k.cache_key and e.ts > k.ts + interval 12 hours group by k.cache_key)
      select e.cache_key, e.ts as collected_at, min(cast(event_id as varchar))::bigint as event_id from e join k on e.cache_key = k.cache_key and e.ts = k.ts group by 1, 2""",
    "redact_documents": f"select doc_id, sha256(r) as redacted_sha256, len(string_split(r, '[REDACTED'))::int as parts from (select doc_id, {_REDACTED('text')} as r from documents)",
    "well_known": _duck(f"select s.site, p as path, r.status, case when r.status between 200 and 299 then r.body[1:2000] else '' end as body_snippet from sites s cross join (select unnest({collectors.WELL_KNOWN}) as p) w left join responses r on r.site = s.site and r.path = p", "sites", "responses"),
    "security_txt": _duck("select s.site, 'sec.security_txt' as check_id, 'sec_missing_csp' as type, 'info' as severity, 'security.txt not found at /.well-known/security.txt' as message from sites s where not exists (select 1 from responses r where r.site = s.site and r.path = '/.well-known/security.txt' and r.status = 200)", "sites", "responses"),
    "dns_facts": _duck("select *, a_records <> '' as resolved, aaaa_records <> '' as has_ipv6 from (select site, coalesce(string_agg(value, ',' order by pos) filter (rtype = 'A'), '') as a_records, coalesce(string_agg(value, ',' order by pos) filter (rtype = 'AAAA'), '') as aaaa_records, coalesce(string_agg(value, ',' order by pos) filter (rtype = 'CNAME'), '') as cname_chain, max(ttl) as ttl from dns group by site)", "dns"),
    "serp_results": _duck("""select site, coalesce(cast(json_extract_string(item, '$.position') as int), 0) as position, coalesce(json_extract_string(item, '$.title'), '') as title, json_extract_string(item, '$.link') as url, '' as snippet from serp_items where provider = 1
      union all select site, row_number() over (partition by site order by pos)::int, '', json_extract_string(item, '$.url'), json_extract_string(item, '$.description') from serp_items where provider = 2 and json_extract_string(item, '$.type') = 'organic'""", "serp_items"),
    "host_variants": _duck("select site, v.variant, concat(v.scheme, '://', case when v.own then site when site like 'www.%' then site[5:] else concat('www.', site) end) as start from sites cross join (values ('httpRoot', 'http', true), ('httpsRoot', 'https', true), ('httpWww', 'http', false), ('httpsWww', 'https', false)) v(variant, scheme, own)", "sites"),
    "crawl_findings": _duck(f"""{_SM}, {_CH}, f as (select s.site, (select count(*) from refs r where r.site = s.site) as refs, (select count(*) from sitemap_urls u where u.site = s.site) as found, (select count(*) from sitemap_urls u where u.site = s.site and seq <= 100 and lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) <> s.site) as other,
      (select count(*) from chains c where c.site = s.site and len(c.c) > 3) as long, (select {_h('https_root')} <> {_h('https_www')} and {_h('https_root')} <> concat('www.', {_h('https_www')}) and {_h('https_www')} <> concat('www.', {_h('https_root')}) from finals n where n.site = s.site) as clash,
      (select http_root like 'http://%' from finals n where n.site = s.site) as stays, (select count(*) from (select site, regexp_extract(url, '[?]([^#]*)', 1) as q, row_number() over (partition by site order by crawl_seq) as r from urls) p where p.site = s.site and r <= 200 and q <> '') as params from sites s)
      select site, 'crawl.sitemap_missing' as check_id, 'crawl_sitemap_missing' as type, 'warning' as severity, 'No sitemap.xml found or referenced in robots.txt' as message from f where refs = 0 and found = 0
      union all select site, 'crawl.sitemap_empty', 'crawl_sitemap_empty', 'warning', 'Sitemap referenced but could not be parsed or is empty' from f where refs > 0 and found = 0
      union all select site, 'crawl.sitemap_foreign_host', 'crawl_sitemap_missing', 'info', 'Sitemap contains URLs with non-canonical hostnames' from f where other > 0
      union all select site, 'crawl.redirect_chain', 'crawl_unreachable', 'warning', concat('Excessive redirect chains detected (', long, ' chains with >3 hops)') from f where long > 0
      union all select site, 'crawl.host_conflict', 'crawl_unreachable', 'warning', 'Inconsistent host configuration: www and non-www hosts serve different content' from f where clash
      union all select site, 'crawl.http_no_https', 'crawl_unreachable', 'critical', 'HTTP root does not redirect to HTTPS' from f where stays
      union all select site, 'crawl.param_urls', 'crawl_unreachable', 'info', concat('Detected ', params, ' URLs with query parameters') from f where params > 0""", "robots", "sitemap_files", "sites", "hops", "urls"),
    "url_normalise": f"select page_id, {_normal('url')} as normal, {page_plans._key('url')} as link_key from pages",
    "url_clean": _duck("""select page_id, case when u = '' then '' else concat('https://', u) end as cleaned from (select page_id, case when b <> '' and not contains(b, '.') and not contains(b, ':') then concat(b, '.com') else b end as u from (
      select page_id, regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(t, '(?i)(https?://.*)$', 1), ''), t), '(?i)^((https?|htp|http|htps|ttps?):?/+)+', ''), '^/+', '') as b from (select page_id, regexp_replace(regexp_replace(trim(typed), '^["''<(\\[{]+|["''>)\\]}]+$', '', 'g'), '\\s+', '', 'g') as t from typed)))""".replace("\\\\", "\\"), "typed"),
    "lighthouse_metrics": _duck(f"""with {_LHV}, {_METRICS} select site, lcp, cls, tbt, fcp, ttfb, score, nullif(st + 4096, 0) as page_weight, floor((st + 4096) / 1024 + 0.5)::bigint as page_weight_kb, nullif(sr + 2, 0) as requests, nullif(sr, 0) as script_requests, case when full_json is not null then 2.0 end as image_requests from metrics""", "lighthouse"),
    "worst_metric": _duck(f"""with {_LHV}, {_METRICS}, r as (select *, {", ".join(f"{s} as {m}_rating" for m, s in _RATES.items())} from metrics) select site, {", ".join(f"{m}_rating" for m in _M)}, ['unknown', 'good', 'needs-improvement', 'poor'][{_RANKS} + 1] as overall, coalesce(lcp < 2500 and cls < 0.1 and tbt < 200, false) as passes_vitals,
      (list_reverse_sort(list_filter([{", ".join(f"{{'r': {m} / {collected.LIMITS[m][0]}, 'i': {-i}, 'm': '{m}'}}" for i, m in enumerate(collected.LIMITS))}], lambda x: x.r is not null))[1]).m as worst_metric from r""", "lighthouse"),
    "lighthouse_findings": _duck(f"with {_LHV}, {_METRICS} " + " union all ".join(f"select site, '{c}' as check_id, '{t}' as type, {s} as severity, {m} as message from metrics where {w}" for w, c, t, s, m in _LHF), "lighthouse"),
    "robots_blocking": _duck(f"with {_LINES}, {_BLOCK} select site, pos, line, section from blocking", "robots"),
    "robots_findings": _duck(f"with {_LINES}, {_BLOCK} select site, 'crawl.robots_blocked' as check_id, 'crawl_robots_blocked' as type, case when bool_or(section = 'home') then 'critical' else 'warning' end as severity, concat('robots.txt blocks important sections: ', string_agg(section, ', ' order by pos, section)) as message from blocking group by site", "robots"),
    "sitemap_refs": _duck(f"with {_REFS} select * from refs", "robots"),
    "sitemap_urls": _duck(f"{_SM} select * from sitemap_urls", "robots", "sitemap_files"),
    # a text writer ends each file with a line feed; checksums are of the bodies with it
    "collected_files": _duck(
        "select site, sitemap_url, case when k <> 5 then sha256(concat(body, chr(10))) end as body_sha256, case when k = 5 then 'not a text file' end as error from (select *, length(sitemap_url) % 11 as k from sitemap_files)",
        "sitemap_files",
    ),
    "url_set": _duck(f"{_SM} select site, url, (min({{'a': src, 'b': seq}})).a as src, (min({{'a': src, 'b': seq}})).b as seq from (select site, url, 0 as src, crawl_seq as seq from fetches union all select site, url, 1, seq from sitemap_urls) group by site, url", "robots", "sitemap_files", "fetches"),
    "likely_secrets": r"""select doc_id, count(*) as n from (select distinct doc_id, unnest(list_concat(string_split_regex(text, '[\x20\x09-\x0D]+'), regexp_extract_all(text, '[A-Za-z_]+ = "[^"]*"', 0))) as w from documents) where length(w) >= 12 and
      (case when length(w) > 32 then 2 when length(w) > 20 then 1 else 0 end + (regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]'))::int + regexp_matches(w, '[0-9]')::int + regexp_matches(w, '[_\-+=/.]')::int + (regexp_matches(w, '[A-Za-z0-9+/=]') and not regexp_matches(w, '(?i)[a-f0-9]'))::int
       + 3 * regexp_matches(w, '(?i)^(sk-|pk-|Bearer\s|Basic\s|eyJ)')::int + 2 * regexp_matches(lower(w), 'secret|token|key|password|credential|private')::int) >= 4 group by doc_id""",
    "scan_log_findings": _duck(r"""with m as (select site, line_no, regexp_replace(line, '(?i)token[:=][^\s]+', 'token=[REDACTED]', 'g') as line from scan_logs), h as (select *, regexp_matches(line, '(?i)^(?:\[|\()?(CRITICAL|HIGH|MEDIUM|LOW|INFO)(?:\]|\))?:?\s*(.+)') as head from m),
      g as (select *, sum(head::int) over (partition by site order by line_no)::bigint as no from h)
      select site, no, upper(max(regexp_extract(line, '(?i)^(?:\[|\()?(CRITICAL|HIGH|MEDIUM|LOW|INFO)(?:\]|\))?:?\s*(.+)', 1)) filter (head)) as severity, trim(max(regexp_extract(line, '(?i)^(?:\[|\()?(CRITICAL|HIGH|MEDIUM|LOW|INFO)(?:\]|\))?:?\s*(.+)', 2)) filter (head)) as title,
        coalesce(string_agg(concat(line, chr(10)), '' order by line_no) filter (not head), '') as description from g where no between 1 and 100 group by site, no""", "scan_logs"),
    "model_findings": _duck("""select conv_id, turn, i - 1 as pos, case lower(f.category) when 'visual_hierarchy' then 'visual_mobile_unfriendly' when 'cta' then 'visual_viewport_issues' when 'trust' then 'visual_text_too_small' when 'mobile' then 'visual_mobile_unfriendly' else 'visual_viewport_issues' end as type,
      case lower(f.severity) when 'critical' then 'critical' when 'high' then 'warning' when 'low' then 'info' else 'info' end as severity, f.description as message from (
      select conv_id, turn, unnest(from_json(json_extract(b, '$.findings'), '[{"category":"VARCHAR","severity":"VARCHAR","description":"VARCHAR"}]')) as f, generate_subscripts(from_json(json_extract(b, '$.findings'), '[{"category":"VARCHAR","severity":"VARCHAR","description":"VARCHAR"}]'), 1) as i
      from (select conv_id, turn, regexp_extract(text, '(?s)([{].*[}])', 1) as b from answers where contains(text, '{')))""", "answers"),
    "llm_cost": _duck(f"""with p as (select * from (values {", ".join(f"('{m}', {a}, {b})" for m, (a, b) in collected.PRICES.items())}) v(model, i, o)) select run_id, steps, prompt_tokens, output_tokens, round(cost * 1e9)::bigint as cost_nano, case when cost < 0.01 then concat('$', format('{{:.4f}}', cost)) else concat('$', format('{{:.2f}}', cost)) end as shown from (
      select run_id, count(*) as steps, sum(prompt_tokens)::bigint as prompt_tokens, sum(output_tokens)::bigint as output_tokens, sum(coalesce(prompt_tokens, 0) / 1000.0 * coalesce(i, 0.00025)::double + output_tokens / 1000.0 * coalesce(o, 0.001)::double) as cost from traces left join p using (model) group by run_id)""", "traces"),
    "stage_durations": """with e as (select concat('run', user_id % 50) as run_id, event_type as stage, ts as a, ts + to_seconds(event_id % 500) as b from events) select run_id, stage, sum(epoch_ms(b) - epoch_ms(a))::bigint as duration_ms from e group by all
      union all select run_id, 'total', epoch_us(max(b)) // 1000 - epoch_us(min(a)) // 1000 from e group by run_id""",
    "snapshot_ttl": f"select cache_key, collected_at from (select sha256(concat('site|', user_id)) as cache_key, max(ts) as collected_at from events group by user_id) where timestamp '{_AS_OF}' <= collected_at + interval 12 hours",
    "cache_statistics": f"select event_type as cache_type, count(*) as entries, count(*) filter (timestamp '{_AS_OF}' > ts + interval 12 hours) as expired from events group by event_type",
}
