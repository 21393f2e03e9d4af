"""Queries over reports: from answers, from findings, of failed runs; their rows, texts and envelopes; what models are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import audit, collected, collectors, findings, page_signals, report
from siteloom.plans.audit import _CAT, _INIT, _PRIO, _SCORES, _kept, _ordered, _sql
from siteloom.plans.collected import ORACLE_SQL as COLLECTED
from siteloom.plans.inputs import CTES, frame, with_inputs
from siteloom.plans.pages import SIGNALS
from siteloom.sources.scratch import keep

_S = f"({CTES['sites']}) s"
#: Answers in the shape that is asked for, some without a part that must be there, some that are no JSON.
CTES["reports"] = """select 'r1' as run_id, concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as site, case turn % 4
  when 0 then concat('{"executiveSummary":{"score":', cast(50 + conv_id % 50 as varchar(10)), ',"grade":"B","headline":"h","overview":"o', cast(conv_id as varchar(10)),
    '","keyStrengths":["fast","plain"],"keyIssues":["no title"],"urgency":"high"},"priorities":[{"rank":2,"title":"Fix titles","description":"d1","impact":"high","effort":"low"},{"rank":1,"title":"b","description":"d2","impact":"odd","effort":"high"}],',
    '"findingsByCategory":[{"name":"Crawl","score":', cast(conv_id % 100 as varchar(10)), ',"findings":[{"type":"crawl_robots_blocked","severity":"critical","message":"m1"},{"type":"odd-type_x","severity":"pass","message":"m2"}],"summary":"s1"},',
    '{"name":"crawl","score":1,"findings":[],"summary":"later"},{"name":"SERP","score":40.5,"findings":[{"type":"serp_x","severity":"warning","message":"m3"}],"summary":"s2"}],"actionPlan":{"immediate":["a"],"shortTerm":[],"longTerm":[]},"limitations":[]}')
  when 1 then '{"findingsByCategory":[],"priorities":[]}'
  when 2 then 'no json'
  else '{"executiveSummary":{"score":90,"grade":"A","headline":"short","overview":"","keyStrengths":[],"keyIssues":[],"urgency":"low"},"priorities":[],"findingsByCategory":[]}' end as text
from conversations"""
CTES["shots"] = f"select run_id, site, case when sid % 4 = 1 then null else 'd' end as desktop, case when sid % 3 = 1 then null else 'm' end as mobile from {_S} where sid % 7 <> 2"
_SERP_SITE = "case when page_id % 9 = 4 then 'none.example' else lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) end"
CTES["site_results"] = f"""select 'r1' as run_id, {_SERP_SITE} as site, 1 + page_id % 7 as position, concat('t', cast(page_id as varchar(10))) as title, url, case when page_id % 3 = 0 then '' else 'found here' end as snippet from pages where page_id % 2 = 0"""
CTES["site_queries"] = f"select run_id, site, concat('site:', site) as query from {_S} where sid % 5 <> 3"
CTES["report_runs"] = f"select run_id, site, concat('https://', site, '/') as url, cast('2024-02-01 15:04:05' as timestamp) as generated_at from {_S}"


def _reports(spark, d):
    return report.from_answers(frame(spark, d, "reports"))


def _fallback(spark, d):
    f, sites = _kept(spark, d)
    return report.fallback_report(f, findings.scorecard(f, sites))


def q_report_summaries(spark, d):
    out = _reports(spark, d).select("site", "score", "grade", "headline", "overview", "key_strengths", "key_issues", "urgency", F.size("priorities").alias("priorities"))
    return out.withColumns({c: F.array_join(c, "\n") for c in ("key_strengths", "key_issues")})


def q_report_categories(spark, d):
    rows = _reports(spark, d).select("site", F.explode("categories").alias("c"))
    return rows.select("site", F.col("c.name").alias("category"), F.col("c.score").alias("score"), F.size("c.findings").alias("findings"), F.col("c.summary").alias("summary"))


def q_answer_findings(spark, d):
    return report.flat_rows(_reports(spark, d)).drop("run_id")


def q_fallback_report(spark, d):
    told = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[n].cast("string") for n in names))), "\n")
    out = _fallback(spark, d).select("site", "score", "grade", "urgency", "headline", "overview", "key_strengths", "key_issues", told("priorities", "rank", "title", "description", "impact").alias("priorities"), told("categories", "name", "score", "summary").alias("categories"))
    return out.withColumns({c: F.array_join(c, "\n") for c in ("key_strengths", "key_issues")})


def q_report_findings(spark, d):
    return report.fallback_rows(_kept(spark, d)[0]).drop("run_id")


def q_dashboard(spark, d):
    return report.dashboard(report.fallback_rows(_kept(spark, d)[0])).drop("run_id")


def q_dashboard_counts(spark, d):
    return report.dashboard_counts(report.fallback_rows(keep(_ordered(spark, d), "ordered-findings"))).drop("run_id")


def q_report_text(spark, d):
    return report.text_report(report.front_reports(_fallback(spark, d), frame(spark, d, "report_runs"))).drop("run_id")


def q_failed_reports(spark, d):
    fetched = frame(spark, d, "fetches").where("crawl_seq % 20 = 3")
    out = report.failed_report(frame(spark, d, "sites"), fetched, "no page was fetched")
    p = F.col("priorities")[0]
    return out.select(
        "site", "score", "grade", "headline", "overview", "urgency", F.array_join("key_issues", "\n").alias("key_issues"), p["title"].alias("priority"), F.size("categories").alias("categories"),
        F.aggregate("categories", F.lit(0.0), lambda a, c: a + c["score"]).alias("category_scores"), F.element_at("categories", -1)["summary"].alias("last_summary"), F.array_join("fetch_errors", "\n").alias("fetch_errors"), "flag", "quality",
    )


def q_report_envelopes(spark, d):
    f, sites = _kept(spark, d)
    scores = findings.scorecard(f, sites)
    front = report.front_reports(report.fallback_report(f, scores, listed=False), frame(spark, d, "report_runs"), report.fallback_rows(f))
    front = front.withColumn("run_id", F.concat(F.lit("run"), (F.col("overallScore") % 50).cast("int").cast("string")))
    traces = collectors.common_traces(frame(spark, d, "model_traces").withColumn("ts", F.col("event_id"))).select("run_id", "trace_index", "step_id", "model")
    value = report.envelopes(front, traces, collected.run_costs(frame(spark, d, "traces")).select("run_id", "steps"))
    # an envelope is as long as its site has findings: it is parsed once
    held = "site string, report struct<overallScore:double,findings:array<struct<id:string>>,designAnalysis:struct<aestheticScore:double>,generatedAt:string>, traces array<struct<model:string>>, metadata struct<steps:bigint>"
    j = value.select(F.from_json("value", held).alias("j")).select("j.*")
    first = lambda c: F.try_element_at(c, F.lit(1))
    return j.select(
        "site", F.col("report.overallScore").alias("score"), first("report.findings")["id"].alias("first_id"), F.col("report.designAnalysis.aestheticScore").alias("aesthetic"),
        F.col("report.generatedAt").alias("generated_at"), first("traces")["model"].alias("first_model"), F.size("traces").cast("long").alias("traces"), F.col("metadata.steps").alias("steps"),
    )


def q_page_blocks(spark, d):
    sampled = page_signals.extract(audit.sampled(frame(spark, d, "fetches")), ["title", "description"])
    return collectors.page_block(sampled, frame(spark, d, "sites")).drop("run_id")


def q_serp_blocks(spark, d):
    return collectors.serp_block(frame(spark, d, "site_results"), frame(spark, d, "sites")).drop("run_id")


def _facts(df, *names):
    return df.select("site", "conv_id", "turn", "pos", *(F.try_element_at("evidence.facts", F.lit(n)).alias(n.lower()) for n in names))


def q_visual_evidence(spark, d):
    signals = page_signals.extract(frame(spark, d, "fetches"), ["title", "headings"])
    answers = collectors.visual_context(frame(spark, d, "site_answers"), signals, frame(spark, d, "shots"))
    return _facts(collected.model_findings(answers), "recommendation", "category", "desktop", "mobile", "title", "h1", "hasCta")


def q_serp_evidence(spark, d):
    pages = audit.sampled(frame(spark, d, "fetches"))
    answers = collectors.serp_context(frame(spark, d, "serp_answers"), frame(spark, d, "site_queries"), frame(spark, d, "site_results"), pages)
    return _facts(collectors.serp_model_findings(answers), "action", "serpType", "query", "resultCount", "analyzedPages")


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_")}

# ---- the same in DuckDB -------------------------------------------------------------------

_USED = """used as (
  select site, cast(text as json) as j from reports
  where json_valid(text) and json_exists(case when json_valid(text) then text else '{}' end, '$.executiveSummary') and json_exists(case when json_valid(text) then text else '{}' end, '$.priorities'))"""
_get = lambda p: f"json_extract_string(j, '{p}')"
_lines = lambda p: f"array_to_string(cast(json_extract(j, '{p}') as varchar[]), chr(10))"
_ENTRIES = """named as (select site, unnest(['crawl', 'technical', 'security', 'performance', 'visual', 'serp']) as name, unnest([1, 2, 3, 4, 5, 6]) as k from used),
entries as (
  select site, lower(json_extract_string(e, '$.name')) as name, e, row_number() over (partition by site, lower(json_extract_string(e, '$.name')) order by i) as r
  from (select site, unnest(cast(json_extract(j, '$.findingsByCategory') as json[])) as e, generate_subscripts(cast(json_extract(j, '$.findingsByCategory') as json[]), 1) as i from used)),
groups_ as (
  select n.site, n.name, n.k, coalesce(cast(json_extract_string(e, '$.score') as double), 100.0) as score, cast(json_extract(e, '$.findings') as json[]) as found,
    case when e is null then concat('No ', n.name, ' issues detected.') else json_extract_string(e, '$.summary') end as summary
  from named n left join entries x on x.site = n.site and x.name = n.name and r = 1)"""
_SHOWN = "case {} when 'security' then 'technical' when 'crawl' then 'seo' else {} end"
_ANSWERED = f"""answered as (
  select site, 0 as k, i, concat('priority-', i - 1) as id, 'seo' as category, json_extract_string(p, '$.title') as title, json_extract_string(p, '$.description') as description,
    case json_extract_string(p, '$.impact') when 'high' then 'High' when 'medium' then 'Medium' else 'Low' end as impact, cast(json_extract_string(p, '$.rank') as int) as priority
  from (select site, unnest(cast(json_extract(j, '$.priorities') as json[])) as p, generate_subscripts(cast(json_extract(j, '$.priorities') as json[]), 1) as i from used)
  union all
  select site, k, i, concat(name, '-', i - 1), {_SHOWN.format('name', 'name')},
    case t when 'crawl_robots_blocked' then 'Crawl Robots Blocked' when 'odd-type_x' then 'Odd-Type X' when 'serp_x' then 'Serp X' end, json_extract_string(f, '$.message'),
    case json_extract_string(f, '$.severity') when 'critical' then 'High' when 'warning' then 'Medium' else 'Low' end, k
  from (select *, json_extract_string(f, '$.type') as t from (select site, name, k, unnest(found) as f, generate_subscripts(found, 1) as i from groups_)))"""
_NUMBER = f"case {_CAT} when 'crawl' then 1 when 'technical' then 2 when 'security' then 3 when 'performance' then 4 when 'visual' then 5 else 6 end"
_FLAT = f"""inside as (select *, row_number() over (partition by site, {_CAT} order by ordinal) as i from merged),
flat0 as (
  select site, 0 as k, rank as i, concat('priority-', rank - 1) as id, 'seo' as category, type as title, message as description, case when severity = 'critical' then 'High' else 'Medium' end as impact, rank as priority from prio
  union all
  select site, {_NUMBER}, i, concat({_CAT}, '-', i - 1), {_SHOWN.format(_CAT, _CAT)}, {_INIT.format('type')}, message, case severity when 'critical' then 'High' when 'warning' then 'Medium' else 'Low' end, {_NUMBER} from inside),
flat as (select site, row_number() over (partition by site order by k, i)::int as position, id, category, title, description, impact, priority::int as priority, description as fix from flat0)"""
_CATEGORY_TEXT = f"""cats as (
  select s.site, string_agg(concat(name, '|', score, '.0|', n, ' findings in ', name, ' category.'), chr(10) order by k) as categories, max(score) filter (name = 'visual') as visual
  from (select s.site, s.name, s.k, count(m.site) as n, greatest(0, 100 - 20 * count(*) filter (severity = 'critical') - 10 * count(*) filter (severity = 'warning')) as score
    from (select site, unnest(['crawl', 'technical', 'security', 'performance', 'visual', 'serp']) as name, unnest([1, 2, 3, 4, 5, 6]) as k from sites) s left join merged m on m.site = s.site and {_CAT} = s.name group by all) s group by s.site)"""
_OVERVIEW = "concat('Audit completed with ', (select count(*) from merged m where m.site = s.site), ' findings. Note: Report synthesis encountered an issue, displaying raw findings.')"
_RULE = "----------------------------------------"

ORACLE_SQL = {
    "report_summaries": with_inputs(
        f"""with {_USED} select site, cast({_get('$.executiveSummary.score')} as double) as score, {_get('$.executiveSummary.grade')} as grade, {_get('$.executiveSummary.headline')} as headline, {_get('$.executiveSummary.overview')} as overview,
        {_lines('$.executiveSummary.keyStrengths')} as key_strengths, {_lines('$.executiveSummary.keyIssues')} as key_issues, {_get('$.executiveSummary.urgency')} as urgency, json_array_length(j, '$.priorities')::int as priorities from used""",
        "reports",
    ),
    "report_categories": with_inputs(f"with {_USED}, {_ENTRIES} select site, name as category, score, coalesce(len(found), 0)::int as findings, summary from groups_", "reports"),
    "answer_findings": with_inputs(
        f"with {_USED}, {_ENTRIES}, {_ANSWERED} select site, row_number() over (partition by site order by k, i)::int as position, id, category, title, description, impact, priority, description as fix from answered", "reports"
    ),
    "fallback_report": _sql(
        f"""select s.site, score::double as score, grade, urgency, 'SEO Audit Report' as headline, {_OVERVIEW} as overview, 'Audit completed successfully' as key_strengths,
        coalesce((select string_agg(message, chr(10) order by rank) from prio p where p.site = s.site and rank <= 5), '') as key_issues,
        coalesce((select string_agg(concat(rank, '|', type, '|', message, '|', case when severity = 'critical' then 'high' else 'medium' end), chr(10) order by rank) from prio p where p.site = s.site), '') as priorities, c.categories
        from scores s join cats c on c.site = s.site""",
        _SCORES, _PRIO, _CATEGORY_TEXT,
    ),
    "report_findings": _sql("select * from flat", _PRIO, _FLAT),
    "dashboard": _sql("select *, row_number() over (partition by site order by priority, position)::int as shown_at from flat", _PRIO, _FLAT),
    "dashboard_counts": _sql("select site, 'all' as filter, count(*) as n from flat group by site union all select site, category, count(*) from flat where category in ('seo', 'technical', 'design', 'conversion', 'content') group by site, category", _PRIO, _FLAT),
    "report_text": _sql(
        f"""select s.site, concat('# AUDIT REPORT', chr(10), 'Target: https://', s.site, '/', chr(10), 'Date: 2/1/2024, 3:04:05 PM', chr(10), 'Overall Score: ', score, '/100', chr(10), chr(10), '## EXECUTIVE SUMMARY', chr(10), {_OVERVIEW}, chr(10), chr(10),
        '## DESIGN INTELLIGENCE', chr(10), 'Aesthetic Score: ', c.visual, '/100', chr(10), 'Price Point Alignment: N/A', chr(10), 'Critique: ', (select count(*) from merged m where m.site = s.site and {_CAT} = 'visual'), ' findings in visual category.', chr(10), chr(10),
        '## FINDINGS LOG', coalesce((select string_agg(concat(chr(10), chr(10), '[', upper(impact), '] ', title, ' (', upper(category), ')', chr(10), 'Priority: ', priority, chr(10), 'Location: General', chr(10), 'URL: https://', s.site, '/', chr(10), 'Issue: ', description, chr(10), 'Fix: ', fix, chr(10), '{_RULE}'), '' order by position)
          from flat f where f.site = s.site), '')) as report from scores s join cats c on c.site = s.site""",
        _SCORES, _PRIO, _FLAT, _CATEGORY_TEXT,
    ),
    "failed_reports": with_inputs(
        """select s.site, 0.0::double as score, 'F' as grade, 'Audit Failed' as headline, 'The audit could not be completed due to an error: no page was fetched' as overview, 'immediate' as urgency, 'Audit failed to complete' as key_issues, 'Retry Audit' as priority, 6 as categories,
        0.0::double as category_scores, 'Audit failed - no SERP data available.' as last_summary, concat(s.site, ': no page was fetched') as fetch_errors, 'tool_failure' as flag, 'low' as quality
        from sites s where not exists (select 1 from pages p where p.page_id % 20 = 3 and lower(regexp_extract(p.url, '^https?://([^/?#]*)', 1)) = s.site)""",
        "sites",
    ),
    "report_envelopes": _sql(
        """select s.site, score::double as score, (select arg_min(id, position) from flat f where f.site = s.site) as first_id, c.visual::double as aesthetic, '2024-02-01T15:04:05.000Z' as generated_at,
        (select arg_min(case event_id % 4 when 0 then 'gpt-4o' else 'gemini-2.5-pro' end, event_id) from events e where user_id % 50 = score % 50) as first_model,
        (select count(*) from events e where user_id % 50 = score % 50) as traces, (select nullif(count(*), 0) from events e where user_id % 50 = score % 50) as steps from scores s join cats c on c.site = s.site""",
        _SCORES, _PRIO, _FLAT, _CATEGORY_TEXT,
    ),
    "page_blocks": with_inputs(
        f"""with {SIGNALS} select site, string_agg(concat('- ', url, chr(10), '  Title: ', coalesce(title, '(missing)'), chr(10), '  Description: ', coalesce(meta_description, '(missing)')), chr(10) order by crawl_seq) as block
        from (select *, row_number() over (partition by site order by crawl_seq) as r from signals) where r <= 50 group by site""",
        "fetches",
    ),
    "serp_blocks": with_inputs(
        """select s.site, coalesce(string_agg(concat('- Position ', position, ': "', title, '" - ', url, chr(10), '  Snippet: ', snippet), chr(10) order by position, url) filter (r.url is not null), 'No SERP data available') as block
        from sites s left join site_results r on r.site = s.site group by s.site""",
        "sites", "site_results",
    ),
    "visual_evidence": with_inputs(
        f"""with {SIGNALS}, firsts as (select site, arg_min({{'t': title, 'h': h1}}, crawl_seq) as p from signals group by site),
        said as (select site, conv_id, turn, unnest(cast(json_extract(b, '$.findings') as json[])) as f, generate_subscripts(cast(json_extract(b, '$.findings') as json[]), 1) - 1 as pos
          from (select site, conv_id, turn, regexp_extract(text, '(?s)([{{].*[}}])', 1) as b from site_answers where contains(text, '{{')))
        select a.site, conv_id, turn, pos::int as pos, json_extract_string(f, '$.recommendation') as recommendation, json_extract_string(f, '$.category') as category, (s.desktop is not null)::varchar as desktop, (s.mobile is not null)::varchar as mobile,
          coalesce(p.t, 'Unknown') as title, coalesce(p.h, 'Unknown') as h1, (p.h is not null)::varchar as hascta from said a left join firsts x on x.site = a.site left join shots s on s.site = a.site""",
        "fetches", "site_answers", "shots",
    ),
    "serp_evidence": with_inputs(
        """with said as (select site, conv_id, turn, unnest(cast(json_extract(b, '$.findings') as json[])) as f, generate_subscripts(cast(json_extract(b, '$.findings') as json[]), 1) - 1 as pos
          from (select site, conv_id, turn, regexp_extract(text, '(?s)([{].*[}])', 1) as b from serp_answers where contains(text, '{')))
        select a.site, conv_id, turn, pos::int as pos, json_extract_string(f, '$.action') as action, json_extract_string(f, '$.type') as serptype, q.query,
          (select count(*) from site_results r where r.site = a.site)::varchar as resultcount, (select least(50, count(*)) from fetches p where p.site = a.site)::varchar as analyzedpages
        from said a left join site_queries q on q.site = a.site""",
        "serp_answers", "site_queries", "site_results", "fetches",
    ),
}
