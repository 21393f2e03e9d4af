"""Reports in the shapes that are asked of models and shown on the results page; sinks; coverage; the site's row."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom.operators import audit, collected, collectors, findings, report, site_facts, site_row
from siteloom.plans import audit as audit_plans
from siteloom.plans import reports as report_plans
from siteloom.sources import sinks

ANSWER = {
    "executiveSummary": {"score": 40, "grade": "F", "headline": "h", "overview": "o", "keyStrengths": ["a"], "keyIssues": [], "urgency": "immediate"},
    "priorities": [{"rank": 3, "title": "Fix_titles now", "description": "d", "impact": "medium", "effort": "low"}, {"rank": 1, "title": "t", "description": "e", "impact": "high", "effort": "low"}],
    "findingsByCategory": [
        {"name": "Crawl", "score": 10, "findings": [{"type": "crawl_robots_blocked", "severity": "critical", "message": "m"}], "summary": "s"},
        {"name": "crawl", "score": 99, "findings": [], "summary": "second"},
        {"name": "Security", "score": 55.5, "findings": [{"type": "sec_missing_csp", "severity": "warning", "message": "c"}, {"type": "x", "severity": "pass", "message": "p"}], "summary": "sec"},
    ],
    "actionPlan": {"immediate": [], "shortTerm": [], "longTerm": []},
    "limitations": [],
}


@pytest.fixture
def reports(spark):
    rows = [("r", "a", json.dumps(ANSWER)), ("r", "b", "no json"), ("r", "c", json.dumps({k: v for k, v in ANSWER.items() if k != "executiveSummary"})), ("r", "d", None), ("r", "e", '{"categories": {"Crawl": {}, "crawl": {}}}')]
    return report.from_answers(spark.createDataFrame(rows, "run_id string, site string, text string"))


def test_answers(reports):
    (r,) = reports.collect()  # the others cannot be used
    assert (r["site"], r["score"], r["grade"], r["headline"], r["overview"], r["urgency"], r["key_strengths"]) == ("a", 40.0, "F", "h", "o", "immediate", ["a"])
    got = {c["name"]: (c["score"], len(c["findings"]), c["summary"]) for c in r["categories"]}
    # the first of two spellings counts; what is missing has no issues
    assert got["crawl"] == (10.0, 1, "s") and got["security"] == (55.5, 2, "sec") and got["visual"] == (100.0, 0, "No visual issues detected.")
    assert [c["name"] for c in r["categories"]] == ["crawl", "technical", "security", "performance", "visual", "serp"]


def test_rows_of_the_results_page(reports):
    flat = report.flat_rows(reports)
    names = ["id", "category", "title", "description", "impact", "priority", "fix"]
    got = [tuple(r[n] for n in names) for r in flat.orderBy("position").collect()]
    assert got == [
        ("priority-0", "seo", "Fix_titles now", "d", "Medium", 3, "d"), ("priority-1", "seo", "t", "e", "High", 1, "e"), ("crawl-0", "seo", "Crawl Robots Blocked", "m", "High", 1, "m"),
        ("security-0", "technical", "Sec Missing Csp", "c", "Medium", 3, "c"), ("security-1", "technical", "X", "p", "Low", 3, "p"),
    ]
    shown = lambda f: [r["id"] for r in report.dashboard(flat, f).orderBy("shown_at").collect()]
    assert shown("all") == ["priority-1", "crawl-0", "priority-0", "security-0", "security-1"] and shown("seo") == ["priority-1", "crawl-0", "priority-0"] and shown("design") == []
    assert {r["filter"]: r["n"] for r in report.dashboard_counts(flat).collect()} == {"all": 5, "seo": 3, "technical": 2}
    with pytest.raises(ValueError):
        report.dashboard(flat, "priority")


def test_text_and_page_form(spark, reports):
    runs = spark.sql("select 'r' as run_id, 'a' as site, 'https://a/' as url, timestamp '2024-02-01 00:04:05' as generated_at")
    front = report.front_reports(reports, runs)
    r = front.first()
    assert r["designAnalysis"].asDict() == {"aestheticScore": 100.0, "pricePointMatch": "N/A", "critique": "No visual issues detected."} and r["generatedAt"] == "2024-02-01T00:04:05.000Z" and len(r["findings"]) == 5
    lines = report.text_report(front).first()["report"].split("\n")
    assert lines[:5] == ["# AUDIT REPORT", "Target: https://a/", "Date: 2/1/2024, 12:04:05 AM", "Overall Score: 40/100", ""] and lines[5:7] == ["## EXECUTIVE SUMMARY", "o"]
    first = lines.index("## FINDINGS LOG") + 1
    assert lines[first : first + 8] == ["", "[MEDIUM] Fix_titles now (SEO)", "Priority: 3", "Location: General", "URL: https://a/", "Issue: d", "Fix: d", "-" * 40]


def test_failed_reports(spark):
    sites = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, site string")
    (r,) = report.failed_report(sites, sites.where("site = 'b'"), "boom").collect()
    assert (r["site"], r["headline"], r["overview"], r["key_issues"], r["priorities"][0]["title"], r["priorities"][0]["effort"]) == ("a", "Audit Failed", "The audit could not be completed due to an error: boom", ["Audit failed to complete"], "Retry Audit", "low")
    assert [(c["score"], c["findings"]) for c in r["categories"]] == [(0.0, [])] * 6 and r["categories"][5]["summary"] == "Audit failed - no SERP data available." and r["fetch_errors"] == ["a: boom"]
    assert report.flat_rows(report.failed_report(sites, sites.where("site = 'b'"), "boom")).count() == 1


def test_a_rerun_replaces_the_documents_of_its_sites(spark, tmp_path):
    path = str(tmp_path / "reports")
    make = lambda *rows: spark.createDataFrame([("r 1", *x) for x in rows], "run_id string, site string, value string")
    sinks.write_documents(make(("a.example:8080", "one\ntwo"), ("b.example", "b")), path, files=3)
    sinks.write_documents(make(("b.example", "b again")), path)
    sinks.write_documents(make(("b.example", "b again")), path)
    got = sorted(map(tuple, sinks.read_documents(spark, path).collect()))
    assert got == [("r 1", "a.example:8080", "one\ntwo"), ("r 1", "b.example", "b again")]
    assert len(list((tmp_path / "reports").rglob("part-*.txt"))) == 2  # a file a site
    table = str(tmp_path / "table")
    for n in (1, 2):
        sinks.write_table(spark.createDataFrame([("r", "a", n)], "run_id string, site string, n int"), table)
    assert [r["n"] for r in spark.read.parquet(table).collect()] == [2]


def test_envelopes(spark, tmp_path):
    reports = spark.createDataFrame([("r", "s", 50)], "run_id string, site string, score int")
    traces = spark.createDataFrame([("r", i, f"s{i}") for i in range(9)], "run_id string, trace_index int, step_id string")
    meta = spark.createDataFrame([("r", 2)], "run_id string, steps int")
    sinks.write_documents(report.envelopes(reports, traces, meta), str(tmp_path / "json"))
    got = json.loads(sinks.read_documents(spark, str(tmp_path / "json")).first()["value"])
    assert got["report"] == {"score": 50} and [t["step_id"] for t in got["traces"]] == [f"s{i}" for i in range(9)] and got["metadata"] == {"steps": 2}


def test_rates_and_flags(spark):
    page = lambda i, status, html: ("r", "s", i, f"https://s/{i}", status, html)
    df = spark.createDataFrame([page(1, 200, "<html></html>"), page(2, 200, "x"), page(3, 404, ""), page(4, 0, None)], "run_id string, site string, crawl_seq long, url string, status int, html string")
    r = site_facts.coverage(df).first()
    assert (r["fetch_rate"], r["parse_rate"]) == (0.5, 0.5)
    sites = df.select("run_id", "site").distinct()
    make = lambda schema, *rows: spark.createDataFrame([("r", "s", *x) for x in rows], f"run_id string, site string, {schema}")
    found = make("dataset string, data string, error string", ("lighthouse", "rows", "timeout"), ("scan", None, "gone"), ("sitemaps", "rows", None))
    flags = audit.coverage_flags(sites, found, make("resolved boolean", (True,)), make("error string", (None,), ("bad",)), make("position int"), make("desktop string, mobile string", (None, "m")))
    assert flags.first().asDict() == {
        "run_id": "r", "site": "s", "sitemaps": True, "lighthouse_run": True, "scan_run": False, "dns_resolved": True, "tls_verified": False, "serp_checked": False, "screenshots_captured": True,
    }
    pages = df.select("run_id", "site", "crawl_seq", "url", "status", (F.col("crawl_seq") == 1).alias("parsed"), F.lit(False).alias("oversized"), F.lit(False).alias("by_script"), F.lit(False).alias("rate_limited"))
    plan = make("pattern string, sample_size long", ("/", 5), ("/x", 3))
    c = audit.coverage_report(pages, flags, make("message string"), make("seq int, url string"), plan).first()
    # what was planned is what was attempted
    assert (c["pages_total"], c["pages_sampled"], c["coverage_rate"], c["parse_rate"], c["error_breakdown"]) == (8, 2, 0.25, 0.5, {"HTTP 404": 1})
    assert c["limitations"] == ["Sitemap is empty"] and c["warnings"] == ["1 URLs timed out during fetch"] and c["sitemaps_processed"] == 0


def test_the_site_row_is_one_shuffle(spark):
    make = lambda schema, *rows: spark.createDataFrame([("r", *x) for x in rows], f"run_id string, site string, {schema}")
    sites = make("sid int", ("a", 1), ("b", 2), ("a", 1))
    tables = {
        "header_states": make("header string, state struct<state:string,value:string>", ("a", "strict-transport-security", ("absent", None)), ("a", "x-frame-options", ("present", "DENY"))),
        "hops": make("variant string, hop int, url string", ("a", "httpRoot", 0, "http://a/"), ("a", "httpRoot", 1, "https://www.a/"), ("a", "httpsRoot", 0, "https://www.a/")),
        "robots": make("status int, body string", ("a", 200, "x"), ("b", 404, "x")), "sitemap_urls": make("seq int, url string", ("a", 1, "u"), ("a", 2, "v")), "sitemap_errors": make("message string", ("b", "gone")),
        "plan": make("sample_size long", ("a", 2), ("a", 3)), "pages": make("status int", ("a", 200), ("a", 403), ("a", 0)), "url_set": make("url string", ("a", "u"), ("zzz", "not asked for")),
        "signals": make("mixed_content boolean, has_product_schema boolean, invalid_schema_count int, image_count int, images_without_alt int", ("a", True, True, 1, 5, 2), ("a", False, False, 0, 1, 0)),
        "links": make("link_url string, internal boolean", ("a", "x", True), ("a", "y", False)), "templates": make("rank int, pattern string", ("a", 2, "/b"), ("a", 1, "/a")),
        "certificates": make("protocol string, cert_issuer string, days_ceil long, sans array<string>", ("a", "TLSv1.3", "CA", 9, ["a"])), "dns": make("rtype string", ("a", "A"), ("b", "AAAA")),
        "well_known": make("path string, status int", ("a", "/.well-known/security.txt", 200)), "lighthouse": make("score int, lcp double, cls double, tbt double", ("a", 91, 1.0, None, 2.0)),
        "screenshots": make("desktop string, mobile string", ("b", None, None)), "serp_results": make("position int", ("b", 1)), "dataset_states": make("has_data boolean", ("a", True), ("a", False)), "findings": make("severity string", ("a", "info")),
    }
    df = site_row.site_rows(sites, tables)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    # the sites asked for are made distinct; everything else meets in one exchange on the key, and nothing is joined
    assert "Join" not in plan and executed.count("hashpartitioning(run_id") <= 2
    rows = {r["site"]: r.asDict() for r in df.collect()}
    assert set(rows) == {"a", "b"} and set(site_row.DATASETS) == set(tables)
    a, b = rows["a"], rows["b"]
    assert (a["hsts"], a["csp"], a["headers_present"], a["https_enforced"], a["www_preference"], a["robots_valid"], a["pages_total"], a["robots_blocking_count"], a["timeouts"]) == ("absent", None, 1, True, "www", True, 5, 1, 1)
    assert (a["images"], a["images_without_alt"], a["product_pages"], a["internal_links"], a["patterns"], a["first_template"], a["cert_days_left"], a["performance_score"], a["quality"], a["total_urls"]) == (6, 2, 1, 1, ["/a", "/b"], "/a", 9, 91, "medium", 1)
    assert a["security_score"] == 70 and a["notes"] == ["Sampled 1 of 5 pages", "1 URLs failed to fetch"] and a["has_sitemap"] and a["security_txt"]
    assert (b["hsts"], b["https_enforced"], b["www_preference"], b["pages_sampled"], b["sitemaps_failed"], b["has_ipv6"], b["serp_results"], b["quality"], b["screenshots_captured"]) == (None, None, None, 0, 1, True, 1, None, False)
    few = site_row.assembled(sites, {"dns": tables["dns"]})
    assert few.columns == ["run_id", "site", "dns_resolved", "has_ipv6"] and few.count() == 2
    with pytest.raises(ValueError):
        site_row.assembled(sites, {"nothing": sites})


def test_what_models_are_shown_and_say(spark):
    make = lambda schema, *rows: spark.createDataFrame([("r", *x) for x in rows], f"run_id string, site string, {schema}")
    said = json.dumps({"findings": [{"category": "CTA", "severity": "high", "description": "d", "recommendation": "bigger"}]})
    answers = collectors.visual_context(make("text string", ("a", said), ("b", said)), make("crawl_seq int, url string, title string, h1 string", ("a", 2, "v", "late", None), ("a", 1, "u", "first", "Head")), make("desktop string, mobile string", ("a", "x", None)))
    got = {r["site"]: r["evidence"]["facts"] for r in collected.model_findings(answers).collect()}
    assert got["a"] == {"recommendation": "bigger", "category": "CTA", "desktop": "true", "mobile": "false", "title": "first", "h1": "Head", "hasCta": "true"}
    assert got["b"] == {"recommendation": "bigger", "category": "CTA", "desktop": "false", "mobile": "false", "title": "Unknown", "h1": "Unknown", "hasCta": "false"}
    # all rows come along, however many
    sites, results = make("sid int", ("a", 1), ("b", 2)), make("position int, title string, url string, snippet string", *(("a", i, f"t{i}", "u", "s") for i in range(1, 25)))
    blocks = {r["site"]: r["block"] for r in collectors.serp_block(results, sites).collect()}
    assert blocks["b"] == "No SERP data available" and blocks["a"].split("\n")[:2] == ['- Position 1: "t1" - u', "  Snippet: s"] and len(blocks["a"].split("\n")) == 48
    pages = {r["site"]: r["block"] for r in collectors.page_block(make("crawl_seq int, url string, title string, meta_description string", ("a", 1, "u", None, "d"), ("a", 2, "v", "t", None)), sites).collect()}
    assert pages == {"a": "- u\n  Title: (missing)\n  Description: d\n- v\n  Title: t\n  Description: (missing)", "b": "No page metadata available"}


def test_scan_text_with_line_breaks_before_json(spark):
    rows = [("r", "a", '\n\t {"critical": 1}\n'), ("r", "b", "\n{broken"), ("r", "c", "x\ny")]
    got = {r["site"]: (r["parsed"] is not None, r["line_count"]) for r in collected.scan_output(spark.createDataFrame(rows, "run_id string, site string, output string")).collect()}
    assert got == {"a": (True, None), "b": (False, 2), "c": (False, 2)}


def test_texts_for_readers(spark):
    codes = ["INVALID_URL", "FETCH_FAILED", "API_ERROR", "RATE_LIMITED", "SCREENSHOT_FAILED", "PARSE_ERROR", "TIMEOUT", "NETWORK_ERROR", "CORS_ERROR", "UNKNOWN"]
    got = [r["t"] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(collectors.friendly(F.col("c")).alias("t")).collect()]
    assert len(set(got)) == 10 and got[3] == "Too many requests. Please wait a moment and try again." and got[9] == "An unexpected error occurred. Please try again."


def test_rows_of_fallback_reports_without_gathering_a_site(spark):
    types = ["crawl_robots_blocked", "tech_missing_title", "sec_missing_csp", "perf_poor_lcp", "visual_viewport_issues", "serp_title_mismatch", "odd_type"]
    rows = [("r", site, i, f"c{i}", types[i * 3 % 7], ("critical", "warning", "info")[i % 3 if site == "a" else 2], f"m{i}") for site, n in (("a", 60), ("b", 9)) for i in range(1, n)]
    f = spark.createDataFrame(rows, "run_id string, site string, ordinal int, check_id string, type string, severity string, message string")
    sites = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "none")], "run_id string, site string")
    want = report.flat_rows(report.fallback_report(f, findings.scorecard(f, sites)))
    got = report.fallback_rows(f)
    assert dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_order_of_findings_by_the_brief_path(spark):
    d = "/root/testdata/sf0.001"
    key = ["site", "ordinal", "audit", "check_id", "type", "severity"]
    whole, _ = audit_plans._kept(spark, d)
    assert sorted(map(tuple, audit_plans._ordered(spark, d).select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))


def test_dashboard_shows_every_row_of_the_reports(spark):
    d = "/root/testdata/sf0.001"
    key = ["site", "position", "id", "category", "priority"]
    got = report_plans.q_dashboard(spark, d).select(*key, "shown_at").collect()
    rows = sorted(map(tuple, report_plans.q_report_findings(spark, d).select(key).collect()))
    assert sorted(tuple(r)[:5] for r in got) == rows and len({r["category"] for r in got}) > 2
    order = [(r["site"], r["priority"], r["position"]) for r in sorted(got, key=lambda r: (r["site"], r["shown_at"]))]
    assert order == sorted(order)
