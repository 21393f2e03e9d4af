"""Whole audits: order and evidence of merged findings, deep JSON-LD and sitemaps, headers as they come, redaction against brute force."""

import os
import re

import pytest
from pyspark.sql import functions as F

from siteloom.functions import redact
from siteloom.operators import audit, checks, collected, collectors, findings, jsonld, page_signals, report, site_facts
from siteloom.sources.tables import gate_html

SF = "/root/testdata/sf0.001"


def rows_of(spark, *rows):
    return spark.createDataFrame([("r", "s", *x) for x in rows], "run_id string, site string, check_id string, type string, severity string, message string")


def test_merged_order_and_failures(spark):
    crawl = rows_of(spark, ("crawl.param_urls", "crawl_unreachable", "info", "p"), ("crawl.robots_blocked", "crawl_robots_blocked", "critical", "r"))
    tech = rows_of(spark, ("tech.lang", "tech_missing_lang", "info", "l"), ("tech.missing_title", "tech_missing_title", "critical", "t"))
    perf = rows_of(spark, ("perf.lcp", "perf_poor_lcp", "warning", "slow"))
    visual = rows_of(spark, ("visual.model", "visual_viewport_issues", "info", "b"), ("visual.model", "visual_viewport_issues", "info", "a")).withColumn("place", F.when(F.col("message") == "b", 1).otherwise(2))
    failed = spark.createDataFrame([("r", "s", "performance", "timeout")], "run_id string, site string, audit string, error string")
    got = audit.merged({"visual": [visual], "performance": [perf], "technical": [tech], "crawl": [crawl]}, failed).orderBy("ordinal").collect()
    assert [r["check_id"] for r in got] == ["crawl.robots_blocked", "crawl.param_urls", "tech.missing_title", "tech.lang", "audit.failed", "visual.model", "visual.model"]
    assert [r["message"] for r in got][-3:] == ["performance audit failed to complete", "b", "a"] and got[4]["evidence"]["detail"] == "timeout" and got[4]["type"] == "crawl_unreachable"
    assert [r["ordinal"] for r in got] == list(range(1, 8))
    every = audit.merged({"technical": [tech], "crawl": [crawl]})
    assert [r["title"] for r in report.priorities(every).orderBy("rank").collect()] == ["crawl_robots_blocked", "tech_missing_title"]
    back = report.fallback_report(every, findings.scorecard(every, every)).first()
    assert back["key_issues"] == ["r", "t"] and [(c["name"], c["score"], len(c["findings"])) for c in back["categories"]][:2] == [("crawl", 80.0, 2), ("technical", 80.0, 2)] and back["categories"][5]["summary"] == "0 findings in serp category."


def page(spark, *htmls):
    df = spark.createDataFrame([("r", "h.z", i, f"https://h.z/{i}", 200, h) for i, h in enumerate(htmls)], "run_id string, site string, crawl_seq long, url string, status int, html string")
    return page_signals.page_signals(df)


def test_evidence(spark):
    long = "t" * 70
    s = page(spark, *(f"<title>{long}{'x' * i}</title>" for i in range(8)))
    got = {r["check_id"]: r for r in checks.technical(s).collect()}
    e = got["tech.title_long"]["evidence"]
    assert (e["affected_count"], e["detail"], len(e["samples"])) == (8, "77", 5) and (e["samples"][1]["url"], e["samples"][1]["value"]) == ("https://h.z/1", "71")
    assert len(got["tech.missing_desc"]["evidence"]["samples"]) == 8 and got["tech.missing_desc"]["evidence"]["detail"] is None
    same = checks.apply("titles", checks.INPUTS["titles"].build(page(spark, "<title>A b</title>", "<title>a B</title>", "<title>z</title>"))).first()
    assert same["evidence"]["samples"][0].asDict() == {"url": "https://h.z/0 https://h.z/1", "value": "a b x2"}


def test_twenty_levels_of_json_ld(spark):
    body = '{"@type":"Deepest product"}'
    for i in range(20):
        body = f'{{"@type":"L{i}","x":[{body}]}}'
    s = page(spark, f'<script type="application/ld+json">{body}</script>', '<script type="application/ld+json">{"name":"\\"@type\\": \\"Product\\"","@type":["Thing",{"a":"product"}]}</script>')
    assert {r["schema_type"] for r in jsonld.all_types(s).collect()} == {f"L{i}" for i in range(20)} | {"Deepest product", "Thing"}
    assert [r["has_product_schema"] for r in s.orderBy("crawl_seq").collect()] == [True, False]


def test_headers_in_two_spellings(spark):
    entry = [("Content-Security-Policy", "a"), ("content-security-policy", "b"), ("X-Frame-Options", ""), ("Content-Type", "Text/HTML")]
    roots = spark.createDataFrame([("r", "s", 200, "<p>", entry), ("r", "t", None, "<p>", None)], "run_id string, site string, status int, html string, headers array<struct<key:string,value:string>>")
    got = {(r["site"], r["header"]): r["state"]["value"] or r["state"]["state"] for r in site_facts.security_headers(roots).collect()}
    assert got["s", "content-security-policy"] == "b" and got["s", "x-frame-options"] == "absent" and got["t", "x-frame-options"] == "unknown"
    assert [(r["status"], r["html"]) for r in gate_html(roots).orderBy("site").collect()] == [(200, "<p>"), (0, "")]


def test_https_inside_a_chain_counts(spark):
    hops = [("r", "h.z", "httpRoot", i, u, 301) for i, u in enumerate(["http://h.z/", "https://h.z/a", "http://h.z/b"])] + [("r", "o", "httpRoot", 0, "http://o/", 200)]
    rules = site_facts.host_rules(site_facts.redirect_chains(spark.createDataFrame(hops, "run_id string, site string, variant string, hop int, url string, status int")))
    assert {r["site"]: (r["https_enforced"], r["http_chain"]) for r in rules.collect()} == {"h.z": (True, 3), "o": (False, 1)}
    assert [r["site"] for r in checks.apply("hosts", rules).collect()] == ["o"]


#: Words that name secrets (fixed values).
WORDS = "token secret apikey api_key password passwd auth authorization bearer credential private_key access_key session csrf xsrf".split()


def masked(t):
    """The chain once more, with callbacks and look-arounds of another engine."""
    h, octet, uuid = "[0-9a-fA-F]{1,4}", "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
    sub = lambda p, r, s, i=re.A: re.sub(p, r, s, flags=i)
    t = sub(r"(https?://[^\s\"'<>\[\]]+)(\?[^\s\"'<>\[\]]*)", r"\1", t, re.I | re.A)
    t = sub(r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*)", "[REDACTED_JWT]", t)
    t = sub(r"\b(?:0x)?[a-f0-9]{16,}\b", "[REDACTED_HEX]", t, re.I | re.A)
    t = sub(rf"((?:token|secret|key|auth)[=:]\s*[\"']?){uuid}", r"\1[REDACTED_UUID]", t, re.I | re.A)
    t = sub(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]", t)
    t = sub(rf"\b(?:{octet}\.){{3}}{octet}\b", "[REDACTED_IP]", t)
    t = sub(rf"\b(?:{h}:){{2,7}}{h}\b|\b::(?:{h}:){{0,5}}{h}\b|\b{h}::(?:{h}:){{0,5}}{h}\b", "[REDACTED_IP]", t)
    for w in WORDS:
        put = lambda m: m.group(0) if len(m.group(2)) < 4 or m.group(2).lower() in ("true", "false", "null", "undefined", "yes", "no") else f"{m.group(1)}=[REDACTED]"
        t = re.sub(rf"({w})\s*[=:]\s*[\"']?([^\s\"',;}}\]<>]+)", put, t, flags=re.I | re.A)
    return t


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_redaction_against_brute_force(spark):
    odd = ["a std::abc b", "fe80::1 and 1:2:3:4", "token=true, token=abcd key=\"x\" Secret: longer", "mail a.b@c.de x", "https://h.z/?a=1?b#c", "0xDEADBEEFDEADBEEF 1.2.3.4 999.1.1.1", "", "nothing", "eyJa.eyJb.c"]
    df = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    for r in df.select("doc_id", "text", redact.redact(F.col("text")).alias("out")).collect():
        assert r["out"] == (None if r["text"] is None else masked(r["text"])), r["doc_id"]


def test_requests_and_errors(spark):
    df = spark.createDataFrame([("https://a.b/c",), ("a.b",), ("no spaces here",), ("  ",), (None,)], "url string")
    good, bad = collectors.split_requests(df)
    assert good.count() == 2 and [r["reason"] for r in bad.orderBy("reason").collect()] == ["Invalid URL format", "URL is required", "URL is required"]
    codes = spark.createDataFrame([("The operation was aborted",), ("CORS",), ("fetch failed",), (None,)], "e string").select(collectors.error_code(F.col("e")).alias("c"))
    assert [r["c"] for r in codes.collect()] == ["TIMEOUT", "CORS_ERROR", "NETWORK_ERROR", "FETCH_FAILED"]
