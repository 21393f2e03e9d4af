import datetime

from pyspark.sql import functions as F

from siteloom.operators import checks, collected, site_facts


def test_headers(spark):
    roots = spark.createDataFrame([("r", "a", {"Strict-Transport-Security": "max-age=5; preload", "X-Frame-Options": ""}), ("r", "b", None)], "run_id string, site string, headers map<string,string>")
    states = site_facts.security_headers(roots)
    got = {(r["site"], r["header"]): r["state"]["state"] for r in states.collect()}
    assert got["a", "strict-transport-security"] == "present" and got["a", "x-frame-options"] == "absent" and got["b", "content-security-policy"] == "unknown"
    fired = {(r["site"], r["check_id"]) for r in checks.apply("headers", site_facts.header_facts(states)).collect()}
    assert ("b", "sec.hsts") in fired and ("a", "sec.hsts") not in fired and ("a", "sec.other_headers") in fired
    assert spark.range(1).select(site_facts.hsts(F.lit("max-age=5; includeSubDomains")).alias("h")).first()["h"].asDict() == {"max_age": 5, "include_subdomains": True, "preload": False}
    assert spark.range(1).select(site_facts.csp(F.lit("a x; b; A y z")).alias("c")).first()["c"] == {"a": ["y", "z"], "b": []}


def test_redirects(spark):
    hops = [("r", "h.z", "httpRoot", i, f"http://h.z/{i % 2}", 301) for i in range(3)] + [("r", "h.z", "httpsRoot", 0, "https://www.h.z/", 200), ("r", "h.z", "httpsWww", 0, "https://o.p/", 200)]
    chains = site_facts.redirect_chains(spark.createDataFrame(hops, "run_id string, site string, variant string, hop int, url string, status int"))
    health = site_facts.redirect_health(chains).first()
    assert (health["max_chain"], health["loops"], health["health"]) == (3, 1, "critical")
    rules = site_facts.host_rules(chains).first()
    assert rules["host_conflict"] and rules["http_stays"] and not rules["https_enforced"] and not rules["www_consistent"]


def test_certificates(spark):
    rows = [("r", str(i), p, e) for i, (p, e) in enumerate([("TLSv1.1", "2024-01-31T00:00:00Z"), ("TLSv1.3", "2024-03-01T12:00:00Z"), ("SSLv3", "unknown"), (None, "2024-03-05T00:00:00Z")])]
    got = site_facts.certificates(spark.createDataFrame(rows, "run_id string, site string, protocol string, expiry_date string"), F.lit(datetime.datetime(2024, 2, 1))).orderBy("site").collect()
    assert [r["days_floor"] for r in got] == [-1, 29, None, 33] and [r["days_ceil"] for r in got] == [-1, 30, None, 33]
    assert [r["cert_finding"] for r in got] == ["TLS certificate has expired", "TLS certificate expires in 29 days", None, None] and [r["weak_protocol"] for r in got] == [True, False, True, False]


def test_templates_first_match(spark):
    paths = ["/products/a", "/2024/05/x", "/blog/x", "/about-us", "/x"]
    got = [r["t"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(site_facts.template(F.col("p"))["type"].alias("t")).collect()]
    assert got == ["product", "blog-post", "blog-post", "about", None]


def test_lighthouse(spark):
    good = '{"categories":{"performance":{"score":0.9}},"audits":{"largest-contentful-paint":{"numericValue":2500},"total-blocking-time":{"displayValue":"1.5 s"}}}'
    bad = '{"categories":{"performance":{"score":0.49}},"audits":{"largest-contentful-paint":{"numericValue":4001,"displayValue":"4.0 s"},"cumulative-layout-shift":{"numericValue":0.3}}}'
    rows = collected.ratings(collected.lighthouse(spark.createDataFrame([("r", "a", good), ("r", "b", bad), ("r", "c", "{bad")], "run_id string, site string, full_json string")))
    got = {r["site"]: r for r in rows.collect()}
    assert got["a"]["tbt"] == 1.5 and got["a"]["lcp_rating"] == "good" and got["b"]["overall"] == "poor" and got["b"]["worst_metric"] == "cls" and got["c"]["overall"] == "unknown"
    fired = {(r["site"], r["check_id"], r["severity"]) for r in checks.apply("lighthouse", collected.lighthouse_facts(rows)).collect()}
    assert fired == {("b", "perf.lcp", "critical"), ("b", "perf.cls", "critical"), ("b", "perf.score", "critical")}


def test_sitemaps_follow_nested_indexes_once(spark):
    files = [
        ("r", "s", "https://s/sitemap.xml", "<sitemapindex><sitemap><loc>https://s/a.xml</loc></sitemap><sitemap><loc>https://s/sitemap.xml</loc></sitemap></sitemapindex>"),
        ("r", "s", "https://s/a.xml", "<urlset><url><loc> https://s/1 </loc></url><url><loc>https://s/2</loc></url></urlset>"),
        ("r", "s", "https://s/r.xml", "<loc>https://s/0</loc>"),
    ]
    robots = spark.createDataFrame([("r", "s", 200, "User-agent: *\r\nDisallow:\r\nSitemap: https://s/r.xml")], "run_id string, site string, status int, body string")
    df = spark.createDataFrame(files, "run_id string, site string, sitemap_url string, body string")
    got = collected.sitemap_urls(df, collected.sitemap_refs(robots)).orderBy("seq")
    assert [r["url"] for r in got.collect()] == ["https://s/0", "https://s/1", "https://s/2"]
    assert collected.sitemap_urls(df, collected.sitemap_refs(robots), most=2).count() == 2
    assert [r["section"] for r in collected.robots_blocking(robots).collect()] == ["home"]


def test_scan_log(spark):
    lines = ["intro", "[HIGH] First", "more", "token=abc", "LOW: second", "critical: 3"]
    df = spark.createDataFrame([("r", "s", i, x) for i, x in enumerate(lines)], "run_id string, site string, line_no int, line string")
    got = [(r["severity"], r["title"], r["description"]) for r in collected.scan_findings(df).orderBy("no").collect()]
    assert got == [("HIGH", "First", "more\ntoken=[REDACTED]\n"), ("LOW", "second", ""), ("CRITICAL", "3", "")]
    assert collected.scan_summary(df).first()["critical"] == 3


def test_costs_and_ttl(spark):
    traces = spark.createDataFrame([("r", "gpt-4o", 1000, 1000), ("r", "x", None, 1000)], "run_id string, model string, prompt_tokens long, output_tokens long")
    assert abs(collected.run_costs(traces).first()["cost"] - (0.0125 + 0.001)) < 1e-12
    t = datetime.datetime(2024, 1, 1)
    snaps = spark.createDataFrame([("k", "site", t, 1000), ("k", "site", t - datetime.timedelta(seconds=9), 1000)], "cache_key string, cache_type string, collected_at timestamp, ttl_ms long")
    live = lambda ms: collected.live_snapshots(snaps, F.lit(t + datetime.timedelta(milliseconds=ms))).count()
    assert [live(999), live(1000), live(1001)] == [1, 1, 0]


def test_model_answers(spark):
    rows = [(0, '```json\n{"findings":[{"category":"CTA","severity":"High","description":"d"}]}```'), (1, "nothing"), (2, '{"other":1}'), (3, None)]
    got = collected.model_findings(spark.createDataFrame(rows, "i int, text string")).collect()
    assert [(r["i"], r["type"], r["severity"], r["message"]) for r in got] == [(0, "visual_viewport_issues", "warning", "d")]
