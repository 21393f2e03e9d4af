"""Extraction by choice: what is not asked for never enters a plan."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import page_signals, snapshot

HTML = """<html lang="en"><head><title> T </title><meta name="description" content="d"><link rel="canonical" href="https://a.example/x/"></head><body><h1>One</h1><h3>Deep</h3>
<script type="application/ld+json">{"@type": "\\u0050roduct"}</script><script type="application/ld+json">{bad</script><img src="/a.png" alt=""><img src="/b.png" alt="b"><img alt="none"></body></html>"""
#: A piece of each family's own pattern.
MARKS = {"title": "<title", "description": "[\"']description", "robots": "[\"']robots", "canonical": "canonical", "headings": "<h1", "schema": "ld\\+json", "mixed_content": "src|href", "flags": "viewport", "words": "<style", "images": "<img"}


@pytest.fixture
def fetches(spark):
    return spark.createDataFrame([("r", "a.example", 1, "https://a.example/x", 200, HTML), ("r", "a.example", 2, "https://a.example/y", 0, None)], "run_id string, site string, crawl_seq long, url string, status int, html string")


def test_one_family_after_the_other(fetches):
    whole = page_signals.extract(fetches)
    want = {r["crawl_seq"]: r.asDict(recursive=True) for r in whole.collect()}
    assert want[1]["title"] == "T" and want[1]["canonical_self"] and want[1]["h3_count"] == 1 and want[1]["image_count"] == 2 and want[1]["images_without_alt"] == 1
    assert want[1]["has_product_schema"] and want[1]["invalid_schema_count"] == 1  # a type spelled with an escape counts
    assert want[2]["title"] is None and want[2]["h1_count"] == 0 and want[2]["word_count"] == 0 and want[2]["images"] == []
    seen = set()
    for family in page_signals.FAMILIES:
        part = page_signals.extract(fetches, [family.name])
        for r in part.collect():
            assert all(want[r["crawl_seq"]][k] == v for k, v in r.asDict(recursive=True).items())
        seen |= set(part.columns)
    assert seen == set(whole.columns)
    assert page_signals.extract(fetches, []).columns == ["run_id", "site", "crawl_seq", "url", "status"]


def test_plans_hold_only_what_is_asked_for(fetches):
    for name, mark in MARKS.items():
        plan = page_signals.extract(fetches, [name])._jdf.queryExecution().analyzed().toString()
        held = {n for n, m in MARKS.items() if m in plan}
        assert mark in plan and held - {name} <= {"words"} if name == "headings" else held == {name}, (name, held)
    assert "html" not in page_signals.extract(fetches, [])._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    with pytest.raises(ValueError, match="nothing"):
        page_signals.extract(fetches, ["title", "nothing"])


class Raw(dict):
    """Tables that tell who asked for them."""

    def __init__(self, tables):
        super().__init__({k: self._of(k, v) for k, v in tables.items()})
        self.asked = set()

    def _of(self, name, table):
        def read():
            self.asked.add(name)
            return table

        return read


@pytest.fixture
def raw(spark, fetches):
    make = spark.createDataFrame
    chain = "array<struct<url:string,status:int>>"
    return Raw(
        {
            "fetches": fetches,
            "roots": make([("r", "a.example", {"Strict-Transport-Security": "max-age=1"})], "run_id string, site string, headers map<string,string>"),
            "chains": make([("r", "a.example", v, [(f"{s}://{h}/", 200)], f"{s}://{h}/") for v, s, h in (("httpRoot", "https", "a.example"), ("httpsRoot", "https", "a.example"), ("httpsWww", "https", "www.a.example"))], f"run_id string, site string, variant string, chain {chain}, final_url string"),
            "tls": make([("r", "a.example", "TLSv1.3", "Lets Encrypt", "2024-03-01T00:00:00Z", ["a.example"])], "run_id string, site string, protocol string, cert_issuer string, expiry_date string, sans array<string>"),
            "dns_records": make([("r", "a.example", "A", 0, "x.hetzner.de"), ("r", "a.example", "CNAME", 1, "lb.azure.net"), ("r", "a.example", "CNAME", 0, "c.fastly.net")], "run_id string, site string, rtype string, pos int, value string"),
            "lighthouse": make([("r", "a.example", '{"categories":{"performance":{"score":0.5}}}')], "run_id string, site string, full_json string"),
            "robots": make([("r", "a.example", 200, "User-agent: *")], "run_id string, site string, status int, body string"),
            "sitemap_urls": make([("r", "a.example", 1, "https://a.example/x"), ("r", "a.example", 2, "https://a.example/products/z")], "run_id string, site string, seq int, url string"),
        }
    )


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([("r", "a.example"), ("r", "b.example")], "run_id string, site string")


@pytest.mark.parametrize(
    "families, parts, asked",
    [
        (["html_signals"], {"pages"}, {"fetches"}),
        (["urlset"], {"url_set", "templates"}, {"fetches", "sitemap_urls"}),
        (["perf"], {"perf"}, {"lighthouse"}),
        (["security_headers"], {"site_wide"}, {"roots", "robots", "sitemap_urls"}),
        (["infra"], {"infra", "site_wide"}, {"chains", "tls", "dns_records", "robots", "sitemap_urls"}),
        (["schema", "links", "images"], {"schema", "links", "images"}, {"fetches"}),
    ],
)
def test_only_the_tables_asked_for_are_read(raw, sites, families, parts, asked):
    out = snapshot.extract(raw, sites, families)
    assert set(out) == parts and raw.asked == asked
    assert all(t.count() >= 1 for t in out.values())
    with pytest.raises(ValueError):
        snapshot.extract(raw, sites, ["no such"])


def test_site_row(raw, sites):
    moment = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    rows = {r["site"]: r.asDict(recursive=True) for r in snapshot.extract(raw, sites, ["infra", "urlset"], moment)["site_wide"].collect()}
    a, b = rows["a.example"], rows["b.example"]
    state = lambda s, v=None, r=None: {"state": s, "value": v, "reason": r}
    assert a["security_headers"] == {} and a["https_enforced"] == state("present", "true") and a["host_consistency"] == state("present", "false") and a["www_preference"] == state("unknown", r="Inconsistent www usage")
    assert (a["robots_valid"], a["sitemap_count"], a["total_urls"], a["unique_urls"], a["template_patterns"]) == (True, 1, 3, 3, ["/products/{slug}"])
    assert b["https_enforced"] == state("unknown", r="No redirect data") and (b["robots_valid"], b["sitemap_count"], b["total_urls"]) == (False, 0, 0)
    a = {r["site"]: r for r in snapshot.extract(raw, sites, ["security_headers"])["site_wide"].collect()}["a.example"].asDict(recursive=True)
    assert a["security_headers"]["strict-transport-security"] == state("present", "max-age=1") and a["https_enforced"] == state("unknown", r="Not extracted") and a["total_urls"] == 0


def test_infrastructure(raw, sites):
    moment = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    rows = {r["site"]: r.asDict(recursive=True) for r in snapshot.extract(raw, sites, ["infra"], moment)["infra"].collect()}
    a, b = rows["a.example"], rows["b.example"]
    # aliases first, then addresses; the last record that names one counts
    assert (a["cdn"], a["hosting"]) == ("Fastly", "Hetzner") and a["days_left"]["value"] == "29" and a["sans_include_domain"]["value"] == "true" and a["issuer"]["value"] == "Lets Encrypt"
    assert {b[c]["reason"] for c in ("days_left", "valid", "sans_include_domain", "issuer", "protocol")} == {"No TLS data"} and b["cdn"] is None
