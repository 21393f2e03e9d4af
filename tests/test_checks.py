"""The registry of checks: names, selection, totals, and what a plan holds."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import audit, checks, page_signals, site_facts

#: Audits and how many rules each has (fixed values); with the failure of an audit they are fifty.
SIZES = {"crawl": 8, "technical": 19, "security": 10, "performance": 12}
KINDS = {"critical", "warning", "info"}


def test_registry():
    assert {a: len(held) for a, held in checks.AUDITS.items()} == SIZES and len(checks.REGISTRY) == sum(SIZES.values())
    assert all(i.split(".")[0] == {"crawl": "crawl", "technical": "tech", "security": "sec", "performance": "perf"}[a] for i, (a, _) in checks.REGISTRY.items())
    assert {c.input for _, c in checks.REGISTRY.values() if isinstance(c, checks.Check)} <= set(checks.INPUTS)
    assert sorted(c.check_id for name in checks.INPUTS for c in checks.checks_of(name)) == sorted(checks.REGISTRY)


def test_names():
    asked, unknown = checks.resolve(["tech.lang", "crawl", "nothing", "tech.duplicate_title", "crawl"])
    assert list(asked) == ["crawl", "technical"] and len(asked["crawl"]) == 8 and asked["technical"] == ["tech.duplicate_title", "tech.lang"] and unknown == ["nothing"]
    assert {a: len(x) for a, x in checks.resolve()[0].items()} == SIZES


class Tables(dict):
    """Tables that tell who asked for them; one that a test does not give must not be read."""

    def __init__(self, **tables):
        self.tables, self.asked = tables, []

    def __getitem__(self, name):
        def read():
            self.asked.append(name)
            return self.tables[name]

        return read


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([("r", "a.example"), ("r", "b.example")], "run_id string, site string")


@pytest.fixture
def signals(spark):
    rows = [("r", "a.example", i, f"https://a.example/{i}", 200, h) for i, h in enumerate(["<title>Same</title>", "<title>same </title>", '<html lang="en"><title>other title that is long enough</title>'])]
    return page_signals.page_signals(spark.createDataFrame(rows, "run_id string, site string, crawl_seq long, url string, status int, html string"))


@pytest.fixture
def states(spark):
    roots = spark.createDataFrame([("r", "a.example", {"Content-Security-Policy": "x"}), ("r", "b.example", None)], "run_id string, site string, headers map<string,string>")
    return site_facts.security_headers(roots)


def test_only_what_is_asked_for_is_built(sites, signals, states):
    tables = Tables(signals=signals, header_states=states)
    found, totals = audit.run_checks(tables, sites, ["sec.hsts", "tech.lang", "sec.hsts"])
    assert sorted(set(tables.asked)) == ["header_states", "signals"] and len(tables.asked) == 2
    got = [(r["site"], r["ordinal"], r["audit"], r["check_id"]) for r in found.orderBy("site", "ordinal").collect()]
    assert got == [("a.example", 1, "technical", "tech.lang"), ("a.example", 2, "security", "sec.hsts"), ("b.example", 1, "security", "sec.hsts")]
    assert {(r["site"], tuple(r["completed"]), tuple(r["failed"]), r["total_findings"]) for r in totals.collect()} == {("a.example", ("sec.hsts", "tech.lang"), (), 2), ("b.example", ("sec.hsts", "tech.lang"), (), 1)}
    # no other rule over the same inputs is in the plans
    plan = "".join(t._jdf.queryExecution().optimizedPlan().toString() for held in checks.compile(tables, ["sec.hsts", "tech.lang"]).values() for t in held)
    assert "sec.csp" not in plan and "tech.viewport" not in plan and "duplicate" not in plan


def test_unknown_and_stopped_audits(spark, sites, signals, states):
    stopped = spark.createDataFrame([("r", "a.example", "technical", "timeout"), ("r", "b.example", "visual", "no image"), ("r", "b.example", "crawl", "not asked for")], "run_id string, site string, audit string, error string")
    found, totals = audit.run_checks(Tables(signals=signals, header_states=states), sites, ["tech.lang", "sec.csp", "visual", "made.up"], stopped)
    got = {(r["site"], r["check_id"], r["message"], r["evidence"]["detail"]) for r in found.collect()}
    # a rule audit that stops is a finding, a model audit is not, and its name is none of the rule audits'
    assert got == {("a.example", "audit.failed", "technical audit failed to complete", "timeout"), ("b.example", "sec.csp", "Missing Content-Security-Policy header", None)}
    assert {(r["site"], tuple(r["completed"]), tuple(r["failed"]), r["total_findings"]) for r in totals.collect()} == {
        ("a.example", ("sec.csp",), ("tech.lang", "visual", "made.up"), 1), ("b.example", ("tech.lang", "sec.csp"), ("visual", "made.up"), 1),
    }
    nothing, totals = audit.run_checks(Tables(), sites, ["visual"])
    assert nothing.count() == 0 and {(tuple(r["failed"]), r["total_findings"]) for r in totals.collect()} == {(("visual",), 0)}


def test_failed_model_audits_cost_nothing(spark):
    failed = spark.createDataFrame([("r", "s", a, "x") for a in ("visual", "serp", "crawl")], "run_id string, site string, audit string, error string")
    assert [r["audit"] for r in audit.failures(failed).collect()] == ["crawl"]


def test_brief_findings_are_those_in_full(sites, signals, states):
    tables = lambda: Tables(signals=signals, header_states=states)
    names = ["technical.nothing", "sec.hsts", "sec.other_headers", *(c.check_id for c in checks.TECHNICAL if c.check_id != "tech.broken_links")]
    whole, brief = (audit.united(checks.compile(tables(), names, b)).select("site", "check_id", "type", "severity") for b in (False, True))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, brief.collect())) and whole.count() > 8
    plan = brief._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    assert set(r["severity"] for r in brief.select("severity").distinct().collect()) <= KINDS


def test_every_rule_compiles(spark):
    """Each input's rules over an empty table with its columns."""
    empty = lambda schema: spark.createDataFrame([], f"run_id string, site string, {schema}")
    facts = {
        "robots": "s array<struct<pos:int,section:string,line:string>>, home boolean",
        "crawl": "refs long, found long, foreign long, foreign_urls array<struct<seq:int,url:string>>, long long, long_chain array<struct<url:string,status:int>>, host_conflict boolean, http_stays boolean, params long, param_urls array<struct<r:int,url:string>>",
        "headers": "m array<string>, rest array<string>", "hosts": "https_enforced boolean", "certificates": "days_floor long, cert_finding string, expiry_date string, weak_protocol boolean, protocol string", "well_known": "path string, status int",
        "exposure": "n long, types array<string>", "links": "n long, pages long, urls array<string>, samples array<struct<url:string,value:string>>",
    }
    for name, schema in facts.items():
        out = checks.apply(name, empty(schema))
        assert out.columns == ["run_id", "site", "check_id", "type", "severity", "n", "message", "affected_urls", "evidence"] and out.count() == 0
        assert checks.apply(name, empty(schema), brief=True).where(F.lit(True)).count() == 0
