"""Rule checks over page signals, and the algebra of findings: merge, dedupe, filter, rank, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text

KEY = ["run_id", "site"]
SEVERITIES = {"critical": 0, "warning": 1, "info": 2}
CATEGORIES = {"crawl": "crawl", "tech": "technical", "sec": "security", "perf": "performance", "visual": "visual", "serp": "serp"}


def severity_rank(c: Column) -> Column:
    """0 critical, 1 warning, 2 info; anything else 4."""
    out = F.lit(4)
    for name, rank in reversed(SEVERITIES.items()):
        out = F.when(c == name, rank).otherwise(out)
    return out


@dataclass(frozen=True)
class PageCheck:
    """A rule over pages: fires for a site when pages match. weight: what a page adds to the count; samples: URLs shown;
    shown: pages in the evidence, with value (SQL text) beside the URL; most: whether the largest value is told."""

    check_id: str
    type: str
    severity: str
    matches: str
    message: str
    samples: int = 20
    weight: str | None = None
    shown: int = 10
    value: str | None = None
    most: bool = False


TITLE_MAX, TITLE_MIN, DESCRIPTION_MAX = 60, 30, 155


IS_PRODUCT = "(contains(url, '/product') or contains(url, '/item') or contains(url, '/p/'))"
NO_H2 = "(h3_count > 0 and h2_count = 0)"
NO_H3 = "(h4_count > 0 and h3_count = 0)"
ISSUES = f"concat_ws(', ', case when {NO_H2} then 'H3 without H2' end, case when {NO_H3} then 'H4 without H3' end)"
#: Columns of page signals that the rules read.
READ = ["run_id", "site", "crawl_seq", "url", "title", "title_length", "meta_description", "meta_description_length", "canonical", "canonical_self", "h1_count", "h2_count", "h3_count", "h4_count",
        "has_product_schema", "invalid_schema_count", "mixed_content", "has_viewport", "has_charset", "has_lang"]


def page_checks() -> list[PageCheck]:
    """The page rules, predicates as SQL text over page signals. ``%d`` in a message is the count. Messages, limits and caps are fixed values."""
    return [
        PageCheck("tech.missing_title", "tech_missing_title", "critical", "title is null", "%d pages are missing title tags"),
        PageCheck("tech.title_long", "tech_title_too_long", "info", f"title_length > {TITLE_MAX}", f"%d pages have titles longer than {TITLE_MAX} characters", 10, None, 5, "title_length", True),
        PageCheck("tech.title_short", "tech_title_too_short", "info", f"title is not null and title_length < {TITLE_MIN}", f"%d pages have titles shorter than {TITLE_MIN} characters", 10, None, 5, "title_length"),
        PageCheck("tech.missing_desc", "tech_missing_meta_desc", "warning", "meta_description is null", "%d pages are missing meta descriptions"),
        PageCheck("tech.desc_long", "tech_meta_desc_too_long", "info", f"meta_description_length > {DESCRIPTION_MAX}", f"%d pages have meta descriptions longer than {DESCRIPTION_MAX} characters", 10, None, 0, "meta_description_length", True),
        PageCheck("tech.missing_h1", "tech_missing_h1", "warning", "h1_count = 0", "%d pages are missing H1 tags"),
        PageCheck("tech.multiple_h1", "tech_multiple_h1", "info", "h1_count > 1", "%d pages have multiple H1 tags", 10, None, 5, "h1_count", True),
        PageCheck("tech.heading_hierarchy", "tech_missing_h1", "info", f"{NO_H2} or {NO_H3}", "%d pages have heading hierarchy issues", 10, f"cast({NO_H2} as bigint) + cast({NO_H3} as bigint)", 5, ISSUES),
        PageCheck("tech.missing_canonical", "tech_missing_canonical", "warning", "canonical is null", "%d pages are missing canonical tags"),
        PageCheck("tech.canonical_mismatch", "tech_canonical_mismatch", "info", "canonical is not null and not canonical_self", "%d pages have non-self-referencing canonicals", 10, None, 5, "canonical"),
        PageCheck("tech.product_schema", "tech_missing_viewport", "warning", f"{IS_PRODUCT} and not has_product_schema", "%d product pages missing Product schema markup", 10, None, 5),
        PageCheck("tech.schema_invalid", "tech_missing_viewport", "info", "invalid_schema_count > 0", "%d pages have schema validation errors", 10, None, 3, "invalid_schema_count"),
        PageCheck("tech.mixed_content", "sec_mixed_content", "critical", "mixed_content", "%d pages have mixed content (HTTP assets on HTTPS pages)"),
        PageCheck("tech.viewport", "tech_missing_viewport", "warning", "not has_viewport", "%d pages are missing viewport meta tag"),
        PageCheck("tech.charset", "tech_missing_charset", "info", "not has_charset", "%d pages are missing charset declaration", 10),
        PageCheck("tech.lang", "tech_missing_lang", "info", "not has_lang", "%d pages are missing lang attribute", 10),
    ]


def run_page_checks(signals: DataFrame, only: list[str] | None = None, brief: bool = False) -> DataFrame:
    """run_id, site, check_id, type, severity, n, message, affected_urls, evidence of the page rules that fire; ``brief``: without the last three.

    ``only``: check ids; the others never enter the plan, unknown ones raise.  One pass: each
    page gives a row for each rule it breaks, counted by site; URL lists are the first ones by
    crawl order, never a whole group.
    """
    checks = page_checks()
    if only is not None:
        if unknown := set(only) - {c.check_id for c in checks}:
            raise ValueError(f"unknown checks: {sorted(unknown)}")
        checks = [c for c in checks if c.check_id in only]
    broken = F.array_compact(F.array(*(F.when(F.expr(c.matches), F.struct(F.lit(i).alias("i"), F.expr(c.weight or "1").cast("long").alias("w"), F.expr(c.value or "null").cast("string").alias("value"))) for i, c in enumerate(checks))))
    at = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("i") + 1)
    named = [at([c.check_id for c in checks]).alias("check_id"), at([c.type for c in checks]).alias("type"), at([c.severity for c in checks]).alias("severity")]
    rows = signals.select(*KEY, "crawl_seq", "url", F.explode(broken).alias("b")).select(*KEY, "crawl_seq", "url", "b.i", "b.w", "b.value")
    if brief:
        return rows.groupBy(*KEY, "i").agg(F.sum("w").alias("n")).select(*KEY, *named, "n")
    most = max(c.samples for c in checks)
    place = F.row_number().over(Window.partitionBy(*KEY, "i").orderBy("crawl_seq", "url"))
    urls = rows.withColumn("r", place).where(F.col("r") <= most).groupBy(*KEY, "i").agg(F.array_sort(F.collect_list(F.struct("r", "url", "value"))).alias("u"))
    counts = rows.groupBy(*KEY, "i").agg(F.sum("w").alias("n"), F.max(F.col("value").try_cast("long")).alias("most"))
    out = counts.join(urls, [*KEY, "i"])
    return out.select(
        *KEY,
        *named,
        "n",
        F.replace(at([c.message for c in checks]), F.lit("%d"), F.col("n").cast("string")).alias("message"),
        F.slice("u.url", F.lit(1), at([c.samples for c in checks])).alias("affected_urls"),
        evidence(F.col("n"), F.transform(F.slice("u", F.lit(1), at([c.shown for c in checks])), lambda x: sample(x["url"], x["value"])), F.when(at([c.most for c in checks]), F.col("most").cast("string"))).alias("evidence"),
    )


def sample(url: Column, value: Column | None = None) -> Column:
    return F.struct(url.alias("url"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def evidence(count: Column | None = None, samples: Column | None = None, detail: Column | None = None, facts: dict[str, Column] | None = None) -> Column:
    """What a finding rests on: how many pages or rows, the first of them (url, value), a detail, and named facts (of model answers)."""
    none = F.lit(None)
    named = F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v.cast("string")))) if facts else none.cast("map<string,string>")
    return F.struct(
        (none if count is None else count).cast("long").alias("affected_count"),
        (F.array() if samples is None else samples).cast("array<struct<url:string,value:string>>").alias("samples"),
        (none if detail is None else detail).cast("string").alias("detail"),
        named.alias("facts"),
    )


def duplicate_facts(signals: DataFrame, column: str, shown: int = 60, brief: bool = False) -> DataFrame:
    """Pages of a site that share a value (lower case, trimmed) in groups of two or more: n pages, groups, the first URLs group by group (20),
    and as samples the first five groups, each with its first three URLs, its value (``shown`` characters) and its size; ``brief``: the counts only."""
    rows = signals.where(F.col(column).isNotNull()).select(*KEY, "crawl_seq", "url", text.trim(F.lower(column)).alias("v"))
    groups = rows.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("pages"), F.min("crawl_seq").alias("first")).where("pages > 1")
    totals = groups.groupBy(*KEY).agg(F.count(F.lit(1)).alias("groups"), F.sum("pages").alias("n"))
    if brief:
        return totals
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("first", "v", "crawl_seq", "url"))
    urls = rows.join(groups, [*KEY, "v"]).withColumn("r", place).where("r <= 20").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("u"))
    some = groups.withColumn("g", F.row_number().over(Window.partitionBy(*KEY).orderBy("first", "v"))).where("g <= 5")
    inside = F.row_number().over(Window.partitionBy(*KEY, "v").orderBy("crawl_seq", "url"))
    three = rows.join(some, [*KEY, "v"]).withColumn("r", inside).where("r <= 3").groupBy(*KEY, "g", "v", "pages").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("u"))
    entry = sample(F.array_join("u.url", " "), F.concat(F.substring("v", 1, shown), F.lit(" x"), F.col("pages").cast("string")))
    seen = three.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", entry.alias("e")))), lambda x: x["e"]).alias("samples"))
    return totals.join(urls, KEY).join(seen, KEY).select(*KEY, "n", "groups", F.col("u.url").alias("urls"), "samples")


def broken_link_facts(broken: DataFrame, brief: bool = False) -> DataFrame:
    """Per site with broken internal links: n targets, pages that hold them, the first targets by crawl order (20), ten of them as samples with how many pages link to them; ``brief``: the counts only."""
    if brief:
        return broken.groupBy(*KEY).agg(F.count_distinct("link_url").alias("n"), F.count_distinct("url").alias("pages"))
    targets = broken.groupBy(*KEY, "link_url").agg(F.min(F.struct("crawl_seq", "pos")).alias("first"), F.count_distinct("url").alias("from"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("first", "link_url"))
    shown = targets.withColumn("r", place).where("r <= 20").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "link_url", "from"))).alias("u"))
    totals = broken.groupBy(*KEY).agg(F.count_distinct("link_url").alias("n"), F.count_distinct("url").alias("pages"))
    samples = F.transform(F.slice("u", 1, 10), lambda x: sample(x["link_url"], x["from"]))
    return totals.join(shown, KEY).select(*KEY, "n", "pages", F.col("u.link_url").alias("urls"), samples.alias("samples"))


def category(type_: Column) -> Column:
    """A finding's category, from its type's prefix."""
    prefix = F.substring_index(type_, "_", 1)
    out = prefix
    for short, name in CATEGORIES.items():
        out = F.when(prefix == short, name).otherwise(out)
    return out


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding for each type and set of URLs in a run: the first by ordinal."""
    key = F.array_join(F.array_sort(F.coalesce("affected_urls", F.array().cast("array<string>"))), ",")
    first = F.row_number().over(Window.partitionBy(*KEY, "type", "__k").orderBy("ordinal", "check_id"))
    return findings.withColumn("__k", key).withColumn("__r", first).where("__r = 1").drop("__k", "__r")


def of_category(findings: DataFrame, name: str) -> DataFrame:
    """Findings of one category."""
    return findings.where(category(F.col("type")) == name)


def is_deterministic(type_: Column) -> Column:
    """Whether a finding comes from a rule rather than from a model, by its type's prefix."""
    return type_.rlike("^(crawl|tech|sec|perf)_")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) <= SEVERITIES[severity])


def ranked(findings: DataFrame) -> DataFrame:
    """Adds rank: by severity, then ordinal, within a site."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(severity_rank(F.col("severity")), "ordinal", "check_id")))


def summary(findings: DataFrame) -> DataFrame:
    """Counts of a site in all, by type and by severity (null: not grouped by it)."""
    sets = [[*(F.col(k) for k in KEY)], [*(F.col(k) for k in KEY), F.col("type")], [*(F.col(k) for k in KEY), F.col("severity")]]
    return findings.groupingSets(sets, *KEY, "type", "severity").agg(F.count(F.lit(1)).alias("n"))


def scorecard(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """score = 100 - 15 a critical - 5 a warning, at least 0, with grade and urgency; sites without findings score 100."""
    counts = findings.groupBy(*KEY).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    df = sites.select(*KEY).distinct().join(counts, KEY, "left").fillna(0, list(SEVERITIES))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("critical") - 5 * F.col("warning"))).cast("int")
    df = df.withColumn("score", score)
    s = F.col("score")
    grade = F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")
    urgency = F.when(F.col("critical") > 0, "immediate").when(F.col("warning") > 5, "high").otherwise("medium")
    return df.withColumns({"grade": grade, "urgency": urgency})


def category_scores(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """100 - 20 a critical - 10 a warning for each site and category, at least 0; a category without findings scores 100."""
    names = F.array(*(F.lit(c) for c in CATEGORIES.values()))
    spine = sites.select(*KEY).distinct().select(*KEY, F.explode(names).alias("category"))
    counts = findings.groupBy(*KEY, category(F.col("type")).alias("category")).agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"), F.count(F.lit(1)).alias("findings"))
    df = spine.join(counts, [*KEY, "category"], "left").fillna(0, ["c", "w", "findings"])
    score = F.greatest(F.lit(0), 100 - 20 * F.col("c") - 10 * F.col("w")).cast("int")
    return df.select(*KEY, "category", "findings", score.alias("score"))


def failed_runs(report: DataFrame) -> DataFrame:
    return report.where("score = 0")
