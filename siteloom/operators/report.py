"""Reports: from model answers, from findings where no answer can be used, and for runs that failed; their flat, text and JSON forms; run quality.

Every report is one row: run_id, site, score, grade, headline, overview, key_strengths, key_issues, urgency, ``priorities`` (rank, title,
description, impact, effort) and ``categories`` (name, score, findings of type, severity and message, summary; six, in the order of ``CATEGORIES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.findings import CATEGORIES, category, category_scores

KEY = ["run_id", "site"]
NAMES = list(CATEGORIES.values())
#: Names of categories in flat rows that differ, and the filters of the results page (fixed values).
RENAMED = {"security": "technical", "crawl": "seo"}
FILTERS = ["all", "seo", "technical", "design", "conversion", "content"]
PRIORITIES = "array<struct<rank:int,title:string,description:string,impact:string,effort:string>>"
FINDINGS = "array<struct<type:string,severity:string,message:string>>"
GROUPS = f"array<struct<name:string,score:double,findings:{FINDINGS},summary:string>>"
#: What a model's answer holds (fixed names).
ANSWER = (
    "struct<executiveSummary:struct<score:double,grade:string,headline:string,overview:string,keyStrengths:array<string>,keyIssues:array<string>,urgency:string>,"
    f"priorities:{PRIORITIES},findingsByCategory:{GROUPS},actionPlan:struct<immediate:array<string>,shortTerm:array<string>,longTerm:array<string>>,limitations:array<string>>"
)


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Adds r, the answer (column text) as a struct; null where it is no JSON or lacks its summary, priorities or categories."""
    r = F.from_json("text", ANSWER)
    df = answers.withColumn("r", r)
    return df.withColumn("r", F.when(F.col("r.executiveSummary").isNotNull() & F.col("r.priorities").isNotNull() & F.col("r.findingsByCategory").isNotNull(), F.col("r")))


def from_answers(answers: DataFrame) -> DataFrame:
    """Reports of the answers that can be used; the others have no row, and their sites get a ``fallback_report``.

    Of several entries for a category, in whatever spelling, the first counts; one without an entry scores 100 with no findings.
    """
    usable = parsed_answers(answers).where("r is not null")
    none = F.array().cast(FINDINGS)

    def entry(name: str) -> Column:
        own = F.try_element_at(F.filter("r.findingsByCategory", lambda c: F.lower(c["name"]) == name), F.lit(1))
        missing = F.struct(F.lit(name).alias("name"), F.lit(100.0).alias("score"), none.alias("findings"), F.lit(f"No {name} issues detected.").alias("summary"))
        return F.when(own.isNull(), missing).otherwise(F.struct(F.lit(name).alias("name"), own["score"].alias("score"), F.coalesce(own["findings"], none).alias("findings"), own["summary"].alias("summary")))

    s = "r.executiveSummary"
    return usable.select(
        *KEY, F.col(f"{s}.score").alias("score"), F.col(f"{s}.grade").alias("grade"), F.col(f"{s}.headline").alias("headline"), F.col(f"{s}.overview").alias("overview"),
        F.col(f"{s}.keyStrengths").alias("key_strengths"), F.col(f"{s}.keyIssues").alias("key_issues"), F.col(f"{s}.urgency").alias("urgency"), F.col("r.priorities").alias("priorities"), F.array(*map(entry, NAMES)).alias("categories"),
    )


def priorities(findings: DataFrame, most: int = 10) -> DataFrame:
    """The first critical and warning findings of each site, in their order, with impact and effort."""
    chosen = findings.where(F.col("severity").isin("critical", "warning"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("ordinal", "check_id"))
    rows = chosen.withColumn("rank", rank).where(F.col("rank") <= most)
    return rows.select(*KEY, "rank", F.col("type").alias("title"), F.col("message").alias("description"), F.when(F.col("severity") == "critical", "high").otherwise("medium").alias("impact"), F.lit("medium").alias("effort"))


def fallback_report(findings: DataFrame, scores: DataFrame, listed: bool = True) -> DataFrame:
    """The report of a site without a usable answer: its scores, the first five critical or warning messages, ten priorities, all findings by category.

    Without ``listed`` the categories hold their scores and summaries, and no findings: ``fallback_rows`` has those as rows.
    """
    first = priorities(findings).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "title", "description", "impact", "effort"))).alias("priorities"))
    rows = findings.select(*KEY, category(F.col("type")).alias("name"), F.struct("ordinal", "type", "severity", "message").alias("f"))
    per = rows.groupBy(*KEY, "name").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: F.struct(x["type"].alias("type"), x["severity"].alias("severity"), x["message"].alias("message"))).alias("findings"))
    scored = category_scores(findings, scores).select(*KEY, F.col("category").alias("name"), F.col("findings").alias("n"), F.col("score").cast("double").alias("score"))
    summary = F.concat(F.col("n").cast("string"), F.lit(" findings in "), F.col("name"), F.lit(" category."))
    places = F.array_position(F.array(*map(F.lit, NAMES)), F.col("name"))
    scored = scored.join(per, [*KEY, "name"], "left") if listed else scored.withColumn("findings", F.lit(None).cast(FINDINGS))
    held = scored.select(*KEY, F.struct(places.alias("at"), "name", "score", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"), summary.alias("summary")).alias("c"))
    kept = lambda x: F.struct(*(x[f].alias(f) for f in ("name", "score", "findings", "summary")))
    groups = held.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list("c")), kept).alias("categories"))
    totals = findings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    df = scores.join(totals, KEY, "left").join(first, KEY, "left").join(groups, KEY)
    top = F.coalesce("priorities", F.array().cast(PRIORITIES))
    # texts are fixed values
    overview = F.concat(F.lit("Audit completed with "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" findings. Note: Report synthesis encountered an issue, displaying raw findings."))
    return df.select(
        *KEY, F.col("score").cast("double").alias("score"), "grade", F.lit("SEO Audit Report").alias("headline"), overview.alias("overview"), F.array(F.lit("Audit completed successfully")).alias("key_strengths"),
        F.transform(F.slice(top, 1, 5), lambda p: p["description"]).alias("key_issues"), "urgency", top.alias("priorities"), "categories",
    )


def failed_report(sites: DataFrame, signals: DataFrame, error: str) -> DataFrame:
    """Reports of sites without signals: score 0, grade F, the error named, every category at zero; with fetch_errors, and the private flag and note of a failed run.  Texts are fixed values."""
    missing = sites.select(*KEY).distinct().join(signals.select(*KEY).distinct(), KEY, "left_anti")
    retry = F.struct(F.lit(1).alias("rank"), F.lit("Retry Audit").alias("title"), F.lit("The audit encountered an error. Please try again.").alias("description"), F.lit("high").alias("impact"), F.lit("low").alias("effort"))
    shown = {"serp": "SERP"}
    empty = [F.struct(F.lit(n).alias("name"), F.lit(0.0).alias("score"), F.array().cast(FINDINGS).alias("findings"), F.lit(f"Audit failed - no {shown.get(n, n)} data available.").alias("summary")) for n in NAMES]
    return missing.select(
        *KEY, F.lit(0.0).alias("score"), F.lit("F").alias("grade"), F.lit("Audit Failed").alias("headline"), F.lit(f"The audit could not be completed due to an error: {error}").alias("overview"), F.array().cast("array<string>").alias("key_strengths"),
        F.array(F.lit("Audit failed to complete")).alias("key_issues"), F.lit("immediate").alias("urgency"), F.array(retry).alias("priorities"), F.array(*empty).alias("categories"),
        F.array(F.concat("site", F.lit(f": {error}"))).alias("fetch_errors"), F.lit("tool_failure").alias("flag"), F.lit("low").alias("quality"), F.lit(0.0).alias("confidence"), F.array(F.lit("Complete pipeline failure - manual review required")).alias("notes"),
    )


def _told(impact: Column) -> Column:
    return F.when(impact == "high", "High").when(impact == "medium", "Medium").otherwise("Low")


def _grave(severity: Column) -> Column:
    return F.when(severity == "critical", "High").when(severity == "warning", "Medium").otherwise("Low")


def _renamed(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RENAMED.items() for x in kv)), name), name)


def _titled(c: Column) -> Column:
    """Underscores to blanks, and the first letter of each word in capitals; other letters stay."""
    words = F.split(F.replace(c, F.lit("_"), F.lit(" ")), r"\b")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def flat_rows(reports: DataFrame) -> DataFrame:
    """A report's list of findings: run_id, site, position, id, category, title, description, impact, priority, fix.

    Priorities come first, as findings of the category seo with their own titles and ranks; then the findings of each
    category, whose priority is the category's number.
    """
    row = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    top = F.transform(
        F.col("priorities"),
        lambda p, i: row(id=F.concat(F.lit("priority-"), i.cast("string")), category=F.lit("seo"), title=p["title"], description=p["description"], impact=_told(p["impact"]), priority=p["rank"], fix=p["description"]),
    )

    def of(c: Column, k: Column) -> Column:
        return F.transform(
            c["findings"],
            lambda f, i: row(
                id=F.concat(c["name"], F.lit("-"), i.cast("string")), category=_renamed(c["name"]), title=_titled(f["type"]), description=f["message"], impact=_grave(f["severity"]),
                priority=(k + 1).cast("int"), fix=f["message"],
            ),
        )

    rows = F.concat(top, F.flatten(F.transform("categories", of)))
    return reports.select(*KEY, F.posexplode(rows).alias("i", "f")).select(*KEY, (F.col("i") + 1).alias("position"), "f.*")


def fallback_rows(findings: DataFrame) -> DataFrame:
    """``flat_rows`` of the fallback reports of all sites, straight from their findings: no site's findings are gathered in one row.

    A finding is numbered inside its category, and placed after the priorities and the categories before its own by their counts.
    """
    own = [*KEY, "position", "id", "category", "title", "description", "impact", "priority", "fix"]
    first = priorities(findings)
    name, k = category(F.col("type")), F.array_position(F.array(*map(F.lit, NAMES)), F.col("name")).cast("int")
    named = findings.select(*KEY, "ordinal", "type", "severity", "message", name.alias("name")).withColumn("k", k).where("k > 0")
    counts = first.select(*KEY, F.lit(0).alias("k")).unionByName(named.select(*KEY, "k")).groupBy(*KEY, "k").agg(F.count(F.lit(1)).alias("n"))
    # seven rows a site at most
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*KEY, "k", F.coalesce(before, F.lit(0)).alias("before"))
    i = F.row_number().over(Window.partitionBy(*KEY, "k").orderBy("ordinal")) - 1
    rows = named.withColumn("i", i).join(starts, [*KEY, "k"])
    top = first.withColumns(
        {"position": F.col("rank"), "id": F.concat(F.lit("priority-"), (F.col("rank") - 1).cast("string")), "category": F.lit("seo"), "impact": _told(F.col("impact")), "priority": F.col("rank"), "fix": F.col("description")}
    )
    rest = rows.withColumns(
        {
            "position": (F.col("before") + F.col("i") + 1).cast("int"), "id": F.concat("name", F.lit("-"), F.col("i").cast("string")), "category": _renamed(F.col("name")), "title": _titled(F.col("type")),
            "description": F.col("message"), "impact": _grave(F.col("severity")), "priority": F.col("k"), "fix": F.col("message"),
        }
    )
    return top.select(*own).unionByName(rest.select(*own))


def dashboard(flat: DataFrame, wanted: str = "all") -> DataFrame:
    """The rows that a filter of the results page shows, with their place: by priority, then as the report has them."""
    if wanted not in FILTERS:
        raise ValueError(f"unknown filter: {wanted}")
    shown = flat if wanted == "all" else flat.where(F.col("category") == wanted)
    return shown.withColumn("shown_at", F.row_number().over(Window.partitionBy(*KEY).orderBy("priority", "position")))


def dashboard_counts(flat: DataFrame) -> DataFrame:
    """How many rows each filter of the results page shows."""
    cells = F.array(F.lit("all"), F.when(F.col("category").isin(*FILTERS[1:]), F.col("category")))
    return flat.select(*KEY, F.explode(F.array_compact(cells)).alias("filter")).groupBy(*KEY, "filter").agg(F.count(F.lit(1)).alias("n"))


def front_reports(reports: DataFrame, runs: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """Reports in the shape that the results page takes: run_id, site, overallScore, url, summary, designAnalysis, findings, generatedAt.

    runs: run_id, site, url, generated_at (timestamp); flat: the reports' ``flat_rows``, where they are at hand.  The visual category stands for the design; where there is none its score is 80.
    """
    visual = F.try_element_at(F.filter("categories", lambda c: c["name"] == "visual"), F.lit(1))
    design = F.struct(
        F.coalesce(visual["score"], F.lit(80.0)).alias("aestheticScore"), F.lit("N/A").alias("pricePointMatch"), F.coalesce(visual["summary"], F.lit("Visual analysis not available")).alias("critique")
    )
    own = ["id", "category", "title", "description", "impact", "priority", "fix"]
    lists = (flat_rows(reports) if flat is None else flat).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", *own))), lambda x: F.struct(*(x[c].alias(c) for c in own))).alias("findings"))
    kind = dict(lists.dtypes)["findings"]
    df = reports.select(*KEY, F.col("score").alias("overallScore"), F.col("overview").alias("summary"), design.alias("designAnalysis")).join(lists, KEY, "left").join(runs, KEY)
    when = F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(*KEY, "overallScore", "url", "summary", "designAnalysis", F.coalesce("findings", F.array().cast(kind)).alias("findings"), when.alias("generatedAt"))


def _whole(c: Column) -> Column:
    """A number as scripts write it: no decimals where there are none."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def text_report(front: DataFrame) -> DataFrame:
    """One text for each of ``front_reports``: target, date, score, summary, design, and a block a finding.  Texts are fixed values."""
    when = F.date_format(F.to_timestamp("generatedAt", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "M/d/yyyy, h:mm:ss a")
    d = F.col("designAnalysis")
    head = F.concat_ws(
        "\n", F.lit("# AUDIT REPORT"), F.concat(F.lit("Target: "), "url"), F.concat(F.lit("Date: "), when), F.concat(F.lit("Overall Score: "), _whole(F.col("overallScore")), F.lit("/100")), F.lit("\n## EXECUTIVE SUMMARY"), "summary",
        F.lit("\n## DESIGN INTELLIGENCE"), F.concat(F.lit("Aesthetic Score: "), _whole(d["aestheticScore"]), F.lit("/100")), F.concat(F.lit("Price Point Alignment: "), d["pricePointMatch"]), F.concat(F.lit("Critique: "), d["critique"]),
        F.lit("\n## FINDINGS LOG"),
    )
    block = lambda f: F.concat(
        F.lit("\n["), F.upper(f["impact"]), F.lit("] "), f["title"], F.lit(" ("), F.upper(f["category"]), F.lit(")\nPriority: "), f["priority"].cast("string"), F.lit("\nLocation: General\nURL: "), F.col("url"),
        F.lit("\nIssue: "), f["description"], F.lit("\nFix: "), f["fix"], F.lit("\n----------------------------------------"),
    )
    return front.select(*KEY, F.array_join(F.concat(F.array(head), F.transform("findings", block)), "\n").alias("report"))


def envelopes(reports: DataFrame, traces: DataFrame, metadata: DataFrame) -> DataFrame:
    """run_id, site, value: one JSON object a run and site, of its report, its run's traces in order and its run's metadata."""
    own = [c for c in traces.columns if c != "run_id"]
    runs = traces.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("trace_index", *[c for c in own if c != "trace_index"]))).alias("traces"))
    meta = metadata.select("run_id", F.struct(*[c for c in metadata.columns if c != "run_id"]).alias("metadata"))
    report = F.struct(*[c for c in reports.columns if c not in KEY]).alias("report")
    df = reports.select(*KEY, report).join(runs, "run_id", "left").join(meta, "run_id", "left")
    return df.select(*KEY, F.to_json(F.struct(*KEY, "report", F.coalesce("traces", F.array().cast(dict(runs.dtypes)["traces"])).alias("traces"), "metadata")).alias("value"))


def data_quality(envelopes: DataFrame) -> DataFrame:
    """envelopes: a row for each collector with ``ok``; at least four fifths good is high, half medium."""
    per = envelopes.groupBy(*KEY).agg(F.avg(F.col("ok").cast("double")).alias("share"))
    return per.withColumn("quality", F.when(F.col("share") >= 0.8, "high").when(F.col("share") >= 0.5, "medium").otherwise("low"))


def confidence(sampled: Column, total: Column, errors: Column, findings: Column) -> Column:
    """1 less a tenth each for partial coverage and more than fifty findings, and a share of fetch errors; between 0 and 1."""
    score = F.lit(1.0) - F.when(sampled < total, 0.1).otherwise(0.0) - F.when(errors > 0, 0.1 * F.least(errors / 10, F.lit(0.3))).otherwise(0.0) - F.when(findings > 50, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def reviewer_notes(sampled: Column, total: Column, errors: Column, findings: Column) -> Column:
    """Notes of a run; texts are fixed values."""
    return F.array_compact(F.array(
        F.when(sampled < total, F.format_string("Sampled %d of %d pages", sampled, total)), F.when(errors > 0, F.format_string("%d URLs failed to fetch", errors)),
        F.when(findings > 30, F.lit("High finding count - verify data quality"))))


def security_score(https_present: Column, missing_headers: Column, mixed: Column) -> Column:
    """100 - 30 without enforced https - 10 for each of three headers missing - 20 with mixed content, at least 0."""
    return F.greatest(F.lit(0), 100 - F.when(https_present, 0).otherwise(30) - 10 * missing_headers - F.when(mixed, 20).otherwise(0)).cast("int")
