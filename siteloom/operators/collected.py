"""Readers of collected documents: page-speed JSON, robots and sitemaps, scan logs, model answers, traces, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import redact
from siteloom.functions.text import trim
from siteloom.operators.findings import evidence
from siteloom.sources.scratch import RECURSIVE, keep

KEY = ["run_id", "site"]
#: Metrics of the page-speed JSON by audit id (fixed values).
METRICS = {"lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt": "total-blocking-time", "fid": "max-potential-fid", "inp": "experimental-interaction-to-next-paint",
           "fcp": "first-contentful-paint", "ttfb": "server-response-time", "speed_index": "speed-index"}
#: Good and poor limits (fixed values): LCP, CLS, TBT, FCP, TTFB.
LIMITS = {"lcp": (2500.0, 4000.0), "cls": (0.1, 0.25), "tbt": (200.0, 600.0), "fcp": (1800.0, 3000.0), "ttfb": (800.0, 1800.0)}
#: Audits that name savings, with their labels (fixed values).
OPPORTUNITIES = {"uses-responsive-images": "responsive images", "uses-optimized-images": "optimized images", "uses-webp-images": "WebP images", "uses-text-compression": "text compression", "uses-http2": "HTTP/2",
                 "efficiently-encode-images": "efficient image encoding", "unminified-css": "minified CSS", "unminified-javascript": "minified JavaScript", "unused-css-rules": "unused CSS",
                 "unused-javascript": "unused JavaScript", "modern-image-formats": "modern image formats", "offscreen-images": "lazy-loaded images"}
#: Audits listed as opportunities and as diagnostics where they score below one, and scored categories (fixed values).
LISTED = ["unused-css-rules", "unused-javascript", "modern-image-formats", "efficiently-encode-images", "render-blocking-resources", "unminified-css", "unminified-javascript"]
DIAGNOSTICS = ["mainthread-work-breakdown", "bootup-time", "uses-long-cache-ttl", "total-byte-weight", "dom-size"]
SCORED = {"score": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo", "pwa": "pwa"}
#: robots.txt lines that close a section (fixed values).
ROBOTS = {"home": r"^\s*disallow:\s*/?\s*$", "products": r"disallow:\s*/?products", "collections": r"disallow:\s*/?collections", "blog": r"disallow:\s*/?blog", "shop": r"disallow:\s*/?shop"}
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
#: Price of a thousand tokens in and out (fixed values); any other model has the default.
PRICES = {"gemini-2.5-flash": (0.000075, 0.0003), "gemini-2.5-flash-lite": (0.000038, 0.00015), "gemini-2.5-pro": (0.00125, 0.005), "gpt-4o": (0.0025, 0.01),
          "gpt-4o-mini": (0.00015, 0.0006), "gpt-4-turbo": (0.01, 0.03), "gpt-3.5-turbo": (0.0005, 0.0015)}
DEFAULT_PRICE = (0.00025, 0.001)
#: What model answers say and what it stands for (fixed values).
VISUAL_TYPES = {"visual_hierarchy": "visual_mobile_unfriendly", "cta": "visual_viewport_issues", "trust": "visual_text_too_small", "ux_friction": "visual_elements_too_close", "mobile": "visual_mobile_unfriendly"}
VISUAL_SEVERITIES = {"critical": "critical", "warning": "warning", "info": "info", "high": "warning", "medium": "warning", "low": "info"}


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimal places, rounded from its exact binary value."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit(""))


def lookup(c: Column, names: dict, default: str | None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit(""))), F.lit(default))


def _number(audit: str, field: str = "numericValue") -> Column:
    return F.try_variant_get("v", f"$.audits['{audit}'].{field}", "double")


def lighthouse(rows: DataFrame) -> DataFrame:
    """Adds the parsed JSON (v), metrics (a missing number is read from the shown text), the performance score, and resource totals; bad JSON gives nulls."""
    df = rows.withColumn("v", F.try_parse_json("full_json"))
    shown = lambda a: F.regexp_extract(F.try_variant_get("v", f"$.audits['{a}'].displayValue", "string"), r"[\d.]+", 0).try_cast("double")
    df = df.withColumns({n: F.coalesce(_number(a), shown(a)) for n, a in METRICS.items()})
    items = F.try_variant_get("v", "$.audits['resource-summary'].details.items", "array<struct<resourceType:string,requestCount:double,transferSize:double>>")
    df = df.withColumn("items", items)
    total = lambda field, kind=None: F.aggregate(F.filter("items", lambda x: F.lit(True) if kind is None else x["resourceType"] == kind), F.lit(0.0), lambda s, x: s + F.coalesce(x[field], F.lit(0.0)))
    some = lambda c: F.nullif(c, F.lit(0.0))
    weight = some(total("transferSize"))
    return df.withColumns(
        {
            **{n: F.floor(F.try_variant_get("v", f"$.categories['{c}'].score", "double") * 100 + 0.5).cast("int") for n, c in SCORED.items()},
            "page_weight": weight, "page_weight_kb": F.floor(weight / 1024 + 0.5), "requests": some(total("requestCount")), "script_requests": some(total("requestCount", "script")),
            "style_requests": some(total("requestCount", "stylesheet")), "image_requests": some(total("requestCount", "image")),
        }
    ).drop("items")


def rating(metric: str) -> Column:
    good, poor = LIMITS[metric]
    c = F.col(metric)
    return F.when(c.isNull(), "unknown").when(c <= good, "good").when(c <= poor, "needs-improvement").otherwise("poor")


def ratings(metrics: DataFrame) -> DataFrame:
    """Adds a rating of each limited metric, the worst known one, core vitals passed, and the metric that exceeds its limit the most."""
    df = metrics.withColumns({f"{m}_rating": rating(m) for m in LIMITS})
    rank = lambda m: F.when(F.col(f"{m}_rating") == "poor", 3).when(F.col(f"{m}_rating") == "needs-improvement", 2).when(F.col(f"{m}_rating") == "good", 1).otherwise(0)
    worst = F.greatest(*(rank(m) for m in LIMITS))
    over = F.array_compact(F.array(*(F.when(F.col(m).isNotNull(), F.struct((F.col(m) / LIMITS[m][0]).alias("r"), F.lit(-i).alias("i"), F.lit(m).alias("m"))) for i, m in enumerate(LIMITS))))
    vitals = (F.col("lcp") < LIMITS["lcp"][0]) & (F.col("cls") < LIMITS["cls"][0]) & (F.col("tbt") < LIMITS["tbt"][0])
    return df.withColumns({"overall": F.element_at(F.array(*(F.lit(x) for x in ("unknown", "good", "needs-improvement", "poor"))), worst + 1), "passes_vitals": F.coalesce(vitals, F.lit(False)), "worst_metric": F.array_max(over)["m"]})


def lighthouse_facts(metrics: DataFrame) -> DataFrame:
    """What the page-speed rules read of each row of ``lighthouse``: numbers as measured and as shown, savings of audits below one, counts of resources."""
    score = lambda a: _number(a, "score")
    count = lambda a: F.coalesce(F.size(F.try_variant_get("v", f"$.audits['{a}'].details.items", "array<variant>")), F.lit(0))
    shown = lambda m: F.coalesce(F.try_variant_get("v", f"$.audits['{METRICS[m]}'].displayValue", "string"), fixed(_number(METRICS[m]), 2), F.lit("unknown"))
    labels = (("uses-responsive-images", "oversized images"), ("efficiently-encode-images", "inefficient encoding"), ("modern-image-formats", "legacy formats"))
    savings = F.array_compact(F.array(*(F.when(score(a) < 1, F.coalesce(_number(a), F.lit(0.0))) for a in OPPORTUNITIES)))
    failing = lambda a: F.when(score(a) < 1, count(a)).otherwise(0)
    df = metrics.select(
        *KEY, "score", *(_number(METRICS[m]).alias(f"{m}_number") for m in LIMITS), *(shown(m).alias(f"{m}_shown") for m in LIMITS), savings.alias("savings"), failing("render-blocking-resources").alias("blocking"),
        F.array_compact(F.array(*(F.when(score(a) < 1, F.lit(n)) for a, n in labels))).alias("image_issues"), _number("bootup-time").alias("bootup"), _number("mainthread-work-breakdown").alias("mainthread"), failing("uses-long-cache-ttl").alias("uncached"),
    )
    top = F.aggregate(F.slice(F.sort_array("savings", asc=False), 1, 5), F.lit(0.0), lambda x, y: x + y)
    df = df.withColumn("top_savings", top)
    return df.withColumns({"savings_kb": fixed(F.col("top_savings") / 1024, 1), "bootup_s": fixed(F.col("bootup") / 1000, 2), "mainthread_s": fixed(F.col("mainthread") / 1000, 2)})


def lighthouse_lists(metrics: DataFrame) -> DataFrame:
    """Opportunities and diagnostics of each row that score below one: kind, pos, title (the audit's id without one), savings as shown, score."""
    audit = lambda a, f, t: F.try_variant_get("v", f"$.audits['{a}'].{f}", t)

    def entry(kind, pos, a):
        title = F.coalesce(F.nullif(audit(a, "title", "string"), F.lit("")), F.lit(a))
        savings = F.coalesce(audit(a, "displayValue", "string"), F.lit("")) if kind == "opportunity" else F.lit(None).cast("string")
        return F.when(audit(a, "score", "double") < 1, F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), title.alias("title"), savings.alias("savings"), audit(a, "score", "double").alias("score")))

    rows = [entry("opportunity", i, a) for i, a in enumerate(LISTED)] + [entry("diagnostic", i, a) for i, a in enumerate(DIAGNOSTICS)]
    return metrics.select(*KEY, F.explode(F.array_compact(F.array(*rows))).alias("e")).select(*KEY, "e.*")


def sitemap_refs(robots: DataFrame) -> DataFrame:
    """run_id, site, pos, ref: Sitemap lines of robots.txt."""
    lines = robots.select(*KEY, F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    return lines.withColumn("ref", F.trim(F.regexp_extract("line", r"(?i)^sitemap:\s*(.+)$", 1))).where("ref <> ''").drop("line")


def robots_blocking(robots: DataFrame) -> DataFrame:
    """Lines that close an important section; every pattern that fits counts. User-agent groups are not told apart."""
    lines = robots.where("status = 200").select(*KEY, F.posexplode(F.split(F.lower("body"), r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    names = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in ROBOTS.items())))
    return lines.select(*KEY, "pos", "line", F.explode(names).alias("section"))


def robots_facts(blocking: DataFrame) -> DataFrame:
    """Per site: s, the closed sections with their lines in order, and whether the home page is among them."""
    return blocking.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "section", "line"))).alias("s"), F.bool_or(F.col("section") == "home").alias("home"))


def parse_sitemap(body: Column) -> Column:
    """(maps, urls) of a sitemap file, leniently: bare <loc> entries count only where there is no index or url entry."""
    maps = F.regexp_extract_all(body, F.lit(r"(?is)<sitemap>.*?<loc>(.*?)</loc>.*?</sitemap>"), F.lit(1))
    pages = F.regexp_extract_all(body, F.lit(r"(?is)<url>.*?<loc>(.*?)</loc>.*?</url>"), F.lit(1))
    bare = F.regexp_extract_all(body, F.lit(r"(?i)<loc>(.*?)</loc>"), F.lit(1))
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(clean(maps).alias("maps"), clean(F.when((F.size(maps) == 0) & (F.size(pages) == 0), bare).otherwise(pages)).alias("urls"))


def is_gzipped(url: Column, content_type: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\.gz$") | F.lower(content_type).contains("gzip"), F.lit(False))


#: Levels of indexes that are followed; sitemaps nested deeper raise.
LEVELS = 10_000
_WALK = f"""
with recursive walk(run_id, site, graph, depth, frontier, visited) max recursion level {LEVELS} as (
  select run_id, site, graph, 0, frontier, frontier from {{seeds}}
  union all
  select run_id, site, graph, depth + 1, found, array_union(visited, found)
  from (
    select run_id, site, graph, depth, visited, array_except(flatten(transform(frontier, r -> coalesce(try_element_at(graph, r), cast(array() as array<string>)))), visited) as found
    from walk)
  where size(found) > 0)
select run_id, site, depth, posexplode(frontier) as (path, ref) from walk
"""


def sitemap_places(parsed: DataFrame, starts: DataFrame) -> DataFrame:
    """run_id, site, ref, depth, path: where breadth-first search meets each sitemap, from ``starts`` (run_id, site, pos, ref) and the usual places.

    One recursive plan: a level of a site is one row with the sitemaps found there and the set of those visited, so cycles end and no
    sitemap is met twice.  A row holds a site's index entries, never its page URLs.
    """
    usual = parsed.select(*KEY).distinct().select(*KEY, F.posexplode(F.array(*(F.lit(p) for p in SITEMAP_PATHS))).alias("i", "p"))
    usual = usual.select(*KEY, (F.col("i") + 1_000_000).alias("pos"), F.concat(F.lit("https://"), F.col("site"), F.col("p")).alias("ref"))
    first = starts.select(*KEY, "pos", "ref").unionByName(usual).groupBy(*KEY).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"])).alias("frontier"))
    edges = parsed.where(F.size("s.maps") > 0).groupBy(*KEY, "ref").agg(F.min("s.maps").alias("maps"))
    graphs = edges.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("ref", "maps"))).alias("graph"))
    return parsed.sparkSession.sql(_WALK, seeds=first.join(graphs, KEY, "left"))


def sitemap_walk(files: DataFrame, starts: DataFrame) -> DataFrame:
    """run_id, site, ref, depth, path, before, s: the sitemaps of ``sitemap_places`` with what they hold (maps, urls; null: no such file) and how many URLs come before them in the walk.

    Files are parsed once.  URLs are counted by file, and only those counts are summed in order: no site's URLs are sorted.
    """
    parsed = keep(files.select(*KEY, F.col("sitemap_url").alias("ref"), parse_sitemap(F.col("body")).alias("s")).dropDuplicates([*KEY, "ref"]), "sitemaps")
    places = keep(sitemap_places(parsed, starts), "sitemap-places", RECURSIVE)
    counts = places.join(parsed.select(*KEY, "ref", F.size("s.urls").cast("long").alias("n")), [*KEY, "ref"], "left")
    earlier = Window.partitionBy(*KEY).orderBy("depth", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*KEY, "ref", "depth", "path", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0)).cast("long").alias("before"))
    return placed.join(parsed, [*KEY, "ref"], "left")


def sitemap_urls(files: DataFrame, starts: DataFrame, most: int = 50_000) -> DataFrame:
    """run_id, site, seq, url: URLs of the sitemaps that ``sitemap_walk`` reaches, in its order; at most ``most`` a site."""
    return numbered(sitemap_walk(files, starts), most)


def numbered(walk: DataFrame, most: int = 50_000) -> DataFrame:
    """run_id, site, seq, url of a walk: a file's URLs are numbered on from how many come before it, wherever the file is."""
    held = walk.where(F.col("before") < most).select(*KEY, "before", F.posexplode(F.slice("s.urls", F.lit(1), F.least(F.size("s.urls"), (most - F.col("before")).cast("int")))).alias("i", "url"))
    return held.select(*KEY, (F.col("before") + F.col("i") + 1).cast("int").alias("seq"), "url")


def sitemap_errors(walk: DataFrame, most: int = 50_000) -> DataFrame:
    """run_id, site, message: a row for each sitemap tried that is not there, and for the cap where a site reaches it."""
    gone = walk.where(F.col("s").isNull()).select(*KEY, F.concat(F.col("ref"), F.lit(": no such file")).alias("message"))
    sizes = walk.groupBy(*KEY).agg(F.sum(F.size("s.urls")).alias("n")).where(F.col("n") >= most)
    return gone.unionByName(sizes.select(*KEY, F.lit(f"Reached MAX_SITEMAP_URLS limit ({most})").alias("message")))


#: A line that opens a finding, and characters of a scan that are read (fixed values).
SCANNED = 50_000
HEADER = r"(?i)^(?:\[|\()?(CRITICAL|HIGH|MEDIUM|LOW|INFO)(?:\]|\))?:?\s*(.+)"


def scanned_lines(lines: DataFrame, block: int = 1000) -> DataFrame:
    """The lines (run_id, site, line_no, line) of each log within its first SCANNED characters, the last of them cut, masked; a log that is longer ends in a line that says so.

    Characters are summed by blocks of line numbers; only the sums of blocks are put in order.  Blocks that begin beyond the bound go before any
    line is sorted, so a log of any length spreads over all tasks and what is left of a site is bounded.
    """
    rows = lines.select(*KEY, "line_no", F.coalesce("line", F.lit("")).alias("line")).withColumn("block", F.floor(F.col("line_no") / block))
    size = F.length("line") + 1  # with its line feed
    sums = rows.groupBy(*KEY, "block").agg(F.sum(size).alias("n"), F.max("line_no").alias("last"))
    w = Window.partitionBy(*KEY).orderBy("block")
    sums = sums.withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*KEY)) - 1, "end": F.max("last").over(Window.partitionBy(*KEY))})
    held = rows.join(sums.where(F.col("before") < SCANNED).select(*KEY, "block", "before", "total", "end"), [*KEY, "block"])
    inside = Window.partitionBy(*KEY, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    held = held.withColumn("at", at).where(F.col("at") < SCANNED)
    cut = held.select(*KEY, "line_no", F.substr("line", F.lit(1), (SCANNED - F.col("at")).cast("int")).alias("line"))
    marks = sums.where((F.col("before") == 0) & (F.col("total") > SCANNED)).select(*KEY, (F.col("end") + 1).alias("line_no"), F.lit("... [truncated]").alias("line"))
    return cut.unionByName(marks).withColumn("line", redact.mask_scan(F.col("line")))


def scan_findings(lines: DataFrame, most: int = 100) -> DataFrame:
    """Findings of a scan log, of the part that ``scanned_lines`` reads: a header line opens one, the lines after it are its description."""
    order = Window.partitionBy(*KEY).orderBy("line_no")
    rows = scanned_lines(lines).withColumn("head", F.col("line").rlike(HEADER)).withColumn("no", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("no").between(1, most))
    # a site's texts together are SCANNED characters at most
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    first = lambda g: F.max(F.when(F.col("head"), F.regexp_extract("line", HEADER, g)))
    return rows.groupBy(*KEY, "no").agg(F.upper(first(1)).alias("severity"), F.trim(first(2)).alias("title"), text.alias("description"))


def scan_output(rows: DataFrame) -> DataFrame:
    """Adds what a scan's text (column output) gives: masked (cut at SCANNED characters), its JSON if it is a JSON object, else the number of its lines."""
    cut = F.when(F.length("output") > SCANNED, F.concat(F.substring("output", 1, SCANNED), F.lit("\n... [truncated]"))).otherwise(F.col("output"))
    df = rows.withColumn("masked", redact.mask_scan(cut))
    parsed = F.when(trim(F.col("masked")).startswith("{"), F.try_parse_json(trim(F.col("masked"))))
    return df.withColumn("parsed", parsed).withColumn("line_count", F.when(F.col("parsed").isNull(), F.size(F.split("masked", "\n"))))


def scan_summary(lines: DataFrame) -> DataFrame:
    """Counts that the first fifty lines state; the last statement of each wins.  Labels are fixed values."""
    top = lines.where("line_no < 50")
    label = lambda w: F.max_by(F.regexp_extract("line", rf"(?i){w}[:\s]+(\d+)", 1).try_cast("int"), F.when(F.col("line").rlike(rf"(?i){w}[:\s]+\d+"), F.col("line_no")))
    return top.groupBy(*KEY).agg(*(label(w).alias(n) for n, w in (("critical", "critical"), ("high", "high"), ("medium", "medium"), ("low", "low"), ("info", "info(?:rmation)?"))))


def given(df: DataFrame, name: str, kind: str) -> Column:
    """A column of a table, null where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def model_findings(answers: DataFrame) -> DataFrame:
    """Findings of model answers (column text): fenced or bare JSON with a findings array; anything else gives none.

    What the model was shown comes along as evidence where ``answers`` holds it: has_desktop, has_mobile, page_title, page_h1.
    """
    body = F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?s)```json\s*(.*?)```", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("text", r"(?s)```\s*(.*?)```", 1)), F.lit("")), F.trim("text"))
    shape = "array<struct<category:string,severity:string,description:string,recommendation:string>>"
    rows = answers.withColumn("a", F.try_variant_get(F.try_parse_json(body), "$.findings", shape))
    rows = rows.select(*[c for c in answers.columns if c != "text"], F.posexplode("a").alias("pos", "f"))
    flag = lambda n: F.coalesce(given(answers, n, "boolean"), F.lit(False))
    title, h1 = given(answers, "page_title", "string"), given(answers, "page_h1", "string")
    facts = {
        "recommendation": F.col("f.recommendation"), "category": F.col("f.category"), "desktop": flag("has_desktop"), "mobile": flag("has_mobile"),
        "title": F.coalesce(title, F.lit("Unknown")), "h1": F.coalesce(h1, F.lit("Unknown")), "hasCta": h1.isNotNull(),
    }
    told = {"type": lookup(F.lower("f.category"), VISUAL_TYPES, "visual_viewport_issues"), "severity": lookup(F.lower("f.severity"), VISUAL_SEVERITIES, "info"), "message": F.col("f.description")}
    return rows.withColumns({**told, "evidence": evidence(detail=F.col("f.category"), facts=facts)}).drop("f")


def step_costs(traces: DataFrame) -> DataFrame:
    """Adds the cost of each step; unknown models have the default price, null tokens count as none."""
    prices = traces.sparkSession.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, in_price double, out_price double")
    df = traces.join(F.broadcast(prices), "model", "left")  # seven rows
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(1000.0)
    cost = tokens("prompt_tokens") * F.coalesce("in_price", F.lit(DEFAULT_PRICE[0])) + tokens("output_tokens") * F.coalesce("out_price", F.lit(DEFAULT_PRICE[1]))
    return df.withColumn("cost", cost).drop("in_price", "out_price")


def show_cost(c: Column) -> Column:
    return F.when(c < 0.01, F.concat(F.lit("$"), fixed(c, 4))).otherwise(F.concat(F.lit("$"), fixed(c, 2)))


def run_costs(traces: DataFrame) -> DataFrame:
    return step_costs(traces).groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Milliseconds of each stage of a run, and from first beginning to last end."""
    ms = F.unix_millis("ended_at") - F.unix_millis("started_at")
    per = events.groupBy("run_id", "stage").agg(F.sum(ms).alias("duration_ms"), F.min("started_at").alias("a"), F.max("ended_at").alias("b"))
    whole = per.groupBy("run_id").agg((F.unix_millis(F.max("b")) - F.unix_millis(F.min("a"))).alias("duration_ms")).select("run_id", F.lit("total").alias("stage"), "duration_ms")
    return per.drop("a", "b").unionByName(whole)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def live_snapshots(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """The latest snapshot of each key, if its time to live has not passed."""
    latest = snapshots.withColumn("r", F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("collected_at")))).where("r = 1").drop("r")
    return latest.where(F.unix_millis(as_of) <= F.unix_millis("collected_at") + F.col("ttl_ms"))


def cache_statistics(snapshots: DataFrame, as_of: Column) -> DataFrame:
    gone = F.unix_millis(as_of) > F.unix_millis("collected_at") + F.col("ttl_ms")
    return snapshots.groupBy("cache_type").agg(F.count(F.lit(1)).alias("entries"), F.count_if(gone).alias("expired"))


def typed_key(*parts: Column) -> Column:
    """A cache key that names its type first: type, key and URL with colons between."""
    return F.concat_ws(":", *parts)
