"""Rows that collectors leave, brought into the shape of the fact tables; crawl findings; request and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.functions.text import trim
from siteloom.operators.collected import cache_key, given, lookup
from siteloom.operators.findings import evidence
from siteloom.operators.site_facts import present, tristate, unknown

KEY = ["run_id", "site"]
#: What an error of a kind says to a reader (fixed values).
FRIENDLY = {
    "INVALID_URL": "Please enter a valid website URL (e.g., https://example.com)",
    "FETCH_FAILED": "Unable to access the website. It may be down or blocking requests.",
    "API_ERROR": "Our analysis service encountered an error. Please try again.",
    "RATE_LIMITED": "Too many requests. Please wait a moment and try again.",
    "SCREENSHOT_FAILED": "Could not capture a screenshot. The visual audit may be incomplete.",
    "PARSE_ERROR": "Failed to process the analysis results.",
    "TIMEOUT": "The request took too long. Please try again.",
    "NETWORK_ERROR": "Network connection issue. Check your internet and try again.",
    "CORS_ERROR": "This website blocks cross-origin requests. Some data may be unavailable.",
}
#: Well-known paths that are asked for (fixed values).
WELL_KNOWN = ["/.well-known/security.txt", "/.well-known/assetlinks.json", "/.well-known/apple-app-site-association", "/apple-app-site-association", "/humans.txt"]
#: What model answers on search results say and what it stands for (fixed values).
SERP_TYPES = {"snippet_quality": "serp_title_mismatch", "intent_mismatch": "serp_wrong_page_ranking", "missing_page_type": "serp_not_indexed", "ctr_opportunity": "serp_description_mismatch"}
SERP_SEVERITIES = {"high": "critical", "medium": "warning", "low": "info"}
#: Words in a URL that tell a kind of site, tried in this order (fixed values).
KINDS = {"store": "shop|store|product", "blog": "blog|news|article", "services": "service|solutions", "software": "app|software"}
CATEGORIES = ["crawl", "technical", "security", "performance", "visual", "serp"]


def host_variants(sites: DataFrame) -> DataFrame:
    """The four start URLs of each site, with and without www and https."""
    bare = F.regexp_replace("site", r"^www\.", "")
    other = F.when(F.col("site").startswith("www."), bare).otherwise(F.concat(F.lit("www."), F.col("site")))
    start = lambda name, scheme, host: F.struct(F.lit(name).alias("variant"), F.concat(F.lit(f"{scheme}://"), host).alias("start"))
    own = F.col("site")
    return sites.select(*KEY, F.explode(F.array(start("httpRoot", "http", own), start("httpsRoot", "https", own), start("httpWww", "http", other), start("httpsWww", "https", other))).alias("v")).select(*KEY, "v.*")


def complete_chains(variants: DataFrame, chains: DataFrame) -> DataFrame:
    """A chain for each variant; one that could not be fetched is a single node of status 0 at its start."""
    failed = F.array(F.struct(F.col("start").alias("url"), F.lit(0).alias("status")))
    joined = variants.join(chains, [*KEY, "variant"], "left")
    return joined.select(*KEY, "variant", F.coalesce("chain", failed).alias("chain"), F.coalesce("final_url", "start").alias("final_url"))


def well_known(sites: DataFrame, responses: DataFrame, most: int = 2000) -> DataFrame:
    """A row for each site and path asked for: status (null: no response), and the first characters of a good body."""
    asked = sites.select(*KEY).distinct().select(*KEY, F.explode(F.array(*(F.lit(p) for p in WELL_KNOWN))).alias("path"))
    snippet = F.when(F.col("status").between(200, 299), F.substring("body", 1, most)).otherwise("")
    return asked.join(responses, [*KEY, "path"], "left").select(*KEY, "path", "status", snippet.alias("body_snippet"))


def dns_facts(records: DataFrame) -> DataFrame:
    """One row a site from records (rtype, pos, value, ttl): lists by type, largest ttl, and whether it resolves and has IPv6."""
    of = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("rtype") == t, F.struct("pos", "value")))), lambda x: x["value"])
    per = records.groupBy(*KEY).agg(of("A").alias("a_records"), of("AAAA").alias("aaaa_records"), of("CNAME").alias("cname_chain"), F.max("ttl").alias("ttl"))
    return per.withColumns({"resolved": F.size("a_records") > 0, "has_ipv6": F.size("aaaa_records") > 0})


def tls_facts(rows: DataFrame) -> DataFrame:
    """Issuer (organisation, else name, else unknown), expiry and names (the subject first if it is not among them)."""
    sans = F.regexp_extract_all(F.coalesce("san", F.lit("")), F.lit(r"DNS:([^,\s]+)"), F.lit(1))
    names = F.when(F.col("subject_cn").isNotNull() & ~F.array_contains(sans, F.col("subject_cn")), F.array_prepend(sans, F.col("subject_cn"))).otherwise(sans)
    return rows.select(*KEY, "protocol", F.coalesce("issuer_o", "issuer_cn", F.lit("unknown")).alias("cert_issuer"), F.coalesce("expiry_date", F.lit("unknown")).alias("expiry_date"), names.alias("sans"))


def certificate_states(certificates: DataFrame) -> DataFrame:
    """Days left, validity, names, issuer and protocol of ``certificates`` over ``tls_facts`` as three-valued facts."""
    days = F.col("days_ceil").cast("string")
    return certificates.select(
        *KEY,
        F.when(days.isNotNull(), present(days)).otherwise(unknown("No expiry date")).alias("days_left"),
        F.when(days.isNotNull(), present(F.col("valid").cast("string"))).otherwise(unknown("Cannot determine validity")).alias("valid"),
        # the certificate's own names are not held against the site here
        F.when(F.size("sans") > 0, present(F.lit("true"))).otherwise(unknown("No SANs data")).alias("sans_include_domain"),
        tristate(F.col("cert_issuer")).alias("issuer"),
        tristate(F.col("protocol")).alias("protocol"),
    )


def serp_results(rows: DataFrame) -> DataFrame:
    """Search results of either provider (provider, pos, item as JSON text) in one shape; only organic items of the second count."""
    v = rows.withColumn("v", F.try_parse_json("item"))
    text = lambda p: F.coalesce(F.try_variant_get("v", f"$.{p}", "string"), F.lit(""))
    number = lambda p: F.try_variant_get("v", f"$.{p}", "int")
    first = v.where("provider = 1").select(*KEY, F.coalesce(number("position"), F.lit(0)).alias("position"), text("title").alias("title"), text("link").alias("url"), text("snippet").alias("snippet"))
    second = v.where("provider = 2").where(text("type") == "organic").withColumn("i", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")))
    return first.unionByName(second.select(*KEY, F.coalesce(F.nullif(number("rank_group"), F.lit(0)), F.col("i")).alias("position"), text("title").alias("title"), text("url").alias("url"), text("description").alias("snippet")))


def serp_query(url: Column) -> Column:
    """Brand and kind of a site, as search terms."""
    kind = F.lit("website")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.lower(url).rlike(pattern), name).otherwise(kind)
    brand = F.substring_index(F.regexp_replace(urls.host(url), r"^www\.", ""), ".", 1)
    return F.struct(brand.alias("brand"), kind.alias("kind"), F.concat(F.lit("site:"), urls.host(url)).alias("site_query"))


def serp_model_findings(answers: DataFrame) -> DataFrame:
    """Findings of model answers on search results; bad answers give none.

    What the model was shown comes along as evidence where ``answers`` holds it: query, result_count, analyzed_pages.
    """
    body = F.coalesce(F.nullif(trim(F.regexp_extract("text", r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit("")), trim(F.col("text")))
    rows = answers.withColumn("a", F.try_variant_get(F.try_parse_json(body), "$.findings", "array<struct<type:string,impact:string,description:string,action:string>>"))
    rows = rows.select(*[c for c in answers.columns if c != "text"], F.posexplode("a").alias("pos", "f"))
    facts = {"action": F.col("f.action"), "serpType": F.col("f.type"), "query": given(answers, "query", "string"), "resultCount": given(answers, "result_count", "long"), "analyzedPages": given(answers, "analyzed_pages", "long")}
    told = {"type": lookup(F.lower("f.type"), SERP_TYPES, "serp_description_mismatch"), "severity": lookup(F.lower("f.impact"), SERP_SEVERITIES, "info"), "message": F.col("f.description")}
    return rows.withColumns({**told, "evidence": evidence(detail=F.col("f.type"), facts=facts)}).drop("f")


def visual_context(answers: DataFrame, signals: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Answers with what a visual model was shown: title and H1 of the site's first page, and which screenshots there are (desktop, mobile)."""
    first = signals.groupBy(*KEY).agg(F.min_by(F.struct("title", "h1"), F.struct("crawl_seq", "url")).alias("p")).select(*KEY, F.col("p.title").alias("page_title"), F.col("p.h1").alias("page_h1"))
    shots = screenshots.select(*KEY, F.col("desktop").isNotNull().alias("has_desktop"), F.col("mobile").isNotNull().alias("has_mobile"))
    return answers.join(first, KEY, "left").join(shots, KEY, "left")


def serp_context(answers: DataFrame, queries: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """Answers with what a search model was shown: the query, how many results and how many pages of the site."""
    counts = results.groupBy(*KEY).agg(F.count(F.lit(1)).alias("result_count"))
    seen = pages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("analyzed_pages"))
    return answers.join(queries.select(*KEY, "query"), KEY, "left").join(counts, KEY, "left").join(seen, KEY, "left").fillna(0, ["result_count", "analyzed_pages"])


def crawl_facts(robots_refs: DataFrame, sitemap: DataFrame, sites: DataFrame, chains: DataFrame, host_rules: DataFrame, parameterised: DataFrame) -> DataFrame:
    """Per site: refs, found, foreign and foreign_urls (among its first hundred sitemap URLs), long and long_chain, host_conflict, http_stays, params and param_urls."""
    other = (F.col("seq") <= 100) & (urls.host(F.col("url")) != F.col("site")) & (urls.host(F.col("url")) != "")
    refs = robots_refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"))
    # of a hundred URLs at most
    found = sitemap.groupBy(*KEY).agg(F.count(F.lit(1)).alias("found"), F.count_if(other).alias("foreign"), F.array_sort(F.collect_list(F.when(other, F.struct("seq", "url")))).alias("foreign_urls"))
    long = chains.groupBy(*KEY).agg(F.count_if(F.size("chain") > 3).alias("long"), F.min_by("chain", F.when(F.size("chain") > 3, F.col("variant"))).alias("long_chain"))
    hosts, params = host_rules.select(*KEY, "host_conflict", "http_stays"), parameterised.select(*KEY, F.col("n").alias("params"), "param_urls")
    df = sites.select(*KEY).distinct()
    for t in (refs, found, long, hosts, params):
        df = df.join(t, KEY, "left")
    return df.fillna(0, ["refs", "found", "foreign", "long", "params"]).fillna(False, ["host_conflict", "http_stays"])


def parameterised_count(pages: DataFrame, first: int = 200) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*KEY).orderBy("crawl_seq", "url"))
    rows = pages.withColumn("r", r).where((F.col("r") <= first) & (urls.query(F.col("url")) != ""))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("r", "url"))).alias("param_urls"))


def error_code(message: Column) -> Column:
    """Kind of a fetch error by its text (fixed patterns)."""
    m = F.coalesce(message, F.lit(""))
    return F.when(m.rlike("(?i)abort|timed? ?out"), "TIMEOUT").when(m.contains("CORS") | m.contains("cross-origin"), "CORS_ERROR").when(m.contains("network") | m.contains("fetch"), "NETWORK_ERROR").otherwise("FETCH_FAILED")


def friendly(code: Column) -> Column:
    return lookup(code, FRIENDLY, "An unexpected error occurred. Please try again.")


def error_bucket(message: Column) -> Column:
    """Which limit or failure a fetch error's text tells of (fixed texts)."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(m.startswith("Request timeout after"), "timeout").when(m.startswith("Network error:"), "network").when(m.startswith("Exceeded maximum redirect hops"), "hops")
        .when(m.contains("exceeds max bytes"), "size").when(m == "", "none").otherwise("other")
    )


def split_requests(requests: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Valid request rows, and the rejects with the reason."""
    good = valid_request(F.col(url))
    empty = F.coalesce(trim(F.col(url)), F.lit("")) == ""
    return requests.where(good & ~empty), requests.where(~good | empty).withColumn("reason", F.when(empty, "URL is required").otherwise("Invalid URL format"))


def identities(requests: DataFrame, url: str = "url", *versions: Column) -> DataFrame:
    """Adds what names a run: run_id (random, a row each), normalized_url, and cache_key (a hash of that URL and of the versions of tools and prompts).

    Ids are random, so a table of requests is written before anything joins on them."""
    named = requests.withColumns({"run_id": F.uuid(), "normalized_url": urls.normalise(F.col(url))})
    return named.withColumn("cache_key", cache_key(F.col("normalized_url"), *versions))


def valid_request(url: Column) -> Column:
    """Whether a typed URL can be one (a fixed pattern)."""
    return F.coalesce(trim(url).rlike(r"(?i)^(https?://)?([\w.-]+)(:\d+)?(/[^\s]*)?$"), F.lit(False))


def _block(rows: DataFrame, sites: DataFrame, order: list[str], line: Column, nothing: str) -> DataFrame:
    """The rows of each site as one text, a line or two each, in order; a site without rows says so."""
    per = rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
    return sites.select(*KEY).distinct().join(per, KEY, "left").select(*KEY, F.coalesce("block", F.lit(nothing)).alias("block"))


def serp_block(results: DataFrame, sites: DataFrame) -> DataFrame:
    """All search results of each site as lines for a model request (fixed texts)."""
    line = F.concat(F.lit("- Position "), F.col("position").cast("string"), F.lit(': "'), "title", F.lit('" - '), "url", F.lit("\n  Snippet: "), "snippet")
    return _block(results, sites, ["position", "url"], line, "No SERP data available")


def page_block(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """Title and description of each site's pages, those of its sample, as lines for a model request (fixed texts)."""
    line = F.concat(F.lit("- "), "url", F.lit("\n  Title: "), F.coalesce("title", F.lit("(missing)")), F.lit("\n  Description: "), F.coalesce("meta_description", F.lit("(missing)")))
    return _block(signals, sites, ["crawl_seq", "url"], line, "No page metadata available")


def request_blocks(findings: DataFrame, sites: DataFrame, category: Column) -> DataFrame:
    """The findings of each site and category as text for a model request; a category without any says so."""
    line = F.format_string("[%s] %s: %s", "severity", "type", "message")
    per = findings.groupBy(*KEY, category.alias("category")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
    spine = sites.select(*KEY).distinct().select(*KEY, F.explode(F.array(*(F.lit(x) for x in CATEGORIES))).alias("category"))
    return spine.join(per, [*KEY, "category"], "left").select(*KEY, "category", F.coalesce("block", F.lit("No findings in this category")).alias("block"))


def common_traces(*traces: DataFrame) -> DataFrame:
    """Traces of all model steps with their place in the run."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("trace_index", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "step_id")) - 1)
