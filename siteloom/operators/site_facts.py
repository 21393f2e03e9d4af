"""Facts of a site from collected tables: headers, redirects, certificates, DNS, coverage, URL set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls

KEY = ["run_id", "site"]
#: Response headers looked at, and those that the checks ask for (fixed values).
HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "referrer-policy", "permissions-policy", "x-content-type-options", "x-xss-protection",
           "cross-origin-embedder-policy", "cross-origin-opener-policy", "cross-origin-resource-policy"]
CHECKED = ["strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy"]
VARIANTS = ["httpRoot", "httpsRoot", "httpsWww", "httpWww"]
#: Names in DNS records, in the order they are tried (fixed values).
CDNS = {"cloudflare": "Cloudflare", "fastly": "Fastly", "akamai": "Akamai", "cloudfront": "CloudFront", "maxcdn": "MaxCDN", "keycdn": "KeyCDN", "stackpath": "StackPath"}
HOSTS = {"amazonaws": "AWS", "aws": "AWS", "google": "Google Cloud", "azure": "Azure", "digitalocean": "DigitalOcean", "linode": "Linode", "ovh": "OVH", "hetzner": "Hetzner"}
#: Path patterns of page kinds, tried in this order; the first that matches counts (fixed values).
TEMPLATES = [
    (r"/products/[^/]+$", "product", "/products/{slug}"), (r"/collections/[^/]+$", "collection", "/collections/{slug}"), (r"/pages/[^/]+$", "page", "/pages/{slug}"),
    (r"/blogs/[^/]+/[^/]+$", "blog-post", "/blogs/{blog}/{post}"), (r"/\d{4}/\d{2}/[^/]+$", "blog-post", "/{year}/{month}/{slug}"), (r"/category/[^/]+$", "category", "/category/{slug}"),
    (r"/tag/[^/]+$", "tag", "/tag/{slug}"), (r"/author/[^/]+$", "author", "/author/{slug}"), (r"/product/[^/]+$", "product", "/product/{slug}"), (r"/item/[^/]+$", "product", "/item/{slug}"),
    (r"/shop/[^/]+$", "product", "/shop/{slug}"), (r"/catalog/[^/]+$", "catalog", "/catalog/{slug}"), (r"/p/[^/]+$", "product", "/p/{slug}"), (r"/blog/[^/]+$", "blog-post", "/blog/{slug}"),
    (r"/post/[^/]+$", "blog-post", "/post/{slug}"), (r"/article/[^/]+$", "article", "/article/{slug}"), (r"/news/[^/]+$", "news", "/news/{slug}"), (r"/about[^/]*$", "about", "/about"),
    (r"/contact[^/]*$", "contact", "/contact"), (r"/faq[^/]*$", "faq", "/faq"), (r"/help[^/]*$", "help", "/help"), (r"/support[^/]*$", "support", "/support"),
    (r"/terms[^/]*$", "terms", "/terms"), (r"/privacy[^/]*$", "privacy", "/privacy"),
]
#: Query parameters counted by name; any other counts as ``other`` (fixed values).
PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "campaign", "medium", "sort", "filter", "page", "limit", "order"]
#: Marks of shop and blog systems in html (fixed values).
SIGNATURES = {
    "shopify:html-signature": ["cdn.shopify.com", "Shopify.theme", "shopify-buy"], "wordpress:html-signature": ["/wp-content/", "/wp-includes/", "wp-json", "wordpress", "wp-embed"],
    "woocommerce:html-signature": ["woocommerce", "wc-"], "magento:html-signature": ["magento", "Mage."], "ecommerce:product-schema": ['"@type": "Product"', "'@type': 'Product'"],
    "blog:article-schema": ['"@type": "Article"', "'@type': 'Article'"],
}


def present(value: Column) -> Column:
    return F.struct(F.lit("present").alias("state"), value.alias("value"), F.lit(None).cast("string").alias("reason"))


def unknown(reason: str, kind: str = "string") -> Column:
    return F.struct(F.lit("unknown").alias("state"), F.lit(None).cast(kind).alias("value"), F.lit(reason).alias("reason"))


def tristate(value: Column) -> Column:
    """present with a value, absent without; empty text counts as absent."""
    absent = F.struct(F.lit("absent").alias("state"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("reason"))
    return F.when(F.coalesce(value, F.lit("")) != "", present(value)).otherwise(absent)


def value_or(state: Column, default: Column) -> Column:
    return F.when(state["state"] == "present", state["value"]).otherwise(default)


def header_value(headers: Column, name) -> Column:
    """A header of entries (key, value) by its name in lower case; of several spellings the last counts."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(F.filter(headers, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


def entries(df: DataFrame, column: str = "headers") -> Column:
    """A map of headers, or an array of (key, value) as it came, as such an array."""
    return F.map_entries(column) if dict(df.dtypes)[column].startswith("map") else F.col(column)


def security_headers(roots: DataFrame) -> DataFrame:
    """run_id, site, header, state: a row for each header looked at. Null headers mean that the root was not fetched: all unknown."""
    rows = roots.select(*KEY, entries(roots).alias("h"), F.explode(F.array(*(F.lit(x) for x in HEADERS))).alias("header"))
    state = F.when(F.col("h").isNull(), unknown("No root fetch data")).otherwise(tristate(header_value(F.col("h"), F.col("header"))))
    return rows.select(*KEY, "header", state.alias("state"))


def header_facts(states: DataFrame) -> DataFrame:
    """Per site: m, the headers asked for that are missing (unknown counts as missing), and rest, those of them that have no check of their own, sorted."""
    missing = states.where((F.col("state.state") != "present") & F.col("header").isin(CHECKED))
    own = F.array(*(F.lit(h) for h in ("strict-transport-security", "content-security-policy", "x-frame-options")))
    return missing.groupBy(*KEY).agg(F.collect_set("header").alias("m")).withColumn("rest", F.array_sort(F.array_except("m", own)))


def hsts(value: Column) -> Column:
    v = F.lower(value)
    return F.struct(F.regexp_extract(v, r"max-age=(\d+)", 1).try_cast("long").alias("max_age"), v.contains("includesubdomains").alias("include_subdomains"), v.contains("preload").alias("preload"))


def csp(value: Column) -> Column:
    """Map of directive to its values; of a repeated directive the last counts."""
    parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.split(F.trim(p), r"\s+")), lambda p: p[0] != "")
    names = F.array_distinct(F.transform(parts, lambda p: F.lower(p[0])))
    last = lambda n: F.element_at(F.filter(parts, lambda p: F.lower(p[0]) == n), -1)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.slice(last(n), F.lit(2), F.greatest(F.size(last(n)) - 1, F.lit(0)))))


def redirect_chains(hops: DataFrame) -> DataFrame:
    """Raw hops (run_id, site, variant, hop, url, status) to a chain for each variant; a variant with none is one failed node of ``start``."""
    return hops.groupBy(*KEY, "variant").agg(F.array_sort(F.collect_list(F.struct("hop", "url", "status"))).alias("c")).select(
        *KEY, "variant", F.transform("c", lambda x: F.struct(x["url"].alias("url"), x["status"].alias("status"))).alias("chain"), F.element_at("c", -1)["url"].alias("final_url")
    )


def redirect_health(chains: DataFrame) -> DataFrame:
    """Per site: longest chain (nodes), URLs met twice in one chain, and health."""
    loops = F.size("chain") - F.size(F.array_distinct(F.transform("chain", lambda x: x["url"])))
    per = chains.groupBy(*KEY).agg(F.max(F.size("chain")).alias("max_chain"), F.sum(loops).cast("long").alias("loops"), F.count_if(F.size("chain") > 3).alias("long_chains"))
    health = F.when((F.col("loops") > 0) | (F.col("max_chain") > 5), "critical").when(F.col("max_chain") > 2, "warning").otherwise("healthy")
    return per.withColumn("health", health)


def host_rules(chains: DataFrame) -> DataFrame:
    """Per site: final URLs of the variants, https enforced (at the end or inside an http chain), longest http chain, www and slash use, and whether the https hosts conflict."""
    secure = lambda u: u.startswith("https://")
    plain = F.col("variant").isin("httpRoot", "httpWww")
    http = chains.groupBy(*KEY).agg(F.bool_or(plain & (secure(F.col("final_url")) | F.exists("chain", lambda x: secure(x["url"])))).alias("secured"), F.coalesce(F.max(F.when(plain, F.size("chain"))), F.lit(0)).alias("http_chain"))
    per = chains.groupBy(*KEY).pivot("variant", VARIANTS).agg(F.first("final_url")).join(http, KEY)
    finals = F.filter(F.array(*VARIANTS), lambda x: F.coalesce(x, F.lit("")) != "")
    www = F.transform(finals, lambda u: urls.host(u).startswith("www."))
    slash = F.transform(finals, lambda u: (F.length(urls.path(u)) > 1) & urls.path(u).endswith("/"))
    every = lambda a: F.forall(a, lambda v: v)
    never = lambda a: F.forall(a, lambda v: ~v)
    a, b = urls.host(F.col("httpsRoot")), urls.host(F.col("httpsWww"))
    return per.withColumns(
        {
            "https_enforced": F.coalesce("secured", F.lit(False)),
            "www_consistent": every(www) | never(www),
            "www_preference": F.when(every(www), "www").when(never(www), "non-www"),
            "slash_consistent": every(slash) | never(slash),
            "slash_preference": F.when(every(slash), "slash").when(never(slash), "no-slash"),
            "host_conflict": F.coalesce((a != b) & (a != F.concat(F.lit("www."), b)) & (b != F.concat(F.lit("www."), a)), F.lit(False)),
            "http_stays": F.coalesce(urls.scheme(F.col("httpRoot")) == "http", F.lit(False)),
        }
    ).drop("secured")


def certificates(tls: DataFrame, as_of: Column) -> DataFrame:
    """Days left (up and down), validity and the finding of each certificate, as of a given time; unreadable dates give nulls."""
    left = (F.unix_millis(F.try_to_timestamp("expiry_date")) - F.unix_millis(as_of)) / F.lit(86400000.0)
    df = tls.withColumns({"days_ceil": F.ceil(left), "days_floor": F.floor(left)})
    p = F.lower("protocol")
    d = F.col("days_floor")
    return df.withColumns(
        {
            "valid": F.col("days_ceil") > 0,
            "cert_finding": F.when(d < 0, "TLS certificate has expired").when(d < 30, F.concat(F.lit("TLS certificate expires in "), d.cast("string"), F.lit(" days"))),
            "weak_protocol": F.coalesce(p.contains("ssl") | p.contains("tlsv1.0") | p.contains("tlsv1.1"), F.lit(False)),
        }
    )


def _named(record: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for mark, name in reversed(names.items()):
        out = F.when(record.contains(mark), name).otherwise(out)
    return out


def infrastructure(records: DataFrame) -> DataFrame:
    """Delivery network and hosting of each site: records (run_id, site, pos, value, issuer); the last record that names one wins, then the issuer."""
    r = F.lower("value")
    named = records.withColumns({"c": _named(r, CDNS), "h": _named(r, HOSTS)})
    per = named.groupBy(*KEY).agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("pos"))).alias("cdn"), F.max_by("h", F.when(F.col("h").isNotNull(), F.col("pos"))).alias("hosting"), F.max(F.lower("issuer")).alias("i"))
    cdn = F.coalesce("cdn", F.when(F.col("i").contains("cloudflare"), "Cloudflare"))
    hosting = F.coalesce("hosting", F.when(F.col("i").contains("let"), "Let's Encrypt"))
    return per.select(*KEY, cdn.alias("cdn"), hosting.alias("hosting"))


#: Largest html, marks of pages drawn by script and of loading states (fixed values).
MAX_HTML = 2_097_152
SPA, LOADING = r"(?i)(ng-app|data-reactroot|data-reactid|__next|__nuxt|__vue)", r"(?i)(loading|spinner|skeleton|please wait)"


def needs_script(html: Column) -> Column:
    """A page that seems to be drawn by script: a framework's mark, or hardly any text and a loading state."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html)
    return html.rlike(SPA) | ((F.length(F.trim(F.regexp_replace(body, "<[^>]+>", ""))) < 100) & html.rlike(LOADING))


def coverage(fetches: DataFrame) -> DataFrame:
    """Per site: what was fetched, parsed, blocked, failed, timed out or too large, the share of pages fetched, and that of the fetched ones parsed. A rate over no page is 0."""
    s, html = F.col("status"), F.coalesce("html", F.lit(""))
    ok = s.between(200, 299)
    per = fetches.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("fetched"),
        F.count_if(ok & html.contains("<html") & html.contains("</html>")).alias("parsed"),
        F.count_if(s.isin(401, 403)).alias("blocked"),
        F.count_if(s >= 400).alias("errors"),
        F.count_if(s.isin(0, 408, 524)).alias("timeouts"),
        F.count_if(s == 429).alias("rate_limited"),
        F.count_if(F.length(html) > MAX_HTML).alias("oversized"),
        F.coalesce(F.bool_or(needs_script(html)), F.lit(False)).alias("script_suspected"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return per.withColumns({"fetch_rate": rate("fetched", "attempted"), "parse_rate": rate("parsed", "fetched")})


def error_histogram(fetches: DataFrame) -> DataFrame:
    return fetches.where("status = 0 or status >= 400").groupBy(*KEY, "status").agg(F.count(F.lit(1)).alias("n"))


def unknown_rates(signals: DataFrame) -> DataFrame:
    """Share of pages of each site without a signal of each family."""
    return signals.groupBy(*KEY).agg(*(F.avg(c.cast("double")).alias(n) for n, c in (
        ("title", F.col("title").isNull()), ("description", F.col("meta_description").isNull()), ("canonical", F.col("canonical").isNull()), ("schema", F.size("ld_json") == 0))))


def template(path: Column) -> Column:
    """(type, pattern) of the first page kind whose pattern fits; null if none."""
    out = F.lit(None).cast("struct<type:string,pattern:string>")
    for regex, kind, pattern in reversed(TEMPLATES):
        out = F.when(path.rlike(f"(?i){regex}"), F.struct(F.lit(kind).alias("type"), F.lit(pattern).alias("pattern"))).otherwise(out)
    return out


def url_templates(pages: DataFrame, samples: int = 5) -> DataFrame:
    """Per site and pattern: kind, count, first URLs, and the place by count."""
    rows = pages.withColumn("t", template(urls.path(F.col("url")))).where("t is not null").select(*KEY, "crawl_seq", "url", "t.*")
    place = F.row_number().over(Window.partitionBy(*KEY, "pattern").orderBy("crawl_seq", "url"))
    shown = rows.withColumn("r", place).where(F.col("r") <= samples).groupBy(*KEY, "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"]).alias("sample_urls"))
    counts = rows.groupBy(*KEY, "pattern", "type").agg(F.count(F.lit(1)).alias("n"), F.min("crawl_seq").alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "first", "pattern")))
    return ranked.join(shown, [*KEY, "pattern"]).drop("first")


def path_groups(pages: DataFrame) -> DataFrame:
    """Pages by first path segment."""
    seg = F.regexp_extract(urls.path(F.col("url")), "^/([^/]*)", 1)
    return pages.groupBy(*KEY, F.when(seg == "", "/").otherwise(F.concat(F.lit("/"), seg, F.lit("/"))).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("crawl_seq").alias("first_seen"))


def url_set(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Distinct URLs of samples and sitemap with the place of first sight; pages come first."""
    seen = pages.select(*KEY, "url", F.struct(F.lit(0).alias("src"), F.col("crawl_seq").alias("seq")).alias("at"))
    more = sitemap.select(*KEY, "url", F.struct(F.lit(1).alias("src"), F.col("seq").alias("seq")).alias("at"))
    return seen.unionByName(more).groupBy(*KEY, "url").agg(F.min("at").alias("at"))


def parameters(pages: DataFrame, first: int = 200, counted: int = 50) -> DataFrame:
    """Query parameters of the first ``counted`` parameterised URLs among each site's first ``first``."""
    site = Window.partitionBy(*KEY).orderBy("crawl_seq", "url")
    rows = pages.withColumn("r", F.row_number().over(site)).where(F.col("r") <= first).withColumn("q", urls.query(F.col("url"))).where("q <> ''")
    rows = rows.withColumn("r", F.row_number().over(site)).where(F.col("r") <= counted)
    keys = rows.select(*KEY, F.explode(F.filter(F.split("q", "&"), lambda x: x != "")).alias("p")).withColumn("k", F.lower(F.substring_index("p", "=", 1)))
    return keys.groupBy(*KEY, F.when(F.col("k").isin(PARAMETERS), F.col("k")).otherwise("other").alias("parameter")).agg(F.count(F.lit(1)).alias("n"))


def platforms(fetches: DataFrame) -> DataFrame:
    """Per site: signs of shop and blog systems, and the system they point to."""
    html, u = F.coalesce("html", F.lit("")), F.col("url")
    signs = {"shopify:url-patterns": u.rlike("/products/|/collections/"), "wordpress:url-patterns": u.rlike("/wp-content/|/wp-json/|/category/|/tag/")}
    for name, marks in SIGNATURES.items():
        signs[name] = F.array_contains(F.array(*(html.contains(m) for m in marks)), True)
    more = {"p_products": u.rlike("/products/[^/]+"), "p_collections": u.rlike("/collections/[^/]+"), "p_wp": u.contains("/wp-content/"), "p_product": u.rlike("/product/[^/]+")}
    per = fetches.groupBy(*KEY).agg(*(F.bool_or(c).alias(n) for n, c in (signs | more).items()))
    hints = F.array_compact(F.array(*(F.when(F.col(f"`{n}`"), F.lit(n)) for n in signs)))
    has = lambda word: F.exists(hints, lambda h: h.contains(word))
    platform = (
        F.when(has("shopify"), "shopify").when(has("woocommerce") | (has("wordpress") & has("ecommerce")), "woocommerce").when(has("wordpress"), "wordpress").when(has("magento"), "magento")
        .when(F.col("p_products") & F.col("p_collections"), "shopify").when(F.col("p_wp"), "wordpress").when(has("ecommerce") | F.col("p_product"), "generic")
    )
    return per.select(*KEY, hints.alias("hints"), platform.alias("platform"))


def private_flags(fetches: DataFrame) -> DataFrame:
    """Exposure flags of each site: kind and count only; never joined to public output. The patterns are fixed values."""
    html = F.coalesce("html", F.lit(""))
    scripts = F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]+src\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    maps = html.rlike(r"(?i)sourceMappingURL\s*=\s*(\S+)") | F.exists(scripts, lambda s: s.endswith(".map") | s.contains(".js.map"))
    traces = [r"(?i)at\s+[\w.]+\s+\([^)]+:\d+:\d+\)", r"(?i)stack trace:", r"(?i)exception in thread", r"(?i)traceback\s*\(", r"(?i)in\s+`[^']*'\s+at\s+"]
    secrets = [r"AKIA[0-9A-Z]{16}", r"(?i)[\"']api[_-]?key[\"']\s*[:=]\s*[\"'][a-zA-Z0-9]{20,}[\"']", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", r"(?i)[\"']bearer\s+[a-zA-Z0-9_\-.]{20,}[\"']", r"(?i)basic\s+[a-zA-Z0-9]{20,}"]
    some = lambda patterns: F.greatest(*(html.rlike(p) for p in patterns))
    hosts = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (r"(?i)https?://([a-z0-9-]+\.(?:internal|local|corp|private|intranet)[/\s\"'])", r"https?://([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)")))
    pages = fetches.select(*KEY, maps.alias("m"), some(traces).alias("t"), some(secrets).alias("s"), hosts.alias("h"))
    counts = pages.groupBy(*KEY).agg(F.count_if("m").alias("exposed_sourcemaps"), F.count_if("t").alias("stack_traces_exposed"), F.count_if("s").alias("exposed_secrets"))
    inner = pages.select(*KEY, F.explode("h").alias("h")).groupBy(*KEY).agg(F.count_distinct("h").alias("internal_hostnames_exposed"))
    kinds = {"exposed_sourcemaps": ("data_quality", "medium"), "stack_traces_exposed": ("data_quality", "high"), "exposed_secrets": ("confidence", "high"), "internal_hostnames_exposed": ("data_quality", "medium")}
    flags = F.array(*(F.struct(F.lit(k).alias("category"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k, (t, s) in kinds.items()))
    return counts.join(inner, KEY, "left").select(*KEY, F.explode(flags).alias("f")).select(*KEY, "f.*").where("n > 0")


def exposure_facts(flags: DataFrame) -> DataFrame:
    """What the public notice may tell: how many flags of which types, and nothing else of them."""
    return flags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
