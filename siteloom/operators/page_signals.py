"""Signals of a page: one row in, one row out, native expressions over its html."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls
from siteloom.operators import images, jsonld

#: Patterns of the signals (fixed values).
TITLE = r"(?i)<title[^>]*>([^<]*)</title>"
CHARSET, LANG, VIEWPORT = r"(?i)<meta[^>]*charset=", r"(?i)<html[^>]*lang=[\"'][^\"']+[\"'][^>]*>", r"(?i)<meta[^>]*name=[\"']viewport[\"'][^>]*>"
#: Kept as published: between an attribute's name and http:// it allows no equals sign, so that it finds url(http:// only.
MIXED = r"(?i)(src|href|url\(\s*[\"']?)http://"
ANCHOR = r"(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
LD_JSON = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _meta(name: str) -> tuple[str, str]:
    n, c = f"name=[\"']{name}[\"']", "content=[\"']([^\"']*)[\"']"
    return f"(?i)<meta[^>]*{n}[^>]*{c}[^>]*>", f"(?i)<meta[^>]*{c}[^>]*{n}[^>]*>"


def _canonical() -> tuple[str, str]:
    r, h = "rel=[\"']canonical[\"']", "href=[\"']([^\"']*)[\"']"
    return f"(?i)<link[^>]*{r}[^>]*{h}[^>]*>", f"(?i)<link[^>]*{h}[^>]*{r}[^>]*>"


def headings(html: Column, level: int) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
    return F.filter(F.transform(found, text.strip_html), lambda x: x != "")


@dataclass(frozen=True)
class Family:
    """Signals that come together.  ``reads``: columns from a page's html and url; ``derives``: columns from those that the family read."""

    name: str
    reads: Callable[[Column, Column], dict[str, Column]]
    derives: Callable[[], dict[str, Column]] = dict


def _canonical_self() -> Column:
    return F.coalesce(urls.normalise(F.col("url")) == urls.normalise(F.col("canonical")), F.lit(False))


#: The families of page signals, in the order of their columns.
FAMILIES = [
    Family("title", lambda h, _: {"title": text.first_of(h, TITLE)}, lambda: {"title_length": F.coalesce(F.length("title"), F.lit(0))}),
    Family("description", lambda h, _: {"meta_description": text.first_of(h, *_meta("description"))}, lambda: {"meta_description_length": F.coalesce(F.length("meta_description"), F.lit(0))}),
    Family("robots", lambda h, _: {"meta_robots": text.first_of(h, *_meta("robots"))}),
    Family("canonical", lambda h, _: {"canonical": text.first_of(h, *_canonical())}, lambda: {"canonical_self": _canonical_self()}),
    Family(
        "headings",
        lambda h, _: {"h1s": headings(h, 1), "headings": F.struct(*(headings(h, k).alias(f"h{k}") for k in range(2, 7)))},
        lambda: {"h1": F.try_element_at("h1s", F.lit(1)), "h1_count": F.size("h1s"), **{f"h{k}_count": F.size(f"headings.h{k}") for k in range(2, 7)}},
    ),
    Family("schema", lambda h, _: {"ld_json": F.filter(F.transform(F.regexp_extract_all(h, F.lit(LD_JSON), F.lit(1)), text.trim), lambda x: x != "")}, jsonld.block_facts),
    Family("mixed_content", lambda h, url: {"mixed_content": url.startswith("https://") & h.rlike(MIXED)}),
    Family("flags", lambda h, _: {"has_viewport": h.rlike(VIEWPORT), "has_lang": h.rlike(LANG), "has_charset": h.rlike(CHARSET)}),
    Family("words", lambda h, _: {"word_count": text.word_count(h)}),
    Family("images", lambda h, _: {"images": images.page_images(h)}, lambda: {"image_count": F.size("images"), "images_without_alt": F.size(F.filter("images", lambda x: x["alt"].isNull()))}),
]


def extract(fetches: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """run_id, site, crawl_seq, url, status and the columns of the families asked for (all by default), in one projection over html.

    A family that is not asked for never enters the plan: its patterns are not compiled, and html is not read at all where no family needs it.
    A missing html gives an empty page; a name that no family has raises.
    """
    names = [f.name for f in FAMILIES]
    wanted = set(names if only is None else only)
    if strange := wanted - set(names):
        raise ValueError(f"unknown families: {sorted(strange)}")
    families = [f for f in FAMILIES if f.name in wanted]
    html, keys = F.coalesce(F.col("html"), F.lit("")), ["run_id", "site", "crawl_seq", "url", "status"]
    read = {n: c for f in families for n, c in f.reads(html, F.col("url")).items()}
    df = fetches.select(*keys, *(c.alias(n) for n, c in read.items()))
    return df.withColumns({n: c for f in families for n, c in f.derives().items()})


def page_signals(fetches: DataFrame) -> DataFrame:
    """All signals of each page."""
    return extract(fetches)


def page_links(fetches: DataFrame, skip: tuple[str, ...] = ("#", "javascript:", "mailto:", "tel:"), texts: bool = True) -> DataFrame:
    """A row for each distinct target of a page, in order: link_url, pos, text, nofollow, internal; without ``texts`` neither text nor nofollow.

    The first occurrence of a target counts.  html is gone before links are spread to rows.
    """
    keys = ["run_id", "site", "crawl_seq", "url"]
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(0 if texts else 1))
    if texts:
        rows = fetches.select(*keys, F.posexplode(tags).alias("pos", "tag")).withColumn("href", text.trim(F.regexp_extract("tag", ANCHOR, 1)))
    else:
        rows = fetches.select(*keys, F.posexplode(F.transform(tags, text.trim)).alias("pos", "href"))
    tag = F.col("tag")
    wanted = F.col("href") != ""
    for prefix in skip:
        wanted = wanted & ~F.col("href").startswith(prefix)
    # spread from an array of one, so that no later filter resolves a link again
    target = F.explode(F.array_compact(F.array(urls.resolve(F.col("url"), F.col("href")))))
    rows = rows.where(wanted).select("*", target.alias("link_url"))
    internal = urls.host(F.col("link_url")) == urls.host(F.col("url"))
    if not texts:
        return rows.groupBy(*keys, "link_url").agg(F.min("pos").alias("pos")).withColumn("internal", internal)
    rows = rows.withColumns({"text": text.truncate(text.strip_html(F.regexp_extract(tag, ANCHOR, 2)), 100), "nofollow": F.lower(tag).contains("rel=") & F.lower(tag).contains("nofollow")})
    first = F.min_by(F.struct("pos", "text", "nofollow"), "pos").alias("f")
    return rows.groupBy(*keys, "link_url").agg(first).select(*keys, "link_url", "f.*").withColumn("internal", internal)
