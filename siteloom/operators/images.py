"""Images of pages: img tags and picture sources, with format and accessibility facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls

IMG, PICTURE, SOURCE = r"(?i)<img[^>]*>", r"(?is)<picture[^>]*>(.*?)</picture>", r"(?i)<source[^>]*>"
#: File extensions and media subtypes to formats (fixed values); others stand for themselves.
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "avif": "avif", "svg": "svg", "svg+xml": "svg", "ico": "ico", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}
EXTENSION = r"\.([A-Za-z0-9]+)(?:[?#].*)?$"


def _format(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    e = F.nullif(F.lower(ext), F.lit(""))
    return F.coalesce(F.try_element_at(known, e), e)


def page_images(html: Column) -> Column:
    """Array of src, alt, width, height of img tags that have a source; empty alt and zero sizes are null."""
    a = text.attribute
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(IMG), F.lit(0)),
        lambda t: F.struct(F.nullif(a(t, "src"), F.lit("")).alias("src"), F.nullif(a(t, "alt"), F.lit("")).alias("alt"), text.leading_int(a(t, "width")).alias("width"), text.leading_int(a(t, "height")).alias("height")),
    )
    return F.filter(tags, lambda x: x["src"].isNotNull())


def inventory(fetches: DataFrame) -> DataFrame:
    """A row for each img with a source and each picture source: src (absolute), has_alt, format, lazy, responsive, kind, width, height left to ``page_images``."""
    html = F.coalesce("html", F.lit(""))
    pictures = F.array_join(F.regexp_extract_all(html, F.lit(PICTURE), F.lit(1)), " ")
    base = fetches.select("run_id", "site", "crawl_seq", "url", F.regexp_extract_all(html, F.lit(IMG), F.lit(0)).alias("i"), F.regexp_extract_all(pictures, F.lit(SOURCE), F.lit(0)).alias("s"))
    keys = ["run_id", "site", "crawl_seq", "url"]
    a = text.attribute
    img = base.select(*keys, F.explode("i").alias("t")).withColumn("src", a(F.col("t"), "src")).where("src <> ''")
    img = img.select(
        *keys,
        urls.resolve(F.col("url"), F.col("src")).alias("src"),
        F.coalesce(a(F.col("t"), "alt") != "", F.lit(False)).alias("has_alt"),
        _format(F.regexp_extract("src", EXTENSION, 1)).alias("format"),
        F.coalesce(F.lower(a(F.col("t"), "loading")) == "lazy", F.lit(False)).alias("lazy"),
        F.lower("t").contains("srcset=").alias("responsive"),
        F.lit("img").alias("kind"),
    )
    src = base.select(*keys, F.explode("s").alias("t")).withColumn("first", F.regexp_extract(text.trim(a(F.col("t"), "srcset")), r"^([^\s,]+)", 1)).where("first <> ''")
    src = src.select(
        *keys,
        urls.resolve(F.col("url"), F.col("first")).alias("src"),
        F.lit(True).alias("has_alt"),
        F.coalesce(_format(F.regexp_extract(a(F.col("t"), "type"), "^image/(.*)$", 1)), _format(F.regexp_extract("first", EXTENSION, 1))).alias("format"),
        F.lit(False).alias("lazy"),
        F.lit(True).alias("responsive"),
        F.lit("source").alias("kind"),
    )
    return img.unionByName(src)


def summary(rows: DataFrame) -> DataFrame:
    """Per site totals, what lacks alt text (each image once), a histogram of formats as text, and what occurs at all."""
    key = ["run_id", "site"]
    per = rows.groupBy(*key, F.coalesce("format", F.lit("unknown")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    hist = per.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "n"))), lambda x: F.concat(x["f"], F.lit(":"), x["n"].cast("string"))), ",").alias("formats"))
    totals = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(~F.col("has_alt")).alias("missing_alt"),
        F.count_distinct("crawl_seq").alias("pages"),
        F.bool_or("lazy").alias("any_lazy"),
        F.bool_or("responsive").alias("any_responsive"),
        F.bool_or(F.col("format").isin("webp", "avif")).alias("any_modern"),
    )
    return totals.join(hist, key)


def oracle(q) -> str:
    """DuckDB tables ``images`` over ``fetches``, for the sources that the derived inputs hold."""
    at = lambda n: f"regexp_extract(t, {q(f'(?i){n}=[\"\']([^\"\']*)[\"\']')}, 1)"
    fmt = f"case lower(regexp_extract(s, {q(EXTENSION)}, 1)) when 'jpg' then 'jpeg' else lower(nullif(regexp_extract(s, {q(EXTENSION)}, 1), '')) end"
    site = "concat(regexp_extract(url, '(?i)^(https?:)', 1), '//', site)"
    where = f"case when s like 'http%' then s when s like '/%' then concat({site}, s) else concat({site}, regexp_replace(coalesce(nullif(regexp_extract(url, '(?i)^https?:/+[^/?#]*([^?#]*)', 1), ''), '/'), '[^/]*$', ''), s) end"
    return f"""images as (
  select site, crawl_seq, {where} as src, {at('alt')} <> '' as has_alt, {fmt} as format, {at('loading')} = 'lazy' as lazy, contains(lower(t), 'srcset=') as responsive, 'img' as kind
  from (select *, {at('src')} as s from (select site, crawl_seq, url, unnest(regexp_extract_all(html, {q(IMG)}, 0)) as t from fetches)) where s <> ''
  union all
  select site, crawl_seq, {where}, true, regexp_extract({at('type')}, '^image/(.*)$', 1), false, true, 'source'
  from (select *, regexp_extract({at('srcset')}, '^([^ ,]+)', 1) as s from (select site, crawl_seq, url, unnest(regexp_extract_all(html, {q(SOURCE)}, 0)) as t from fetches)) where s <> '')"""
