"""JSON-LD of pages: declared types, at any depth or at the top, and parse errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.sources.scratch import RECURSIVE, keep

KEY = ["run_id", "site"]
#: A declared type that names a product: a string, or one in an array of strings.
_STRING = r'"(?:[^"\\]|\\.)*'
PRODUCT = rf'(?i)"@type"\s*:\s*(?:\[\s*(?:{_STRING}"\s*,\s*)*)?{_STRING}product'


def _type_names(node: Column) -> Column:
    """@type of a variant object: one string or an array of them."""
    declared = F.try_variant_get(node, "$['@type']", "variant")
    text = lambda v: F.schema_of_variant(v) == "STRING"
    many = F.filter(F.try_variant_get(declared, "$", "array<variant>"), text)
    names = F.when(text(declared), F.array(declared)).otherwise(F.coalesce(many, F.array().cast("array<variant>")))
    return F.transform(names, lambda v: F.try_variant_get(v, "$", "string"))


def block_facts() -> dict[str, Column]:
    """invalid_schema_count and has_product_schema (a type containing ``product``, at any depth) from the blocks in ``ld_json``.

    In valid JSON a quote inside a string is escaped, so a key and its value cannot be imitated by text; a block with escapes is
    written anew, so that a type spelled with them is seen."""
    valid = F.filter("ld_json", lambda b: F.try_parse_json(b).isNotNull())
    plain = lambda b: F.when(F.contains(b, F.lit("\\")), F.to_json(F.try_parse_json(b))).otherwise(b)
    return {"invalid_schema_count": F.size("ld_json") - F.size(valid), "has_product_schema": F.exists(valid, lambda b: plain(b).rlike(PRODUCT))}


#: Levels of nesting that are followed; blocks nested deeper raise.
LEVELS = 10_000
_WALK = f"""
with recursive walk(run_id, site, crawl_seq, url, v) max recursion level {LEVELS} as (
  select run_id, site, crawl_seq, url, v from {{blocks}}
  union all
  select run_id, site, crawl_seq, url, x.value
  from walk, lateral variant_explode(walk.v) x
  where not (x.key <=> '@type') and schema_of_variant(x.value) rlike '^(OBJECT|ARRAY)')
select * from walk
"""


def all_types(signals: DataFrame) -> DataFrame:
    """run_id, site, crawl_seq, url, schema_type: each declared type at any depth; ParseError for a block that is no JSON.

    The walk is one recursive plan over the blocks, however deep they nest.
    """
    keys = [*KEY, "crawl_seq", "url"]
    blocks = keep(signals.select(*keys, F.explode("ld_json").alias("b")), "json-ld").withColumn("v", F.try_parse_json("b"))
    walk = signals.sparkSession.sql(_WALK, blocks=blocks.where("v is not null").select(*keys, "v"))
    named = walk.select(*keys, F.explode(_type_names(F.col("v"))).alias("schema_type")).where("schema_type is not null")
    broken = blocks.where("v is null").select(*keys, F.lit("ParseError").alias("schema_type"))
    return broken.unionByName(keep(named, "json-ld-types", RECURSIVE))


def page_schema(signals: DataFrame) -> DataFrame:
    """Per page: distinct types of the top level or of @graph items, parse errors, and what kinds they show."""
    keys = [*KEY, "crawl_seq", "url"]
    graph = F.try_variant_get(F.col("v"), "$['@graph']", "array<variant>")
    items = F.when(graph.isNotNull(), graph).otherwise(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")))
    blocks = signals.select(*keys, F.explode_outer("ld_json").alias("b")).withColumn("v", F.try_parse_json("b"))
    types = F.flatten(F.transform(items, _type_names))
    rows = blocks.select(*keys, F.when(F.col("v").isNotNull(), types).alias("t"), (F.col("b").isNotNull() & F.col("v").isNull()).cast("int").alias("e"))
    pages = rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("types"), F.sum("e").alias("parse_errors"))
    has = lambda *names: F.exists("types", lambda t: F.lower(t).isin(*names))
    # names of types are fixed values
    return pages.withColumns(
        {
            "is_product": has("product", "https://schema.org/product", "http://schema.org/product"),
            "is_article": has("article", "newsarticle", "blogposting", "https://schema.org/article", "http://schema.org/article"),
            "is_organization": has("organization", "localbusiness", "corporation", "https://schema.org/organization", "http://schema.org/organization"),
        }
    )


def kind_pages(signals: DataFrame) -> DataFrame:
    """run_id, site, kind (product, article, organization), crawl_seq, url: the pages of each kind, a row each."""
    pages = page_schema(signals)
    kinds = F.array_compact(F.array(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in ("product", "article", "organization"))))
    return pages.select(*KEY, F.explode(kinds).alias("kind"), "crawl_seq", "url")


def summary(signals: DataFrame) -> DataFrame:
    """Per site: sorted distinct types, pages of each kind, parse errors."""
    pages = page_schema(signals)
    types = pages.select(*KEY, F.explode("types").alias("t")).groupBy(*KEY).agg(F.array_sort(F.collect_set("t")).alias("types"))
    totals = pages.groupBy(*KEY).agg(*(F.count_if(f"is_{k}").alias(f"{k}_pages") for k in ("product", "article", "organization")), F.sum("parse_errors").alias("parse_errors"))
    return totals.join(types, KEY, "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
