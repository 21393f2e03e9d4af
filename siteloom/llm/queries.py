"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import ann, byte_bpe, filter_audit, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    """The public rank file of the byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), rank_file())


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("rk")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("rk")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents")).drop("rk")


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def _remainder(divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"), _remainder(3) == 1)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_near_dedup, op3_source_mixing, op4_byte_bpe, op5_ring_sharding, op6_toxicity, op7_nearest_neighbours, op8_substring_dedup, op9_quality_rules, op10_language_id,
        op11_quality_classifier, op12_filter_audit, op13_whitening,
    )
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, i, string_split(text, chr(10))[i] as line
  from docs, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i) t),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (k in (from common)))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (k not in (from common)), '')) as kept_sha256
from keyed group by doc_id
""",
    "op12_filter_audit": r"""
with said as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
texts as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
worded as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as first from texts),
judged as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(words) < 100 then 'A' else '' end
         || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
         || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) then 'C' else '' end
         || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
         || case when coalesce(worded.doc_id > first, false) then 'E' else '' end as fails
  from worded left join said on said.doc_id = worded.doc_id),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by part, fails),
letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.f || b.f || c.f || d.f || e.f as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select o, s, o[s] as f, o[1:s - 1] as before from orders, (select unnest(range(1, 6)) as s) t),
marked as (
  select part, o, s, f, n, good, toxic, fails, contains(fails, f) as hit, len(list_filter(string_split(before, ''), lambda x: contains(fails, x))) > 0 and s > 1 as gone
  from cells, steps),
counted as (
  select part, o as filter_order, s::int as step, f,
         (coalesce(sum(n) filter (not gone and not hit), 0))::bigint as kept, (coalesce(sum(n) filter (not gone and hit), 0))::bigint as removed,
         (coalesce(sum(n) filter (gone and hit), 0))::bigint as redundant, (coalesce(sum(n) filter (fails = f), 0))::bigint as unique_fails,
         (coalesce(sum(good) filter (not gone and hit), 0))::bigint as good_lost, (coalesce(sum(toxic) filter (not gone and hit), 0))::bigint as toxic_lost
  from marked group by part, o, s, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from counted
""",
}
