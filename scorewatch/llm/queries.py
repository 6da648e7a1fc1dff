"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm import audit, bpe, decontaminate, negatives, pii, quality, simhash, suffixes, token_files, toxicity, warc, winnow, wrappers
from scorewatch.llm.common import crc_remainder, new_folder, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs).withColumnRenamed("__entities", "n_entities")


def op2_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "neighbours", "cosines"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.read_archives(manifest)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(docs, new_folder(spark, "tokens"), WORD_TOKENIZER, END_ID)
    return token_files.read_tokens(manifest)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_byte_network, op3_deep_shallow, op4_toxicity, op5_simhash, op6_string_tiling, op7_winnowing, op8_warc, op9_token_files, op10_byte_bpe, op11_hard_negatives, op12_filter_audit, op13_wrappers)}

# Base32 takes five bits at a time: four letters from every five hexadecimal digits.
OP8_WARC = """
with paged as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
groups as (select *, max(page_id) over (partition by hex) as largest from paged)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(hex, cast(1 + 5 * (i // 4) as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id = largest then null else largest end as refers_to
from groups"""

OP12_FILTER_AUDIT = r"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
worded as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from docs),
marked as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
failing as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(words) < 200 then 'A' else '' end)
    || (case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end)
    || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end) as fails
  from worded left join marked using (doc_id)),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failing group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, substr(filter_order, cast(step as int), 1) as letter from orders, range(1, 6) s(step)),
met as (
  select part, filter_order, step, letter, n, good, toxic, fails = letter as alone, contains(fails, letter) as fails_it,
    step > 1 and regexp_matches(fails, '[' || filter_order[1:step - 1] || '_]') as gone
  from steps, cells),
counted as (
  select part, filter_order, step, letter,
    sum(case when not gone and not fails_it then n else 0 end) as kept,
    sum(case when not gone and fails_it then n else 0 end) as removed,
    sum(case when gone and fails_it then n else 0 end) as redundant,
    sum(case when alone then n else 0 end) as unique_fails,
    sum(case when not gone and fails_it then good else 0 end) as good_lost,
    sum(case when not gone and fails_it then toxic else 0 end) as toxic_lost
  from met group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from counted"""

OP11_HARD_NEGATIVES = """
with fit as (
  select row_number() over () as r, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as int) as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.r as anchor, a.vec_id as anchor_id, c.r as other, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from fit a, fit c where a.vec_id % 100 = 0 and a.r <> c.r),
positives as (
  select anchor, anchor_id, other, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor, p.other order by n.score desc, n.vec_id) as int) as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor = p.anchor and not n.same
  and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify rank <= 10"""

CHECKS = {"op11_hard_negatives": OP11_HARD_NEGATIVES, "op8_warc": OP8_WARC, "op12_filter_audit": OP12_FILTER_AUDIT}
