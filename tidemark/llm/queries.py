"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hilbert, linededup, linequality, neardup, pii, quality, shards, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A fixed key, so that runs can be compared; a real one belongs in a secret store.
DEMO_KEY = b"tidemark demonstration key"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(read(spark, sf_dir, "documents"), DEMO_KEY)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = shards.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return shards.read_shards(docs, out)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rules_from(block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = linequality.fit(docs, labels.filter(remainder != 2))
    out = linequality.scored(docs, model)
    return out.select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard(read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = r"""
with doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
item_words as (
  select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
item_windows as (
  select distinct item, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, i, list_slice(w, i, i + n - 1) as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, sizes where len(w) >= n)),
met as (select d.doc_id, d.n, d.i, t.item from doc_windows as d join item_windows as t on d.n = t.n and d.win = t.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(s.n_items, 0) as bigint) as n_items,
       sha256(coalesce(s.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words as d left join hit as h using (doc_id) left join its as s using (doc_id)
"""

OP6_SQL = """
with parts as (
  select page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
hosts as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts),
split as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from hosts),
rules as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                        ('org', '/fr/', 'allow')) as r(rule_host, rule_path, verdict)),
fits as (
  select s.page_id, r.rule_host || r.rule_path as rule, r.verdict,
         row_number() over (partition by s.page_id order by length(r.rule_host || r.rule_path) desc) as k
  from split as s join rules as r
    on (s.host = r.rule_host or ends_with(s.host, '.' || r.rule_host)) and starts_with(s.path, r.rule_path))
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split as s left join fits as f on f.page_id = s.page_id and f.k = 1
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_winnowing": OP5_SQL, "op6_url_filter": OP6_SQL}
