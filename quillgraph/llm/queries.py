"""One query for each operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, htmltext, minhash, packing, quality, rollups, secretscan, urlfilter
from .common import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a batch that inserts all documents, its second delivery, one that withdraws the toxic ones, and one that counts
    all that are labelled anew: revisions, and inserts of those withdrawn. What counts in the end is each document once."""
    rollup = rollups.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    changes = written(rollups.counted(docs, bpe.default_path()), "counted")
    rollup.apply("load", changes)
    rollup.apply("load", changes)
    named = labels.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    rollup.apply("withdrawn", changes.join(named.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    rollup.apply("recounted", changes.join(named.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("op", F.lit("revise")))
    return rollup.totals()


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"), bpe.default_path()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.scores(docs, model)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.verdicts(pages, urlfilter.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts look like the template's marks."""
    tricky = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    return chat.digests(chat.formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scans, op2_best_fit_packing, op3_token_counts, op4_quality_classifier, op5_minhash_near_dedup, op6_html_extraction, op7_benchmark_decontamination, op8_exact_dedup, op9_url_filters, op10_chat_formatting)
}

ORACLE_SQL = {
    "op7_benchmark_decontamination": r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select distinct item_id, least(len(w), 8) n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) i from bw where len(w) > 0)),
sizes as (select distinct n from win),
grams as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) + 1)) i from dw), sizes where i + n - 1 <= len(w)),
hits as (select doc_id, i, grams.n, item_id from grams join win on grams.g = win.g and grams.n = win.n),
places as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from dw left join places using (doc_id) left join items using (doc_id)
""",
    "op8_exact_dedup": """
select doc_id, max(doc_id) over t keep_id, count(*) over t group_size, doc_id = max(doc_id) over t kept, sha256(coalesce(text, '')) text_sha256
from documents window t as (partition by coalesce(text, ''))
""",
}
