"""The queries opN_<name>, each its operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, jaccard, mixing, quality, secrets, substrings, urlfilter, warc
from .common import new_table

TOKENIZERS = os.environ.get("ORDINA_TOKENIZERS", "/opt/tokenizers")
#: Rules of op4, and hosts that it blocks where no rule fits.
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
BLOCKED_HOSTS = ("spam-farm.example.org",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "share", "n_changed")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    read = warc.original_records(warc.read_archive(spark, path))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), allow=ALLOW, block=BLOCK, blocked_hosts=BLOCKED_HOSTS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chat(turns, tokenizer_file=f"{TOKENIZERS}/byte_bpe_50k.json"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), finish=lambda kept: F.sha2(kept, 256))
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_archive": op3_warc_archive,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_links": op7_secret_links,
    "op8_chat_format": op8_chat_format,
    "op9_mix": op9_mix,
    "op10_substring_dedup": op10_substring_dedup,
}
