"""The corpus pipeline: documents in, a clean and weighted mix out.

Stages in order: documents that the quality classifier rejects go; one document of each group of near copies stays;
documents that hold benchmark items go; secrets inside texts are replaced by a mark; the rest is mixed by source.
Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, in the columns of ``documents``; the
last adds ``size, source_size, target, taken`` and returns the documents of which words are taken.

Null ids, texts and sources, empty and very long texts, repeated rows and empty tables have the results that the
operators' docstrings state; a column of ``documents`` that is called as one of the last stage's is left out there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import decontaminate, jaccard, mixing, quality, secrets
from ordina.llm.common import free_name, materialise, text_key

#: Documents of a lower probability of good quality are rejected.
LEAST_QUALITY = 0.3
#: Near copies share this many hundredths of their runs of so many words; op6 has thresholds of its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
MIX_COLUMNS = ("size", "source_size", "target", "taken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return quality.score(docs, model, name=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last."""
    return jaccard.keep_one(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = [free_name(docs, x) for x in ("_k1", "_k2")]
    gone = materialise(found.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).distinct(), "contaminated")
    k1, k2 = text_key(F.coalesce("text", F.lit("")))
    return docs.join(gone, (k1 == F.col(names[0])) & (k2 == F.col(names[1])), "left_anti").select(*docs.columns)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` following the text."""
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, and how many."""
    columns = [c for c in docs.columns if c not in MIX_COLUMNS]
    mixed = mixing.mix_sources(docs, keep=[c for c in columns if c != "doc_id"])
    return mixed.where("taken > 0").select(*columns, *MIX_COLUMNS)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mark_secrets),
    ("mixing sources to target weights", mix),
]

#: A fitted network and components of links are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
