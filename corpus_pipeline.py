"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and
read again before the next. All stages but the last return the columns of documents. Null ids pass every stage that decides
by id; rows of one id stay or go together where a stage decides by id, so equal rows of one id all stay; n_chars follows the
text. Tables without rows give tables without rows, and columns beyond those of documents are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import bpe_encode, read_ranks
from plumbline.llm.decontamination import contaminated
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.ngram_join import similar_components
from plumbline.llm.quality_rules import learn_quality_rules, quality_verdicts
from plumbline.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns a decision list from labels and drops the documents that it or the base rules reject."""
    rules = learn_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality_verdicts(docs, rules).where("kept").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that three or more documents share, but in the last of them."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    groups = similar_components(docs.where(F.col("doc_id").isNotNull()))
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, re-parameterised or not."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text."""
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Learned rules and components of any depth are beyond one SQL query; tests/llm hold the stages' operators against brute force
#: or an exact library, and the whole against a small corpus whose survivors are known.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
