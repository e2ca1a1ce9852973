"""From raw documents to token ids, in five stages.

Every stage takes the rows that its predecessor left and returns the columns of
``documents`` (the last one: ids). Its result is written as Parquet and read again
before the next one, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import line_dedup, mixing, ngram_join, quality
from passageworks.llm.common import SPACE, store, table
from passageworks.llm.queries import TARGETS, encoded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier; a document that loses all its words goes."""
    done = line_dedup.dedup_lines(docs)
    kept = done.where((F.col("_line_gone") == 0) | F.col("text").rlike(f"[^{SPACE}]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones."""
    return ngram_join.keep_first(docs, ngram_join.join_similar(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for them."""
    weights = [TARGETS[d] for d in mixing.DOMAINS]
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), mixing.domain_of(), weights)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and sampled segmentations of each document."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_duplicates),
    ("n-gram Jaccard join", similar_documents),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Sampling and cleared texts are not expressible in SQL; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
