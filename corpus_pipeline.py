"""The corpus pipeline: stages over `documents`.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm.bootstrap_pii import redact
from strata.llm.circulant_minhash import near_components
from strata.llm.common import by_ids
from strata.llm.complement_packing import pack_documents
from strata.llm.golomb_dedup import exact_dedup
from strata.llm.subword_quality import keep_good
from strata.session import cut_lineage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from
    the labelled ones among them."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact copies, the one that stays."""
    return by_ids(docs, cut_lineage(exact_dedup(docs).filter("not kept").select("doc_id")), "left_anti")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return by_ids(docs, cut_lineage(near_components(docs).filter("not kept").select("doc_id")), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in a sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("pii", without_personal_data),
    ("best-fit packing", packed),
]

#: The classifier is learnt, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written once."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
