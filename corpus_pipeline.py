"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller
writes as Parquet and rereads as the next stage's documents. All but the last
return the columns of documents; the mix also their position, which is the
order of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import decontaminate, mixing, near_dedup, quality_rules, token_orc
from queuelens.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.positioned_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_orc.encode_documents(docs, mixing.placed_by(docs.columns))


STAGES = [("quality", quality), ("near_dedup", near), ("decontaminate", clean), ("mix", mixed), ("tokens", tokens)]

#: The tokenizer has no SQL form; tests check the stages one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
