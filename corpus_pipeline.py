"""A corpus pipeline: language, toxicity, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondeur.llm import common, language, mixing, packing, simhash, toxicity

#: Share of a text's letters in the predicted language below which it is of no language.
LEAST_LANGUAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has. Texts without letters, and those that no language fits, go."""
    common.ship(spark)
    return language.keep(docs, language.fit(docs), LEAST_LANGUAGE)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as learned from those of them that have labels."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    common.ship(spark)
    return simhash.dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens of sources, languages and topics have their target shares."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    common.ship(spark)
    return packing.packed(docs)


STAGES = [("language ID", language_id), ("toxicity", toxic_text), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("best-fit packing", packed)]

#: SQL has no tokenizer, compressor or trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
