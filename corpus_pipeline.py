"""From raw documents to packed training sequences: five stages over the whole table.

Language identification, exact dedup, near dedup, mixing to target weights, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import crf, dart_minhash, exact_dedup, mixing, packing
from trawl.llm.queries import DEFAULT_SHARE, PACKING_TOKENIZER, SHARES
from trawl.llm.tables import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language stay; texts without a letter and hopeless mixtures go."""
    return crf.drop_unclear(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    return dart_minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources to their target shares."""
    return mixing.mixed(docs, SHARES, DEFAULT_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, which follow the order of the mix."""
    return packing.packed_digests(docs, PACKING_TOKENIZER, in_order=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The language model and the near-copy search have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to ``documents``; every stage is written before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
