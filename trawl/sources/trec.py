"""Run files and relevance judgements in TREC layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import natural_key


def run_tag(method: str, flavour: str) -> str:
    return f"{method}_{flavour}"


def run_lines(hits: DataFrame, tag: str, digits: int | None = 6) -> DataFrame:
    """Lines ``qid Q0 docid rank score tag`` with the columns that order them."""
    score = F.col("score").cast("string") if digits is None else F.format_string(f"%.{digits}f", "score")
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "id", F.col("rank").cast("string"), score, F.lit(tag))
    return hits.select("qid", "rank", line.alias("line"))


def write_run(hits: DataFrame, path: str, tag: str, digits: int | None = None) -> None:
    """Write a run in natural query order, then rank order."""
    lines = run_lines(hits, tag, digits).orderBy(natural_key(F.col("qid")), "rank")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _cells(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.select(F.split("line", r"\s+").alias("c"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, id, rank, score, tag)``."""
    return _cells(spark, path).select(
        F.col("c")[0].alias("qid"),
        F.col("c")[2].alias("id"),
        F.col("c")[3].cast("int").alias("rank"),
        F.col("c")[4].cast("double").alias("score"),
        F.col("c")[5].alias("tag"),
    )


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, id, rel)`` from lines ``qid iteration docid rel``."""
    return _cells(spark, path).select(
        F.col("c")[0].alias("qid"), F.col("c")[2].alias("id"), F.col("c")[3].cast("int").alias("rel")
    )
