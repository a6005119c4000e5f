"""Top-k per query, self-hit filter, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Scores that differ by less are ties: the last bits of a floating sum depend on its order.
DIGITS = 10
# Every input partition sends at most n rows for a query. Up to this many rows, or lists of up to so
# many hits where the partitions are not known, are merged in one task; else in POOLS tasks first.
ONE_TASK = 100_000
ONE_LEVEL = 100
POOLS = 128
LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def limit_rows_to(spark: SparkSession, n: int) -> None:
    """Let Spark cut groups to n rows before the shuffle; by default it does so up to 1000 rows only."""
    if int(spark.conf.get(LIMIT_CONF)) < n:
        spark.conf.set(LIMIT_CONF, n)


def _cut(scored: DataFrame, n: int, keys: list[str]) -> DataFrame:
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= n)


def top_k(
    scored: DataFrame, n: int, by: tuple[str, ...] = (), digits: int | None = DIGITS, partitions: int | None = None,
) -> DataFrame:
    """The n best ``(by, qid, id, score)`` rows of each query, with ranks from 1.

    Ties go to the smaller id. Scores are rounded before ranking; ``digits=None`` keeps them. The
    row limit is applied inside every partition before the shuffle by query, whatever n is.
    ``partitions`` is how many ``scored`` has, if known.
    """
    limit_rows_to(scored.sparkSession, n)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    keys = [*by, "qid"]
    if (n > ONE_LEVEL) if partitions is None else (n * partitions > ONE_TASK):
        pooled = scored.withColumn("pool", F.spark_partition_id() % POOLS)
        scored = _cut(pooled, n, [*keys, "pool"]).drop("pool", "rank")
    return _cut(scored, n, keys)


def rerank(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Close the gaps in the ranks after hits were removed."""
    in_order = Window.partitionBy(*by, "qid").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(in_order))


def drop_self(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Remove a query's own id from its hits; the list is not refilled, ranks start at 1 again."""
    others = hits.filter(~F.col("id").cast("string").eqNullSafe(F.col("qid").cast("string")))
    return rerank(others, by)
