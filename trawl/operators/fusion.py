"""Reciprocal rank fusion of two hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.topk import top_k


def rrf(
    sparse: DataFrame,
    dense: DataFrame,
    n: int,
    k: int = 60,
    ties: str = "row_number",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``(by, qid, id, score, rank)``: sum of 1 / (k + rank) over the lists a document is in.

    Both lists are cut to n already. ``ties="rank"`` lets equal scores share a rank; a cut list
    gives the same shared ranks as the whole one, since all better documents are in it.
    The lists are stacked and summed: the full outer join of two lists without joining. A sum of two
    numbers does not depend on their order, so nothing is rounded and every rank counts.
    """
    if ties not in ("row_number", "rank"):
        raise ValueError(f"ties must be row_number or rank, got {ties}")
    keys = [*by, "qid"]
    lists = [hits.select(*keys, "id", "score", "rank") for hits in (sparse, dense)]
    if ties == "rank":
        best_first = Window.partitionBy(*keys).orderBy(F.desc("score"))
        lists = [hits.withColumn("rank", F.rank().over(best_first)) for hits in lists]
    part = 1.0 / (F.lit(float(k)) + F.col("rank"))
    fused = lists[0].unionByName(lists[1]).groupBy(*keys, "id").agg(F.sum(part).alias("score"))
    return top_k(fused, n, by, digits=None)
