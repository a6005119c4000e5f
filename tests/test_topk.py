import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import topk
from trawl.operators.topk import drop_self, rerank, top_k


def scored(spark, rows):
    return spark.createDataFrame(rows, "qid string, id string, score double")


def test_ties_go_to_the_smaller_id(spark):
    rows = [("q", "b", 1.0), ("q", "a", 1.0 + 1e-12), ("q", "c", 2.0), ("q", "d", 1.0)]
    got = top_k(scored(spark, rows), 3).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [("c", 1), ("a", 2), ("b", 3)]


def test_unrounded(spark):
    rows = [("q", "b", 1.0000001), ("q", "a", 1.0)]
    assert [r.id for r in top_k(scored(spark, rows), 2, digits=None).orderBy("rank").collect()] == ["b", "a"]


@pytest.mark.parametrize("n", [1, 7, 50])
def test_two_levels_equal_one(spark, monkeypatch, n):
    rng = random.Random(n)
    rows = [(f"q{rng.randrange(4)}", f"d{i}", rng.randrange(30) / 7) for i in range(4000)]
    df = scored(spark, rows).repartition(16)
    one = sorted(top_k(df, n).collect())
    monkeypatch.setattr(topk, "ONE_LEVEL", 0)
    assert sorted(top_k(df, n).collect()) == one
    assert all(r["rank"] <= n for r in one)


def test_a_query_with_a_third_of_all_rows(spark):
    rows = [("hot" if i % 3 == 0 else f"q{i}", f"d{i:05d}", float(i % 11)) for i in range(3000)]
    got = top_k(scored(spark, rows).repartition(16), 5).filter("qid = 'hot'").orderBy("rank").collect()
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:5]
    assert [r.id for r in got] == [r[1] for r in want]


def test_drop_self_closes_the_gap(spark):
    hits = top_k(scored(spark, [("q", "a", 3.0), ("q", "q", 2.0), ("q", "b", 1.0), ("p", "q", 1.0)]), 3)
    got = {(r.qid, r.id): r["rank"] for r in drop_self(hits).collect()}
    assert got == {("q", "a"): 1, ("q", "b"): 2, ("p", "q"): 1}


def test_integer_ids_equal_text_ids(spark):
    hits = spark.createDataFrame([(7, "7", 1.0, 1), (7, "8", 0.5, 2)], "qid long, id string, score double, rank int")
    assert [r.id for r in drop_self(hits).collect()] == ["8"]


def test_rerank_keeps_order(spark):
    hits = top_k(scored(spark, [("q", c, float(i)) for i, c in enumerate("abcde")]), 5).filter(F.col("rank") % 2 == 1)
    assert [r.id for r in rerank(hits).orderBy("rank").collect()] == ["e", "c", "a"]


@pytest.mark.parametrize("n", [10, 1001, 5000])
def test_the_row_limit_stands_before_every_shuffle(spark, n):
    rows = spark.range(0, 100_000, 1, 5000)
    df = rows.select((F.col("id") % 3).alias("qid"), F.col("id").cast("string").alias("id"), F.rand(1).alias("score"))
    plan = top_k(df, n)._jdf.queryExecution().executedPlan().toString()
    first = plan[:plan.index("Range")].rindex("Exchange")
    assert "WindowGroupLimit" in plan[first:]
    # Partitions are pooled by their number, not by the shuffle setting.
    assert ("pool" in plan) == (n > topk.ONE_LEVEL)
