import math

import pytest
from helpers import topics_of
from pyspark.sql import functions as F

from trawl.operators.evaluate import combine_topics, judge_by_runs, mean_ndcg, ndcg
from trawl.operators.fusion import rrf
from trawl.operators.topk import top_k


def hits(spark, rows):
    return top_k(spark.createDataFrame(rows, "qid string, id string, score double"), 100)


def fuse(spark, a, b, **options):
    return {(r.qid, r.id): r.score for r in rrf(hits(spark, a), hits(spark, b), 10, **options).collect()}


def test_rrf_adds_shared_documents(spark):
    got = fuse(spark, [("q", "a", 9.0), ("q", "b", 8.0)], [("q", "b", 0.9), ("q", "c", 0.8)])
    assert got == pytest.approx({("q", "b"): 1 / 62 + 1 / 61, ("q", "a"): 1 / 61, ("q", "c"): 1 / 62})


def test_rrf_is_symmetric(spark):
    a = [("q", c, float(ord(c) % 5)) for c in "abcdefg"]
    b = [("q", c, float(ord(c) % 3)) for c in "cdefghi"]
    for ties in ("row_number", "rank"):
        assert fuse(spark, a, b, ties=ties) == pytest.approx(fuse(spark, b, a, ties=ties))


def test_rank_lets_ties_share(spark):
    got = fuse(spark, [("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 0.5)], [("q", "z", 1.0)], ties="rank", k=10)
    assert got == pytest.approx({("q", "a"): 1 / 11, ("q", "b"): 1 / 11, ("q", "c"): 1 / 13, ("q", "z"): 1 / 11})


def test_query_in_one_list_only(spark):
    assert set(fuse(spark, [("p", "a", 1.0)], [("q", "a", 1.0)])) == {("p", "a"), ("q", "a")}


def qrels(spark, rows):
    return spark.createDataFrame(rows, "qid string, id string, rel int")


def test_ndcg_by_hand(spark):
    run = hits(spark, [("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "x", 1.0)])
    judged = qrels(spark, [("q1", "a", 1), ("q1", "b", 3), ("q1", "c", 2), ("q1", "x", -1), ("q2", "a", 1), ("q3", "a", 0)])
    got = {r.qid: r.ndcg for r in ndcg(run, judged).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert got == pytest.approx({"q1": (1 + 3 / math.log2(3)) / ideal, "q2": 0.0, "q3": 0.0})
    mean = mean_ndcg(run, judged).first()
    assert (mean.queries, mean.ndcg) == (3, pytest.approx(got["q1"] / 3))


def test_ties_go_to_the_larger_id_whatever_the_rank(spark):
    run = hits(spark, [("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 1.0)])
    assert ndcg(run, qrels(spark, [("q", "c", 1)]), cut=1).first().ndcg == 1.0
    assert ndcg(run, qrels(spark, [("q", "a", 1)]), cut=1).first().ndcg == 0.0


def test_combine_topics(spark):
    topics = topics_of(spark, "cat", "dog")
    vectors = spark.createDataFrame([("q1", [1.0]), ("q2", [2.0]), ("q9", [3.0])], "qid string, vector array<double>")
    assert sorted(combine_topics(topics, vectors).collect()) == [("q1", "cat", [1.0]), ("q2", "dog", [2.0])]
    with pytest.raises(Exception, match="no vector for topic q2"):
        combine_topics(topics, vectors.filter("qid = 'q1'")).collect()


def test_corpora_are_averaged_apart(spark):
    run = hits(spark, [("q", "a", 1.0)])
    both = run.withColumn("corpus", F.lit("x")).unionByName(run.withColumns({"corpus": F.lit("y"), "id": F.lit("b")}))
    judged = spark.createDataFrame([("x", "q", "a", 1), ("y", "q", "a", 1)], "corpus string, qid string, id string, rel int")
    got = {r.corpus: r.ndcg for r in mean_ndcg(both, judged, by=("corpus",)).collect()}
    assert got == {"x": 1.0, "y": 0.0}


def test_unknown_tie_rule(spark):
    with pytest.raises(ValueError):
        rrf(hits(spark, [("q", "a", 1.0)]), hits(spark, [("q", "a", 1.0)]), 3, ties="dense_rank")


def test_every_rank_of_a_deep_list_survives(spark):
    from trawl.operators.topk import top_k as cut

    rows = spark.range(1000).select(F.lit("q").alias("qid"), F.format_string("d%04d", "id").alias("id"), (-F.col("id")).cast("double").alias("score"))
    fused = rrf(cut(rows, 1000), cut(rows.limit(0), 1000), 1000).orderBy("rank").collect()
    assert [r.id for r in fused] == [f"d{i:04d}" for i in range(1000)]
    assert len({r.score for r in fused}) == 1000


def test_judgements_by_shared_runs(spark):
    from trawl.operators.evaluate import judge_by_runs

    docs = spark.createDataFrame([("x", "1", "A b, c d e"), ("x", "2", "a b x c d"), ("y", "1", "z b c d z b c d"), ("y", "5", None)],
                                 "corpus string, id string, contents string")
    topics = topics_of(spark, "b c d", "a b c d", "c d", "")
    got = sorted(tuple(r) for r in judge_by_runs(docs, topics, 3, ("corpus",)).collect())
    assert got == [("x", "q1", "1", 1), ("x", "q2", "1", 1), ("y", "q1", "1", 1), ("y", "q2", "1", 1)]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_judgements_by_hand(spark, monkeypatch, limit):
    monkeypatch.setattr("trawl.operators.evaluate.BROADCAST_BYTES", limit)
    docs = [("1", "a b c d"), ("2", "a b. A b a-b"), ("3", "b c"), ("4", ""), ("5", None), ("6", "c b a"), ("7", "x d b c")]
    docs = spark.createDataFrame(docs, "id string, contents string")
    got = judge_by_runs(docs, topics_of(spark, "A b b c", "b a b", "d", "b c b c b", ""), 2).collect()
    assert sorted((r.qid, r.id, r.rel) for r in got) == [
        ("q1", "1", 1), ("q1", "2", 1), ("q1", "3", 1), ("q1", "7", 1), ("q2", "1", 1), ("q2", "2", 1),
        ("q2", "6", 1), ("q4", "1", 1), ("q4", "3", 1), ("q4", "6", 1), ("q4", "7", 1)]
