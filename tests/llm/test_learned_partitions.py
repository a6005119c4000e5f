import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from trawl.llm import learned_partitions
from trawl.llm.learned_partitions import balanced_parts, best_pairs, fit, nearest, neighbours, unit


def by_hand(rows, every=50, k=5):
    """All (query, rank, id, score) over usable rows, one pair at a time."""
    found = []
    for q, a in sorted({(i, tuple(v)) for i, v in rows if i % every == 0}):
        scored = []
        for i, b in rows:
            if i != q:
                dot = sum(x * y for x, y in zip(a, b))
                scored.append((-dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), i))
        # Sums in another order differ in the last bits, which must not decide ties.
        scored = sorted((round(s, 12), i) for s, i in scored)[:k]
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return found


def result(df, **options):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in nearest(df, **options).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


def test_one_part_is_exact(vectors):
    vectors = vectors.filter("vec_id < 300")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    got, want = result(vectors), by_hand(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-11 for g, w in zip(got, want))


@pytest.mark.parametrize("sf, parts", [("sf0.01", 2), ("sf0.1", 8)])
def test_recall_on_given_tables_comes_from_several_parts(spark, monkeypatch, sf, parts):
    fitted, fit_parts = [], learned_partitions.fit
    monkeypatch.setattr(learned_partitions, "fit", lambda sample, n: (fitted.append(n), fit_parts(sample, n))[1])
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    got, want = result(vectors), by_hand(rows)
    hits = {g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}
    assert fitted == [parts] and len(got) == len(want) and len(hits) / len(want) >= 0.95


def test_recall_with_many_parts(vectors, monkeypatch):
    monkeypatch.setattr(learned_partitions, "SAMPLE_PER_PART", 40)
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", 30)
    monkeypatch.setattr(learned_partitions, "BLOCK_QUERIES", 4)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    got, want = result(vectors), by_hand(rows)
    assert len(got) == len(want)
    hits = {g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}
    assert len(hits) / len(want) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (50, [-1.0, 0.0]), (10, [2.0, 0.0]),
            (7, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, part string, vector string")
    got = [(q, rank, i) for q, rank, i, _ in result(df)]
    assert got == [(0, 1, 1), (0, 2, 10), (0, 3, 7), (0, 4, 7), (0, 5, 50),
                   (50, 1, 7), (50, 2, 7), (50, 3, 0), (50, 4, 1), (50, 5, 10)]


def test_no_rows_and_no_queries(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0])], df.schema)).collect() == []
    assert nearest(spark.createDataFrame([(50, [1.0])], df.schema)).collect() == []


def test_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", 100)
    monkeypatch.setattr(learned_partitions, "SAMPLE_PER_PART", 1000)
    df = spark.range(900).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(0.6), F.lit(0.8))).otherwise(
            F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert [g[:3] for g in result(df)] == [w[:3] for w in by_hand(rows)]


def test_other_queries(spark):
    df = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(99, [1.0, 0.0])], df.schema)
    assert [g[2] for g in result(df, queries=asked, k=3)] == [0, 1, 2]


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(8, 16)))
    units = unit(centres[rng.integers(8, size=800)] + 0.1 * rng.normal(size=(800, 16)))
    graph = neighbours(units, np.arange(800), 10)
    part = balanced_parts(units, graph, 4, rng)
    assert np.bincount(part, minlength=4).max() <= math.ceil(1.05 * 200)
    assert (part[graph] == part[:, None]).mean() > 0.7
    router = fit(units, 4)
    assert 1 <= router.visits < 4


def test_graph_of_a_full_sample_takes_little_memory():
    units = unit(np.random.default_rng(5).normal(size=(learned_partitions.SAMPLE_ROWS, 8)))
    tracemalloc.start()
    graph = neighbours(units, np.arange(len(units)), 10)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Beside the graph itself one block of rows against all others, not one for every block.
    assert graph.shape == (len(units), 10) and most < 64e6


def test_equal_vectors_share_a_score():
    vectors = np.random.default_rng(1).normal(size=(7, 64))
    rows = np.concatenate([vectors, vectors, vectors])
    _, ids, scores = best_pairs(np.array([100]), vectors[:1], np.arange(21), rows, 21)
    assert ids[:3] == [0, 7, 14] and len(set(scores)) == 7
