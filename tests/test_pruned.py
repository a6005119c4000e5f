import random

import pytest
from helpers import topics_of
from pyspark.sql import functions as F

from trawl.operators import index as index_module
from trawl.operators import pruned
from trawl.operators.index import build_index, open_index
from trawl.operators.lexical import bm25_terms, fts5_terms, query_phrases, score_all, ts_rank_terms
from trawl.operators.pruned import best, split_terms, spread_sample
from trawl.operators.topk import top_k


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(index_module, "SAMPLE_DOCUMENTS", 200)
    monkeypatch.setattr(pruned, "PRUNE_FROM", 0)


def corpus(spark, size, seed=1):
    """Zipf-like texts; a third of the documents are copies of one another."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randrange(0, 60))]
        text = "w1 w2 w90 w91" if i % 3 == 0 else " ".join(words)
        rows.append((f"d{i:04d}", "en" if i % 5 else "de", text))
    return spark.createDataFrame(rows, "id string, lang string, contents string")


def queries(spark, count, seed=2):
    rng = random.Random(seed)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.4)), 400)}" for _ in range(rng.randrange(1, 12))) for _ in range(count)]
    return topics_of(spark, *texts, "w90", "w91 w2 w1", "", "unseen", "w1")


def same(index, weighted, n, used=True):
    assert pruned._worth_it(index, weighted) == used
    got = best(index, weighted, n).orderBy("qid", "rank").collect()
    want = top_k(score_all(index, weighted), n, index.by).orderBy("qid", "rank").collect()
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("n", [1, 10, 100, 2000])
def test_bm25_equals_scoring_everything(spark, always, n):
    index = build_index(corpus(spark, 1500))
    same(index, bm25_terms(index, queries(spark, 25)), n)


def test_other_flavours_and_groups(spark, always):
    docs, topics = corpus(spark, 800), queries(spark, 15)
    simple = build_index(docs, "simple")
    same(simple, ts_rank_terms(simple, topics), 5)
    same(simple, ts_rank_terms(simple, topics, norm=1), 5)
    folded = build_index(docs, "folded", with_id=True)
    same(folded, fts5_terms(folded, query_phrases(topics, "folded")), 5)
    grouped = build_index(docs, by=("lang",))
    same(grouped, bm25_terms(grouped, topics), 5)


def test_given_tables(spark, always, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents"))
    topics = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("contents"))
    index = build_index(docs)
    same(index, bm25_terms(index, topics), 5)


def test_large_candidate_tables_are_not_broadcast(spark, always, monkeypatch):
    index = build_index(corpus(spark, 600))
    weighted = bm25_terms(index, queries(spark, 10))
    monkeypatch.setattr(pruned, "BROADCAST_BYTES", -1)
    same(index, weighted, 5)


def test_frequent_words_are_not_essential(spark, always):
    docs = spark.createDataFrame(
        [(f"d{i:04d}", "the of and " + ("rare words here" if i % 10 == 0 else f"x{i}")) for i in range(1000)],
        "id string, contents string",
    )
    index = build_index(docs)
    split = split_terms(index, bm25_terms(index, topics_of(spark, "the rare words of and here")), 3, 1e-6)
    essential = {r.term: r.essential for r in split.collect()}
    assert not (essential["the"] or essential["of"] or essential["and"])
    assert essential["rare"] or essential["words"] or essential["here"]


def test_negative_weights_are_not_pruned(spark, always):
    index = build_index(corpus(spark, 300))
    weighted = bm25_terms(index, queries(spark, 5), idf="classic")
    same(index, weighted, 5, used=False)


def test_the_sample_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "SAMPLE_DOCUMENTS", 100)
    for size in (300, 1500):
        path = str(tmp_path / str(size))
        built = build_index(corpus(spark, size), path=path)
        assert 30 < built.sample.select("id").distinct().count() < 200
        assert open_index(spark, path).sample.count() == built.sample.count()


def test_large_topic_tables_are_pruned_in_chunks(spark, always, monkeypatch):
    index = build_index(corpus(spark, 600))
    weighted = bm25_terms(index, queries(spark, 20))
    monkeypatch.setattr(pruned, "CHUNK_TERMS", 15)
    same(index, weighted, 5)
    monkeypatch.setattr("trawl.operators.lexical.BROADCAST_BYTES", -1)
    same(index, bm25_terms(index, queries(spark, 20)), 5)


def test_phrases_leave_pruning_on(spark, always):
    from trawl.operators.lexical import bm25_fts5
    from trawl.plans.search import sparse_hits

    index = build_index(corpus(spark, 500), "folded", with_id=True, positional=True)
    topics = topics_of(spark, "w1.w2 w90", "w2 w3.w1 w5 w7", "w90.w91 w1 w2", "w1")
    want = sorted(top_k(bm25_fts5(index, topics), 8).collect())
    for prune in (True, False):
        assert sorted(sparse_hits(index, topics, "fts5", 8, prune=prune).collect()) == want


def test_blocks_bound_their_documents(spark, always, monkeypatch):
    """No document scores more than the parts of its block allow, and the hits lie in open blocks."""
    monkeypatch.setattr(index_module, "BLOCK_DOCUMENTS", 8)
    index = build_index(corpus(spark, 600))
    weighted = bm25_terms(index, queries(spark, 20))
    split = pruned.split_terms(index, weighted, 5, 1e-6)
    blocks, counted = pruned.open_blocks(index, weighted, split)
    every = index.blocks.select("block").distinct().count()
    open_pairs = {(r.qid, r.block) for r in blocks.collect()}
    assert counted["rows"] == len(open_pairs) < 0.6 * every * split.select("qid").distinct().count()
    of_document = {r.id: r.block for r in index.postings.select("id", "block").distinct().collect()}
    for hit in top_k(score_all(index, weighted), 5).collect():
        assert (hit.qid, of_document[hit.id]) in open_pairs
    same(index, weighted, 5)


def test_blocks_without_hits_are_not_read(spark, always, monkeypatch):
    """Words that are everywhere, and often in short documents, which share some blocks."""
    monkeypatch.setattr(index_module, "BLOCK_DOCUMENTS", 16)
    monkeypatch.setattr(index_module, "PAGE_ROWS", 64)
    rows = [(f"d{i:05d}", "hot cold " * (40 if i < 300 else 1) + " ".join(f"x{i}-{k}" for k in range(400 if i >= 300 else 20))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "id string, contents string").repartition(4)
    index = build_index(docs, "whitespace", buckets=2)
    weighted = bm25_terms(index, topics_of(spark, "hot cold"))
    split, _ = pruned.stored(pruned.split_terms(index, weighted, 3, 1e-6))
    blocks, counted = pruned.open_blocks(index, weighted, split)
    left = pruned._in_blocks(index, blocks, counted).postings.filter(F.col("term").isin("hot", "cold"))
    assert "In(block" in left._jdf.queryExecution().executedPlan().toString()

    def rows_read(df):
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    every = rows_read(index.postings.filter(F.col("term").isin("hot", "cold")))
    assert rows_read(left) < every / 5 and every >= 12000
    same(index, weighted, 3)


def test_bounds_are_tried_later_for_ts_rank(spark, monkeypatch):
    """Its bounds leave most documents, and floors cost as much as scoring the whole sample."""
    assert pruned.PRUNE_FROM >= 10_000_000
    monkeypatch.setattr(pruned, "PRUNE_FROM", 1)
    docs, topics = corpus(spark, 300), queries(spark, 10)
    index = build_index(docs, "simple")
    assert pruned._worth_it(index, bm25_terms(index, topics))
    assert not pruned._worth_it(index, ts_rank_terms(index, topics, norm=1))


def test_the_sample_is_scored_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(index_module, "SAMPLE_DOCUMENTS", 300)
    # Two buckets of sixteen, as many as files and tasks without the shuffle.
    index = build_index(corpus(spark, 2400), buckets=16)
    weighted = bm25_terms(index, queries(spark, 5))
    spread = spread_sample(index, weighted)
    assert spread.select("id").distinct().count() > 100
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4
    weights = weighted.terms.select("term").distinct()
    assert spread.count() == index.sample.join(weights, "term", "left_semi").count()
