import pytest
from helpers import topics_of
from pyspark.sql import functions as F

from trawl.plans.search import index_contents, method_of, search
from trawl.sources.corpus import load_sparse


@pytest.fixture(scope="module")
def sparse(toy_docs):
    return load_sparse(toy_docs, "english")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("d1", [1.0, 0.0]), ("d2", [0.8, 0.6]), ("d4", [0.0, 1.0]), ("v9", [-1.0, 0.0])]
    return spark.createDataFrame(rows, "id string, embedding array<double>")


@pytest.fixture(scope="module")
def topics(spark):
    topics = topics_of(spark, "The running cats", "owls").withColumn("qid", F.when(F.col("qid") == "q1", "d2").otherwise("q2"))
    return topics.withColumn("vector", F.array(F.lit(1.0), F.lit(0.5)))


def ids(hits, qid):
    return [r.id for r in hits.filter(F.col("qid") == qid).orderBy("rank").collect()]


def test_sparse_analyses_queries_and_drops_the_self_hit(sparse, topics):
    hits = search(topics, [index_contents(sparse, "bm25")])
    assert ids(hits, "d2") == ["cat-3", "d1"] and ids(hits, "q2") == ["d4"]
    assert [r["rank"] for r in hits.filter("qid = 'd2'").orderBy("rank").collect()] == [1, 2]
    raw = search(topics, [index_contents(sparse, "bm25")], analyzer=None)
    assert ids(raw, "d2") == []


@pytest.mark.parametrize("flavour", ["bm25", "fts5", "ts_rank"])
def test_flavours_find_the_same_documents(sparse, topics, flavour):
    hits = search(topics, [index_contents(sparse, flavour)], flavour=flavour)
    extra = {"cat-3"} if flavour == "fts5" else set()
    assert set(ids(hits, "d2")) == {"cat-3", "d1"} | extra


def test_padded(sparse, topics):
    hits = search(topics, [index_contents(sparse, "bm25")], n=4, padded=True)
    assert ids(hits, "q2") == ["d4", "cat-3", "d1", "d2"]


def test_dense(vectors, topics):
    assert ids(search(topics, [vectors]), "q2") == ["d2", "d1", "d4", "v9"]
    assert ids(search(topics, [vectors], n=2), "d2") == ["d1"]


def test_hybrid_in_either_order(sparse, vectors, topics):
    index = index_contents(sparse, "bm25")
    one = sorted(search(topics, [index, vectors], n=5).collect())
    two = sorted(search(topics, [vectors, index], n=5).collect())
    assert one == two and len(one) > 5
    ranked = search(topics, [vectors, index_contents(sparse, "ts_rank")], flavour="ts_rank", rrf_k=10)
    assert ids(ranked, "q2")[0] in ("d4", "d2")


def test_errors(sparse, vectors, topics):
    index = index_contents(sparse, "bm25")
    assert (method_of([index]), method_of([vectors]), method_of([vectors, index])) == ("sparse", "dense", "hybrid")
    with pytest.raises(ValueError):
        method_of([index, index])
    with pytest.raises(ValueError):
        search(topics, [index], method="hybrid")
    with pytest.raises(ValueError):
        search(topics, [vectors], method="sparse")
    with pytest.raises(ValueError):
        search(topics, [index], method="graph")
    with pytest.raises(ValueError):
        search(topics, [index], flavour="other")


def test_corpora_are_searched_and_ranked_apart(spark, sparse, vectors, topics):
    def both(df):
        return df.withColumn("corpus", F.lit("x")).unionByName(df.withColumn("corpus", F.lit("y")))

    index = index_contents(both(sparse), "bm25", by=("corpus",))
    for tables, alone in (
        ([index], [index_contents(sparse, "bm25")]), ([both(vectors)], [vectors]),
        ([index, both(vectors)], [vectors, index_contents(sparse, "bm25")]),
    ):
        want = sorted((r.qid, r.id, r.score, r["rank"]) for r in search(topics, alone, n=4).collect())
        rows = search(topics, tables, n=4, by=("corpus",)).collect()
        for corpus in ("x", "y"):
            assert sorted((r.qid, r.id, r.score, r["rank"]) for r in rows if r.corpus == corpus) == want
        own = topics.withColumn("corpus", F.when(F.col("qid") == "q2", "x").otherwise("none"))
        got = search(own, tables, n=4, by=("corpus",)).collect()
        assert sorted((r.qid, r.id, r.score, r["rank"]) for r in got if r.corpus == "x") == [w for w in want if w[0] == "q2"]
    with pytest.raises(ValueError, match="corpus columns"):
        search(topics, [index, vectors])


def test_readme_example(spark, tmp_path, monkeypatch):
    import json
    import os

    from trawl.operators.evaluate import mean_ndcg
    from trawl.operators.index import open_index
    from trawl.sources.corpus import parse_corpus, read_raw, read_table, read_topics
    from trawl.sources.trec import read_qrels, run_tag, write_run

    folder = os.path.relpath(tmp_path)  # relative, as in the README
    (tmp_path / "corpus").mkdir()
    (tmp_path / "embeddings").mkdir()
    texts = {"1": "A cat runs", "2": "Dogs run", "3": "Fish"}
    (tmp_path / "corpus/a.jsonl").write_text("".join(json.dumps({"_id": i, "title": "T", "text": t}) + "\n" for i, t in texts.items()))
    (tmp_path / "embeddings/v.jsonl").write_text("".join(json.dumps({"id": i, "vector": [float(i), 1.0]}) + "\n" for i in texts))
    (tmp_path / "topics.jsonl").write_text(json.dumps({"id": "q", "contents": "running cats", "vector": [1.0, 1.0]}) + "\n")
    (tmp_path / "qrels.txt").write_text("q 0 1 1\n")
    corpus = parse_corpus(read_raw(spark, f"{folder}/corpus/"))
    index_contents(corpus, "bm25", path=f"{folder}/index/")
    index = open_index(spark, f"{folder}/index/")
    topics = read_topics(spark, f"{folder}/topics.jsonl")
    assert ids(search(topics, [index], n=1000), "q") == ["1", "2"]
    vectors = read_table(spark, f"{folder}/embeddings/", "dense", dim=2)
    hybrid = search(topics, [index, vectors], n=1000)
    write_run(hybrid, f"{folder}/run/", run_tag("hybrid", "bm25"))
    assert mean_ndcg(hybrid, read_qrels(spark, f"{folder}/qrels.txt")).first() == (1, 1.0)
