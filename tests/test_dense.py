import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions.vectors import norm
from trawl.operators import dense
from trawl.operators.dense import cosine_top_k


def table(spark, rows, key="id", value="embedding"):
    return spark.createDataFrame(rows, f"{key} string, {value} array<double>")


def brute(docs, topics, n):
    want = {}
    for qid, q in topics:
        if not np.any(q):
            continue
        scores = [(round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 6) + 0.0, d) for d, v in docs if np.any(v)]
        for rank, (score, doc) in enumerate(sorted(scores, key=lambda s: (-s[0], s[1]))[:n], 1):
            want[qid, doc] = (score, rank)
    return want


def result(df):
    return {(r.qid, r.id): (round(r.score, 6), r["rank"]) for r in df.collect()}


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    vectors[100:240] = vectors[7]  # a third of all rows are copies
    vectors[300] = 0.0
    docs = [(f"d{i:03d}", v.tolist()) for i, v in enumerate(vectors)]
    topics = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(9, 8)))]
    topics += [("copy", vectors[7].tolist()), ("zero", [0.0] * 8)]
    return docs, topics


@pytest.mark.parametrize("n", [1, 10, 150, 1000])
def test_equals_brute_force(spark, data, n, monkeypatch):
    docs, topics = data
    monkeypatch.setattr(dense, "BLOCK_SCORES", 300)
    monkeypatch.setattr(dense, "SLAB_BYTES", 50 * 8 * 8)
    got = result(cosine_top_k(table(spark, docs).repartition(5), table(spark, topics, "qid", "vector"), n))
    assert got == brute(docs, topics, n)


def test_chunks_of_queries_change_nothing(spark, data, monkeypatch):
    docs, topics = data
    monkeypatch.setattr(dense, "QUERY_BYTES", 3 * 8 * 8)
    got = result(cosine_top_k(table(spark, docs), table(spark, topics, "qid", "vector"), 5))
    assert got == brute(docs, topics, 5)


def test_no_chunk_passes_the_driver_and_topics_are_computed_once(spark, data, monkeypatch):
    docs, topics = data
    monkeypatch.setattr(dense, "QUERY_BYTES", 3 * 8 * 8)
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    asked = table(spark, topics, "qid", "vector")
    for name in ("collect", "toArrow", "toPandas"):
        whole = getattr(type(asked), name)
        monkeypatch.setattr(type(asked), name, lambda df, whole=whole: whole(df) if "vector" not in df.columns else pytest.fail("vectors on the driver"))
    hits = cosine_top_k(table(spark, docs), asked.mapInArrow(count, asked.schema), 5)
    assert hits.count() == 50 and runs.value == len(topics)


def test_corpora_have_rankings_of_their_own(spark, data):
    docs, topics = data
    parted = [(*d, "even" if i % 2 else "odd") for i, d in enumerate(docs)]
    df = spark.createDataFrame(parted, "id string, embedding array<double>, lang string").repartition(3)
    rows = cosine_top_k(df, table(spark, topics, "qid", "vector"), 7, by=("lang",)).collect()
    for lang in ("even", "odd"):
        own = {(r.qid, r.id): (round(r.score, 6), r["rank"]) for r in rows if r.lang == lang}
        assert own == brute([d[:2] for d in parted if d[2] == lang], topics, 7)
    named = spark.createDataFrame([(*t, "odd" if i % 2 else "none") for i, t in enumerate(topics)], "qid string, vector array<double>, lang string")
    rows = cosine_top_k(df, named, 7, by=("lang",)).collect()
    got = {(r.qid, r.id): (round(r.score, 6), r["rank"]) for r in rows}
    assert got == brute([d[:2] for d in parted if d[2] == "odd"], topics[1::2], 7) and {r.lang for r in rows} == {"odd"}


def test_stored_norms_are_used(spark, tmp_path):
    from trawl.sources.corpus import open_table, write_table

    docs = table(spark, [("a", [3.0, 4.0]), ("b", [0.0, 2.0])])
    write_table(docs, str(tmp_path / "t"))
    stored = open_table(spark, str(tmp_path / "t"))
    assert {r.id: r.norm for r in stored.collect()} == {"a": 5.0, "b": 2.0}
    topics = table(spark, [("q", [1.0, 0.0])], "qid", "vector")
    assert result(cosine_top_k(stored, topics, 2)) == result(cosine_top_k(docs, topics, 2))


def test_zero_vectors_have_no_score(spark):
    rows = [("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("nan", [float("nan"), 1.0]), ("hole", [None, 1.0]), ("inf", [float("inf"), 1.0])]
    docs = table(spark, rows)
    got = cosine_top_k(docs, table(spark, [("q", [2.0, 0.0]), ("zero", [0.0, 0.0])], "qid", "vector"), 5)
    assert result(got) == {("q", "a"): (1.0, 1)}


def test_wrong_length_fails(spark):
    docs = table(spark, [("a", [1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="embedding lengths"):
        cosine_top_k(docs, table(spark, [("q", [1.0, 0.0])], "qid", "vector"), 5).collect()
    with pytest.raises(Exception, match="embedding lengths"):
        cosine_top_k(docs, table(spark, [("q", [1.0, 0.0]), ("p", [1.0])], "qid", "vector"), 5)


def test_no_topics(spark):
    docs = table(spark, [("a", [1.0])])
    assert cosine_top_k(docs, table(spark, [], "qid", "vector"), 5).collect() == []


def test_norm(spark):
    assert table(spark, [("a", [3.0, 4.0])]).select(norm(F.col("embedding"))).first()[0] == 5.0


def test_floors_keep_rows_out_of_the_merge(spark, data, monkeypatch):
    docs, topics = data
    # Eight tasks, which the copies do not fill.
    others = [d for d in docs if not "d100" <= d[0] < "d240"]
    df = spark.sparkContext.parallelize(others, 8).toDF("id string, embedding array<double>")
    docs, asked = others, table(spark, topics, "qid", "vector")
    monkeypatch.setattr(dense, "SLAB_BYTES", 20 * 8 * 8)
    monkeypatch.setattr(dense, "FLOOR_ROWS", 120)
    monkeypatch.setattr(dense, "FLOORS_FROM", float("inf"))
    without = dense.candidates(df, asked, 10).count()
    monkeypatch.setattr(dense, "FLOORS_FROM", 0)
    assert dense.candidates(df, asked, 10).count() < 0.7 * without
    for n in (1, 10, 150, 1000):
        assert result(cosine_top_k(df, asked, n)) == brute(docs, topics, n)
    parted = df.withColumn("lang", F.when(F.col("id") < "d350", "a").otherwise("b"))
    rows = cosine_top_k(parted, asked, 20, by=("lang",)).collect()
    for lang, own in (("a", [d for d in docs if d[0] < "d350"]), ("b", [d for d in docs if d[0] >= "d350"])):
        assert {(r.qid, r.id): (round(r.score, 6), r["rank"]) for r in rows if r.lang == lang} == brute(own, topics, 20)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_scratch_addresses(spark, data, tmp_path, monkeypatch, scheme):
    docs, topics = data
    monkeypatch.setattr(dense, "scratch_dir", lambda _: f"{scheme}{tmp_path}/s")
    assert result(cosine_top_k(table(spark, docs), table(spark, topics, "qid", "vector"), 3)) == brute(docs, topics, 3)


def test_queries_that_are_gone_are_an_error(spark, data, tmp_path, monkeypatch):
    docs, topics = data
    monkeypatch.setattr(dense, "scratch_dir", lambda _: str(tmp_path / "s"))
    hits = cosine_top_k(table(spark, docs), table(spark, topics, "qid", "vector"), 3)
    gone = next((tmp_path / "s" / "topics").glob("*.parquet"))
    gone.unlink()
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        hits.collect()


def test_corpora_of_any_type(spark):
    import datetime

    rows = [("a", [1.0, 0.0], datetime.date(2020, 1, 1), 1.5, True), ("b", [0.0, 1.0], None, 2.5, False)]
    docs = spark.createDataFrame(rows, "id string, embedding array<double>, day date, x double, yes boolean")
    found = cosine_top_k(docs, table(spark, [("q", [1.0, 1.0])], "qid", "vector"), 5, by=("day", "x", "yes")).collect()
    assert {(r.id, r.day, r.x, r.yes, r["rank"]) for r in found} == {("a", datetime.date(2020, 1, 1), 1.5, True, 1), ("b", None, 2.5, False, 1)}
