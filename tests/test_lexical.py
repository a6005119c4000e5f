import math
import os
import re
import sqlite3

import pytest
from helpers import TOY, as_dict, topics_of
from pyspark.sql import functions as F

from trawl.operators import index as index_module
from trawl.operators import lexical
from trawl.operators.index import analyse, build_index, count_terms, default_buckets, doc_lengths, extend_index, open_index, postings_of
from trawl.operators.lexical import bm25, bm25_fts5, match_any, match_phrases, pad, ts_rank
from trawl.operators.topk import top_k

QUERIES = ["dog", "dog dog", "cat", "runs", "unit", "u.s market", "cat dog run", "zebra", "hen.cow pig", "cow.hen",
           "3.bird bird", "-", "owl.emu.yak fox", "Dog CAT's"]


@pytest.fixture(scope="module")
def index(toy_docs):
    return build_index(toy_docs, analyzer="whitespace")


def sqlite_scores(docs, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id, contents, tokenize = 'porter')")
    con.executemany("INSERT INTO t VALUES (?, ?)", docs)
    match = " OR ".join('"' + word.replace('"', '""') + '"' for word in query.split())
    return dict(con.execute("SELECT id, -bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())


def close(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12, abs=1e-15)


def test_fts5_equals_sqlite_on_the_toy_corpus(spark, fts_index):
    got = as_dict(bm25_fts5(fts_index, topics_of(spark, *QUERIES)), ("qid", "id"), "score")
    want = {}
    for i, query in enumerate(QUERIES, 1):
        want |= {(f"q{i}", doc): score for doc, score in sqlite_scores(TOY, query).items()}
    close(got, want)
    assert got["q1", "d1"] == pytest.approx(2.0359587592822774)
    assert got["q2", "d1"] == pytest.approx(2 * 2.0359587592822774)
    assert got["q3", "cat-3"] == pytest.approx(0.231703186768)


def test_fts5_equals_sqlite_on_the_given_tables(spark, sf_dir):
    from trawl.plans.search import index_contents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents")
    )
    topics = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").cast("string").alias("qid"), F.regexp_replace("text", r"\. ", ".").alias("contents")
    )
    rows, queries = [tuple(r) for r in docs.collect()], topics.collect()
    got = as_dict(bm25_fts5(index_contents(docs, "fts5"), topics), ("qid", "id"), "score")
    want = {}
    for q in queries:
        want |= {(q.qid, doc): score for doc, score in sqlite_scores(rows, q.contents).items()}
    assert got.keys() == want.keys() and len(want) > 500
    for key, score in want.items():
        assert got[key] == pytest.approx(score, rel=1e-9)


def test_bm25_by_hand(spark, index):
    got = as_dict(bm25(index, topics_of(spark, "dog cat dog")), ("id",), "score")
    n, avgdl = 7, (3 + 2 + 3 + 4 + 3 + 3 + 2) / 7

    def part(df, tf, length):
        return math.log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * length / avgdl))

    close(got, {("d1",): part(1, 2, 3) + part(2, 1, 3), ("d2",): part(2, 1, 2)})


def test_classic_idf_can_be_negative(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a"), ("3", "a")], "id string, contents string")
    got = as_dict(bm25(build_index(docs), topics_of(spark, "a"), idf="classic"), ("id",), "score")
    assert all(score < 0 for score in got.values()) and len(got) == 3


def test_salted_shuffle_equals_broadcast(spark, monkeypatch):
    # "the" is in every document, far over the share at which a term is split.
    docs = spark.createDataFrame(
        [(f"d{i:03d}", f"the w{i % 7} x{i % 3} " + "the " * (i % 4)) for i in range(300)], "id string, contents string"
    )
    index = build_index(docs)
    topics = topics_of(spark, "the w1", "x2 w3 the", "the")
    one = as_dict(bm25(index, topics), ("qid", "id"), "score")
    ranks = as_dict(ts_rank(index, topics), ("qid", "id"), "score")
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lexical, "HOT_SHARE", 0.01)
    plan = bm25(index, topics)._jdf.queryExecution().analyzed().toString()
    assert "salt" in plan
    close(as_dict(bm25(index, topics), ("qid", "id"), "score"), one)
    close(as_dict(ts_rank(index, topics), ("qid", "id"), "score"), ranks)


def test_many_queries_equal_single_queries(spark, index):
    texts = ["dog cat", "fish bee", "u.s"]
    together = as_dict(bm25(index, topics_of(spark, *texts)), ("qid", "id"), "score")
    alone = {}
    for i, text in enumerate(texts, 1):
        rows = as_dict(bm25(index, topics_of(spark, text)), ("id",), "score")
        alone |= {(f"q{i}", *k): v for k, v in rows.items()}
    close(together, alone)


def test_partitions_change_nothing(spark, toy_docs):
    topics = topics_of(spark, "cat dog", "run u.s")
    few = as_dict(bm25(build_index(toy_docs, "whitespace", buckets=1), topics), ("qid", "id"), "score")
    many = as_dict(bm25(build_index(toy_docs.repartition(5), "whitespace", buckets=13), topics), ("qid", "id"), "score")
    close(many, few)


def test_empty_and_unknown_queries_have_no_hits(spark, index):
    assert bm25(index, topics_of(spark, "", "zebra", None)).count() == 0


def test_empty_documents_count_in_the_statistics(spark):
    docs = spark.createDataFrame([("1", "a a"), ("2", ""), ("3", None)], "id string, contents string")
    index = build_index(docs)
    stats = index.stats.first()
    assert (stats.n, stats.avgdl, stats.postings) == (3, 2 / 3, 1)
    assert sorted(index.doclens.collect()) == [("1", 2, 1), ("2", 0, 0), ("3", 0, 0)]
    assert index.postings.select("id", "term", "tf", "len").collect() == [("1", "a", 2, 2)]
    assert sorted(doc_lengths(docs).collect()) == sorted(index.doclens.select("id", "len").collect())


def test_counts_equal_an_ordinary_group_by(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    exploded = analyse(docs, "plain").select("id", F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    want = exploded.groupBy("id", "term").count()
    got = postings_of(docs).select("id", "term", F.col("tf").cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert count_terms(analyse(docs, "plain")).count() == docs.count()


def test_reopened_index_scores_the_same(spark, toy_docs, tmp_path):
    path = str(tmp_path / "index")
    built = build_index(toy_docs, "folded", positional=True, path=path)
    opened = open_index(spark, path)
    assert (opened.analyzer, opened.by) == ("folded", ())
    topics = topics_of(spark, "cat dog", "u.s")
    close(as_dict(bm25(opened, topics), ("qid", "id"), "score"), as_dict(bm25(built, topics), ("qid", "id"), "score"))
    assert opened.positional and "positions" in opened.postings.columns
    replaced = build_index(toy_docs.limit(2), "folded", path=path)
    assert replaced.doclens.count() == 2


def test_groups_are_corpora_of_their_own(spark):
    rows = [("en", "1", "a b"), ("en", "2", "a"), ("de", "1", "a c c"), ("de", "3", "d"), ("de", "4", "c")]
    docs = spark.createDataFrame(rows, "lang string, id string, contents string")
    topics = topics_of(spark, "a c")
    got = as_dict(bm25(build_index(docs, by=("lang",)), topics), ("lang", "id"), "score")
    want = {}
    for lang in ("en", "de"):
        alone = bm25(build_index(docs.filter(F.col("lang") == lang)), topics)
        want |= {(lang, *k): v for k, v in as_dict(alone, ("id",), "score").items()}
    close(got, want)
    own = topics.withColumn("lang", F.lit("de"))
    got = as_dict(bm25(build_index(docs, by=("lang",)), own), ("lang", "id"), "score")
    close(got, {k: v for k, v in want.items() if k[0] == "de"})


def test_padding(spark, index):
    topics = topics_of(spark, "cat", "zebra")
    hits = top_k(bm25(index, topics), 5)
    got = pad(hits, index, topics, 5).orderBy("qid", "rank").collect()
    assert [r.id for r in got if r.qid == "q1"] == ["d2", "d1", "cat-3", "d4", "d5"]
    assert [r.id for r in got if r.qid == "q2"] == ["cat-3", "d1", "d2", "d4", "d5"]
    assert [r.score for r in got if r.qid == "q1"][2:] == [0.0, 0.0, 0.0]
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 2
    everything = pad(top_k(bm25(index, topics), 50), index, topics, 50)
    assert everything.count() == 14


def test_negative_hits_sort_after_the_padding(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, contents string")
    index, topics = build_index(docs), topics_of(spark, "a")
    hits = top_k(bm25(index, topics, idf="classic"), 3)
    assert [r.id for r in pad(hits, index, topics, 3, hits).orderBy("rank").collect()] == ["3", "1", "2"]


def test_ts_rank_by_hand(spark):
    docs = spark.createDataFrame([("1", "a a b c"), ("2", "a"), ("3", "x " * 300)], "id string, contents string")
    index = build_index(docs, analyzer="simple")
    topics = topics_of(spark, "A & a | b! zebra", "x")
    got = as_dict(ts_rank(index, topics), ("qid", "id"), "score")
    unit = 0.1 / 1.64493406685
    capped = sum(1 / j**2 for j in range(1, 256))
    want = {("q1", "1"): (1.25 + 1) * unit / 3, ("q1", "2"): unit / 3, ("q2", "3"): capped * unit}
    close(got, want)
    got = as_dict(ts_rank(index, topics, norm=1), ("qid", "id"), "score")
    lens = {"1": 4, "2": 1, "3": 300}
    close(got, {k: v / math.log2(lens[k[1]] + 1) for k, v in want.items()})
    with pytest.raises(ValueError):
        ts_rank(index, topics, norm=2)


def test_match_any(spark, index):
    got = {tuple(r) for r in match_any(index, topics_of(spark, "cat bee", "yak")).collect()}
    assert got == {("q1", "d1"), ("q1", "d2"), ("q1", "d7"), ("q2", "d4")}


def test_phrases_need_order_and_adjacency(spark):
    docs = spark.createDataFrame(
        [("1", "a b a b a"), ("2", "b a"), ("3", "a x b"), ("4", "a a a"), ("a", "b")], "id string, contents string"
    )
    index = build_index(docs, with_id=True, positional=True)
    phrases = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", "b", "a"],), (["z", "a"],)], "phrase array<string>")
    got = {("".join(r.phrase), r.id): r.tf for r in match_phrases(index, phrases).collect()}
    # The id "a" and the contents "b" of the last document are not next to each other.
    assert got == {("ab", "1"): 2, ("aa", "4"): 2, ("aba", "1"): 2}
    longer = spark.createDataFrame([(list("ababa"),), (list("abab"),), (list("aaa"),), (list("aaaa"),), (list("babab"),)], "phrase array<string>")
    got = {("".join(r.phrase), r.id): r.tf for r in match_phrases(index, longer).collect()}
    assert got == {("ababa", "1"): 1, ("abab", "1"): 1, ("aaa", "4"): 1}


def test_extended_index_equals_one_built_at_once(spark, toy_docs, tmp_path):
    old, new = toy_docs.filter("id < 'd3'"), toy_docs.filter("id >= 'd3'")
    topics = topics_of(spark, "cat run dog", "u.s fox", "bee")
    path = str(tmp_path / "index")
    build_index(old, "folded", with_id=True, positional=True, path=path)
    extended = extend_index(new, path)
    whole = build_index(toy_docs, "folded", with_id=True, positional=True)
    for index in (extended, open_index(spark, path)):
        close(as_dict(bm25(index, topics), ("qid", "id"), "score"), as_dict(bm25(whole, topics), ("qid", "id"), "score"))
        close(as_dict(bm25_fts5(index, topics), ("qid", "id"), "score"), as_dict(bm25_fts5(whole, topics), ("qid", "id"), "score"))
        assert sorted(index.doclens.collect()) == sorted(whole.doclens.collect())
        assert index.positional


def test_padding_by_corpus(spark):
    rows = [("x", "1", "a"), ("x", "2", "b"), ("x", "3", "b"), ("y", "7", "c"), ("y", "8", "a c")]
    docs = spark.createDataFrame(rows, "corpus string, id string, contents string")
    index = build_index(docs, by=("corpus",))
    topics = spark.createDataFrame([("x", "q", "b"), ("y", "q", "z")], "corpus string, qid string, contents string")
    hits = top_k(bm25(index, topics), 3, by=("corpus",))
    got = pad(hits, index, topics, 3).orderBy("corpus", "rank").collect()
    assert [(r.corpus, r.id, r["rank"]) for r in got] == [("x", "2", 1), ("x", "3", 2), ("x", "1", 3), ("y", "7", 1), ("y", "8", 2)]


def test_buckets_follow_the_input_size(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert default_buckets(docs) == 4
    monkeypatch.setattr("trawl.operators.index.BUCKET_BYTES", 10_000)
    assert 10 < default_buckets(docs) < 100
    assert default_buckets(spark.range(1).rdd.toDF()) == 4


def test_buckets_fill_whole_rounds_of_tasks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for size in (10_000, 11_000, 13_000, 17_000):
        monkeypatch.setattr("trawl.operators.index.BUCKET_BYTES", size)
        assert default_buckets(docs) % 4 == 0


def test_hits_give_way_to_documents_scored_zero(spark):
    docs = spark.createDataFrame(
        [*((str(i), "a b" if i == 1 else "a") for i in range(1, 7)), ("7", "c"), ("8", "c")], "id string, contents string")
    index, topics = build_index(docs), topics_of(spark, "a b")
    scores = {**{r.id: r.score for r in bm25(index, topics, idf="classic").collect()}, "7": 0.0, "8": 0.0}
    for n in range(1, 10):
        every = bm25(index, topics, idf="classic")
        got = [r.id for r in pad(top_k(every, n), index, topics, n, every).orderBy("rank").collect()]
        assert got == sorted(scores, key=lambda i: (-round(scores[i], 10), i))[:n]


@pytest.mark.parametrize("path", ["quo'ted index", "plain"])
def test_relative_paths_and_quotes(spark, toy_docs, tmp_path, monkeypatch, path):
    folder = f"{tmp_path}/it's/{path}" if path != "plain" else os.path.relpath(f"{tmp_path}/index")
    build_index(toy_docs.limit(3), path=folder, positional=True)
    extend_index(toy_docs.exceptAll(toy_docs.limit(3)), folder)
    topics = topics_of(spark, "cat dog")
    whole = as_dict(bm25(build_index(toy_docs), topics), ("id",), "score")
    close(as_dict(bm25(open_index(spark, folder), topics), ("id",), "score"), whole)
    assert sorted(name.split("-")[0] for name in os.listdir(folder)) == ["build", "manifests"]
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, folder + "/manifests")


def test_builds_before_the_last_but_one_go(spark, toy_docs, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    path = str(tmp_path / "i")
    for _ in range(4):
        build_index(toy_docs, path=path)
        open_index(spark, path)
    assert len({t.name for t in spark.catalog.listTables()} - before) == 2
    assert sorted(name.split("-")[0] for name in os.listdir(path)) == ["build", "build", "manifests"]
    index_module.drop_index(spark, path)
    assert {t.name for t in spark.catalog.listTables()} == before and not os.path.exists(path)


def test_a_rebuild_that_breaks_off_leaves_the_old_index(spark, toy_docs, tmp_path, monkeypatch):
    path, topics = str(tmp_path / "index"), topics_of(spark, "cat dog fish run")
    built = build_index(toy_docs, path=path)
    want = as_dict(bm25(built, topics), ("id",), "score")
    for step in ("_append", "_write", "_publish"):
        with monkeypatch.context() as patch:
            patch.setattr(index_module, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                build_index(toy_docs.limit(2), path=path)
        close(as_dict(bm25(open_index(spark, path), topics), ("id",), "score"), want)
    # Whoever opened the index before a rebuild can go on with it.
    replaced = build_index(toy_docs.limit(2), path=path)
    close(as_dict(bm25(built, topics), ("id",), "score"), want)
    assert replaced.doclens.count() == open_index(spark, path).doclens.count() == 2


@pytest.mark.parametrize("by", [(), ("lang",)])
def test_an_extension_reads_no_old_postings(spark, toy_docs, tmp_path, by):
    import shutil

    docs = toy_docs.withColumn("lang", F.when(F.col("id") < "d4", "en").otherwise("de"))
    old, path = docs.filter("id < 'd3'"), str(tmp_path / "index")
    build_index(old, path=path, by=by)
    folder = next(f"{path}/{name}" for name in os.listdir(path) if name.startswith("build"))
    kept = f"{tmp_path}/kept"
    shutil.copytree(f"{folder}/postings/version=1/kind=1", kept)
    shutil.rmtree(f"{folder}/postings/version=1/kind=1")
    for name in ("blocks/version=1", "vocab/1"):
        for file in os.listdir(f"{folder}/{name}"):
            if file.endswith(".parquet"):
                os.chmod(f"{folder}/{name}/{file}", 0o400)
    extend_index(docs.filter("id >= 'd3'"), path)
    shutil.copytree(kept, f"{folder}/postings/version=1/kind=1")
    extended, whole = open_index(spark, path), build_index(docs, by=by)
    for name in ("vocab", "stats", "doclens"):
        assert sorted(getattr(extended, name).collect()) == sorted(getattr(whole, name).select(*getattr(extended, name).columns).collect())
    topics = topics_of(spark, "cat run dog", "u.s fox", "bee")
    close(as_dict(bm25(extended, topics), ("qid", "id"), "score"), as_dict(bm25(whole, topics), ("qid", "id"), "score"))


def test_many_extensions_keep_few_vocabularies(spark, tmp_path):
    import json

    rows = [(f"d{i}", f"w{i} w{i % 3} all") for i in range(6)]
    frame = lambda part: spark.createDataFrame(part, "id string, contents string")
    path = str(tmp_path / "index")
    build_index(frame(rows[:1]), path=path, buckets=2)
    for row in rows[1:]:
        extend_index(frame([row]), path)
    newest = sorted(os.listdir(f"{path}/manifests"))[-1]
    with open(f"{path}/manifests/{newest}") as file:
        manifest = json.load(file)
    assert len(manifest["versions"]) == 6 and len(manifest["vocab"]) <= 3
    whole = build_index(frame(rows))
    assert sorted(open_index(spark, path).vocab.collect()) == sorted(whole.vocab.collect())


def test_an_id_that_occurs_twice_is_an_error(spark, toy_docs, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="duplicate id.*d1"):
        build_index(toy_docs.unionByName(toy_docs.filter("id = 'd1'")), path=path)
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, path)
    more = toy_docs.select(F.concat(F.lit("new-"), "id").alias("id"), "contents")
    build_index(toy_docs, path=path)
    for wrong in (toy_docs.limit(1), more.unionByName(more)):
        with pytest.raises(ValueError, match="duplicate id"):
            extend_index(wrong, path)
    assert open_index(spark, path).stats.first().n == 7
    # The same id in another corpus is another document.
    both = toy_docs.withColumn("lang", F.lit("en")).unionByName(toy_docs.withColumn("lang", F.lit("de")))
    assert build_index(both, by=("lang",)).doclens.count() == 14


def test_an_extension_that_breaks_off_changes_nothing(spark, toy_docs, tmp_path, monkeypatch):
    path, topics = str(tmp_path / "index"), topics_of(spark, "cat dog fish run")
    old, new = toy_docs.filter("id < 'd3'"), toy_docs.filter("id >= 'd3'")
    want = as_dict(bm25(build_index(old, path=path), topics), ("id",), "score")
    monkeypatch.setattr(index_module, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        extend_index(new, path)
    monkeypatch.undo()
    close(as_dict(bm25(open_index(spark, path), topics), ("id",), "score"), want)
    extend_index(new, path)
    close(as_dict(bm25(open_index(spark, path), topics), ("id",), "score"), as_dict(bm25(build_index(toy_docs), topics), ("id",), "score"))


GROUPED = [("en", "1", "u.s market a b"), ("en", "2", "s u market"), ("en", "4", "a b c"), ("de", "1", "u.s u.s b"), ("de", "3", "d u s"),
           ("de", "4", "market b")]


@pytest.mark.parametrize("named", [False, True])
@pytest.mark.parametrize("scorer", ["bm25", "fts5", "ts_rank"])
def test_every_flavour_keeps_corpora_apart(spark, scorer, named):
    from trawl.plans.search import sparse_hits

    docs = spark.createDataFrame(GROUPED, "lang string, id string, contents string")
    topics = topics_of(spark, "u.s market", "b u.s d")
    options = {"analyzer": "folded", "with_id": True, "positional": True} if scorer == "fts5" else {"analyzer": "simple"}
    index = build_index(docs, by=("lang",), **options)
    want = {}
    for lang in ("en", "de"):
        alone = build_index(docs.filter(F.col("lang") == lang).drop("lang"), **options)
        for r in sparse_hits(alone, topics, scorer, 3).collect():
            want[lang, r.qid, r.id] = (r.score, r["rank"])
    if named:
        topics = topics.withColumn("lang", F.when(F.col("qid") == "q1", "de").otherwise("en"))
        want = {k: v for k, v in want.items() if k[:2] in (("de", "q1"), ("en", "q2"))}
    got = {(r.lang, r.qid, r.id): (r.score, r["rank"]) for r in sparse_hits(index, topics, scorer, 3).collect()}
    assert got == want and got


def test_ts_rank_reads_queries_as_its_index_does(spark):
    docs = spark.createDataFrame([("1", "running cats"), ("2", "the cat"), ("3", "dog")], "id string, contents string")
    index = build_index(docs, analyzer="english")
    got = as_dict(ts_rank(index, topics_of(spark, "the cats", "runs")), ("qid", "id"), "score")
    assert set(got) == {("q1", "1"), ("q1", "2"), ("q2", "1")}


def test_repetitions_without_a_cap(spark):
    docs = spark.createDataFrame([("1", "x " * 300)], "id string, contents string")
    index, topics = build_index(docs, analyzer="simple"), topics_of(spark, "x")
    unit = 0.1 / 1.64493406685
    close(as_dict(ts_rank(index, topics, cap=None), ("id",), "score"), {("1",): unit * sum(1 / j**2 for j in range(1, 301))})
    close(as_dict(ts_rank(index, topics, cap=2), ("id",), "score"), {("1",): unit * 1.25})


def test_hundreds_of_terms_are_pushed_down_and_places_read_once(spark, toy_docs):
    index = build_index(toy_docs, positional=True)
    topics = topics_of(spark, " ".join(f"w{i}" for i in range(300)) + " cat")
    plan = bm25(index, topics)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
    assert any("In(term" in line for line in pushed)
    assert "positions" not in plan.split("ReadSchema")[-1]
    phrases = spark.createDataFrame([(["bird", "run"],)], "phrase array<string>")
    plan = match_phrases(index, phrases)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def phrases_by_hand(rows, phrases):
    found = {}
    for phrase in phrases:
        for doc_id, text in rows:
            words = text.split()
            tf = sum(words[i:i + len(phrase)] == phrase for i in range(len(words)))
            if tf:
                found[" ".join(phrase), doc_id] = (tf, len(words))
    return found


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 2.0])
def test_phrases_with_any_set_of_frequent_words(spark, monkeypatch, share):
    import random

    monkeypatch.setattr(index_module, "FREQUENT_SHARE", share)
    rng = random.Random(7)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 30)}"
    rows = [(f"d{i}", " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    phrases = [[word() for _ in range(rng.randrange(1, 6))] for _ in range(80)] + [["w1"] * 4, ["w1", "w2"] * 2, ["unseen", "w1"]]
    index = build_index(spark.createDataFrame(rows, "id string, contents string"), positional=True)
    assert bool(index.frequent) == (share < 1)
    singles = {(t,) for t in index.frequent}
    found = match_phrases(index, spark.createDataFrame([(p,) for p in phrases if tuple(p) not in singles], "phrase array<string>"))
    got = {(" ".join(r.phrase), r.id): (r.tf, r.len) for r in found.collect()}
    assert got == phrases_by_hand(rows, phrases_of(phrases, singles)) and got
    # The pairs are no postings of words.
    plain = build_index(spark.createDataFrame(rows, "id string, contents string"))
    assert sorted(index.vocab.collect()) == sorted(plain.vocab.collect())
    assert sorted(index.doclens.collect()) == sorted(plain.doclens.collect())


def phrases_of(phrases, without):
    return [p for p in {tuple(p): p for p in phrases}.values() if tuple(p) not in without]


def test_places_are_read_for_selective_postings_only(spark, toy_docs):
    docs = spark.createDataFrame([(f"d{i}", f"the of w{i} the of") for i in range(50)], "id string, contents string")
    index = build_index(docs, positional=True)
    phrases = spark.createDataFrame([("the of w7 the".split(),), ("of w9".split(),), ("w3 the of".split(),)], "phrase array<string>")
    found = match_phrases(index, phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "PushedFilters" in line and "positions" in line]
    assert len(scans) == 1 and "In(term" in scans[0] and not re.search(r"[\[,](the|of)[,\]]", scans[0])
    assert not [s for s in plan.split("\n") if "hashpartitioning(id" in s]
    assert {(" ".join(r.phrase), r.id) for r in found.collect()} == {("the of w7 the", "d7"), ("of w9", "d9"), ("w3 the of", "d3")}


@pytest.mark.parametrize("density", [0.0, 0.1, 0.9, 1.0])
def test_padding_at_any_density(spark, monkeypatch, density):
    import random

    monkeypatch.setattr(lexical, "CELL", 4)
    rng = random.Random(density)
    rows = [(f"d{i:03d}", "a" if rng.random() < density else "b") for i in range(90)]
    rng.shuffle(rows)
    index = build_index(spark.createDataFrame(rows, "id string, contents string"))
    topics = topics_of(spark, "a", "b", "zebra", "a b")
    scores = {qid: {} for qid in ("q1", "q2", "q3", "q4")}
    every = bm25(index, topics, idf="classic")
    for r in every.collect():
        scores[r.qid][r.id] = round(r.score, 10)
    for n in (7, 100):
        got = pad(top_k(every, n), index, topics, n, every).collect()
        for qid, known in scores.items():
            want = sorted((-known.get(i, 0.0), i) for i, _ in rows)[:n]
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid] == [i for _, i in want]


def test_padding_by_corpus_at_any_density(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELL", 3)
    rows = [(c, f"{i:02d}", "a" if i % k else "b") for c, k in (("x", 2), ("y", 9), ("z", 1)) for i in range(20)]
    index, topics = build_index(spark.createDataFrame(rows, "c string, id string, contents string"), by=("c",)), topics_of(spark, "a", "b")
    every = bm25(index, topics, idf="classic")
    known = {(r.c, r.qid, r.id): round(r.score, 10) for r in every.collect()}
    got = pad(top_k(every, 6, by=("c",)), index, topics, 6, every).collect()
    for c in "xyz":
        for qid in ("q1", "q2"):
            want = sorted((-known.get((c, qid, i), 0.0), i) for d, i, _ in rows if d == c)[:6]
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if (r.c, r.qid) == (c, qid)] == [i for _, i in want]


def test_a_bucket_is_sorted_by_term_alone(spark, toy_docs):
    """The postings of 32 MB of input meet in a task, which sorts them by term and not by columns that are alike there."""
    assert default_buckets(spark.range(50_000_000)) >= 12
    index = build_index(toy_docs.repartition(3), "plain", positional=True, buckets=2)
    files = index.postings.inputFiles()
    table = next(t.name for t in spark.catalog.listTables() if t.name.startswith("trawl_") and index.path in spark.sql(
        f"DESCRIBE EXTENDED {t.name}").filter("col_name = 'Location'").first().data_type)
    described = {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    assert described["Num Buckets"] == "2" and described.get("Sort Columns", "[]") == "[]"
    for file in files:
        terms = [row.term for row in spark.read.parquet(file).select("term").collect()]
        assert terms == sorted(terms)


def test_places_of_odd_tokens(spark):
    """Places are sorted with the text of their token, whatever characters it holds."""
    docs = spark.createDataFrame([("d", "a\x01 a 000 a ab a\x01 1000000003 a")], "id string, contents string")
    counts = count_terms(analyse(docs, "whitespace"), positional=True, frequent=("a",)).first().counts
    found = {c.term: (c.tf, list(c.positions)) for c in counts}
    assert found["a"] == (3, [1, 3, 7]) and found["a\x01"] == (2, [0, 5]) and found["1000000003"] == (1, [6])
    assert found["a 000"] == (1, [2 - 1]) and found["000 a"] == (1, [2]) and found["a\x01 a"] == (1, [0])


def test_a_phrase_of_one_stored_pair_is_looked_up_once(spark, monkeypatch):
    """Only phrases of several units need the documents that hold all of them and the places there."""
    import trawl.operators.lexical as lexical

    docs = spark.createDataFrame([(f"d{i}", f"the cat the cat x{i} owl") for i in range(5)], "id string, contents string")
    index = build_index(docs, "plain", positional=True)
    phrases = spark.createDataFrame([(["the", "cat"],)], "phrase array<string>")
    longer = spark.createDataFrame([(["x1", "owl", "zzz"],), (["cat", "x1", "owl"],)], "phrase array<string>")
    asked, met = [], lexical._met
    monkeypatch.setattr(lexical, "_met", lambda *args: (asked.append(1), met(*args))[1])
    assert sorted((r.id, r.tf, r.len) for r in match_phrases(index, phrases).collect()) == [(f"d{i}", 2, 6) for i in range(5)]
    assert not asked
    both = match_phrases(index, phrases.unionByName(longer)).collect()
    assert asked and sorted((len(r.phrase), r.id, r.tf) for r in both) == [*((2, f"d{i}", 2) for i in range(5)), (3, "d1", 1)]
