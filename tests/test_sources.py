import gzip
import json

import pytest
from pyspark.sql import functions as F

from trawl.sources import corpus, trec


def lines(*objects):
    return "".join(json.dumps(o) + "\n" for o in objects)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.jsonl").write_text(lines({"id": "deep", "contents": "x"}))
    (tmp_path / "a.jsonl").write_text(
        lines({"_id": "1", "title": "Cats", "text": "and dogs", "metadata": {"k": 1}}, {}, {"id": "2", "contents": "fish"})
    )
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(lines({"key": 3, "body": "nuggets", "n": 7, "none": None}))
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("4\tone\ttwo words\n5\n")
    (tmp_path / "d.tsv.jsonl").write_text(lines({"id": "6", "title": "no text", "contents": "both"}))
    (tmp_path / "e.txt").write_text("not read\n")
    return tmp_path


def test_read_raw(spark, folder):
    rows = {r.id: r.contents for r in corpus.read_raw(spark, str(folder)).collect()}
    assert rows == {
        "1": "Cats and dogs", "2": "fish", "3": "nuggets 7 None", "4": "one two words", "5": "", "6": "both",
    }


def test_first_field_is_the_id_whatever_its_name(spark):
    df = spark.createDataFrame([('{"z": "id1", "a": "x", "b": "y"}',)], "line string")
    assert corpus.parse_json_lines(df).first() == ("id1", "x y")


def test_bad_json_fails(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.parse_json_lines(spark.createDataFrame([("{oops",)], "line string")).collect()


def test_parse_and_write(spark, folder, tmp_path):
    parsed = corpus.parse_corpus(corpus.read_raw(spark, str(folder)))
    out = str(tmp_path / "parsed")
    corpus.write_parsed(parsed, out)
    back = spark.read.json(out)
    rows = {r.id: r.contents for r in back.collect()}
    assert rows["1"] == "cat dog" and rows["5"] == ""
    first = next(line for f in (tmp_path / "parsed").glob("part-*") for line in f.read_text().splitlines())
    assert list(json.loads(first)) == ["id", "contents"]


def test_read_sparse_table(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines({"id": "1", "contents": "Running the cats"}))
    (tmp_path / "b.jsonl").write_text(lines({"id": "2", "contents": "b\x00c"}))
    (tmp_path / "c.json").write_text(lines({"id": "9", "contents": "skipped"}))
    rows = {r.id: r.contents for r in corpus.read_table(spark, str(tmp_path), "sparse").collect()}
    assert rows == {"1": "run cat", "2": "b c"}
    rows = corpus.read_table(spark, str(tmp_path), "sparse", pretokenized=True)
    assert {r.id: r.contents for r in rows.collect()} == {"1": "Running the cats", "2": "b\x00c"}
    safe = corpus.load_sparse(rows, pretokenized=True, nul_safe=True)
    assert {r.contents for r in safe.collect()} == {"Running the cats", "b�c"}


def test_read_dense_table_from_both_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines({"id": "1", "vector": [1.0, 2.0]}))
    spark.createDataFrame([(2, [0.5, 0.25])], "docid long, vector array<float>").coalesce(1).write.parquet(
        str(tmp_path / "p.parquet")
    )
    table = corpus.read_table(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "p.parquet")], "dense", dim=2)
    assert sorted(table.collect()) == [("1", [1.0, 2.0]), ("2", [0.5, 0.25])]
    assert corpus.kind_of(table) == "dense"


def test_wrong_length_fails(spark):
    rows = spark.createDataFrame([("1", [1.0, 2.0, 3.0])], "id string, vector array<double>")
    with pytest.raises(Exception, match="embedding length"):
        corpus.load_dense(rows, 2).collect()


def test_eight_decimals(spark):
    rows = spark.createDataFrame([("1", [0.123456789123])], "id string, vector array<double>")
    assert corpus.load_dense(rows, 1, eight_decimals=True).first().embedding == [0.12345679]


def test_errors(spark, tmp_path):
    spark.createDataFrame([("1", [1.0])], "id string, vector array<double>").write.parquet(str(tmp_path / "x.parquet"))
    with pytest.raises(ValueError, match="embeddings only"):
        corpus.read_table(spark, str(tmp_path / "x.parquet"), "sparse")
    with pytest.raises(ValueError, match="unknown kind"):
        corpus.read_table(spark, str(tmp_path), "graph")
    with pytest.raises(ValueError, match="duplicate id"):
        corpus.require_unique(spark.createDataFrame([("1",), ("1",)], "id string"))
    with pytest.raises(ValueError, match="column"):
        corpus.kind_of(spark.createDataFrame([("1",)], "id string"))
    assert corpus.table_name("my-table") == "my_table"


def test_write_table_replaces_and_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("1", "a")], "id string, contents string")
    corpus.write_table(one, path)
    corpus.write_table(one.withColumn("id", F.lit("2")), path, append=True)
    assert corpus.num_rows(corpus.open_table(spark, path)).first().num_rows == 2
    corpus.write_table(one, path)
    assert corpus.num_rows(corpus.open_table(spark, path)).first().num_rows == 1


def test_topics(spark, tmp_path):
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write(lines({"qid": 7, "vector": [1, 2]}, {"id": "q1", "qid": "x", "contents": "cat"}))
    rows = {r.qid: (r.contents, r.vector) for r in corpus.read_topics(spark, str(tmp_path / "t.jsonl.gz")).collect()}
    assert rows == {"7": (None, [1.0, 2.0]), "q1": ("cat", None)}
    (tmp_path / "t.tsv").write_text("q2\tone\tignored\n")
    assert corpus.read_topics(spark, str(tmp_path / "t.tsv")).first()[:2] == ("q2", "one")
    with pytest.raises(ValueError):
        corpus.read_topics(spark, "topics.csv")


def test_run_round_trip(spark, tmp_path):
    hits = spark.createDataFrame(
        [("q10", "a", 0.5, 1), ("q2", "b", 1.25, 1), ("q2", "a", 1.0, 2)], "qid string, id string, score double, rank int"
    )
    path = str(tmp_path / "run")
    trec.write_run(hits, path, trec.run_tag("sparse", "bm25"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "run").glob("part-*")))
    assert text.splitlines() == ["q2 Q0 b 1 1.25 sparse_bm25", "q2 Q0 a 2 1.0 sparse_bm25", "q10 Q0 a 1 0.5 sparse_bm25"]
    assert sorted(trec.read_run(spark, path).select("qid", "id", "score", "rank").collect()) == sorted(hits.collect())


def test_qrels(spark, tmp_path):
    (tmp_path / "qrels").write_text("q1 0 d1 2\nq1\t0\td2\t0\n")
    assert sorted(trec.read_qrels(spark, str(tmp_path / "qrels")).collect()) == [("q1", "d1", 2), ("q1", "d2", 0)]


def test_an_append_of_known_ids_is_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("1", "a")], "id string, contents string")
    corpus.write_table(one, path)
    with pytest.raises(ValueError, match="duplicate id"):
        corpus.write_table(one, path, append=True)
    assert corpus.open_table(spark, path).count() == 1


def test_a_replacement_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("1", "a")], "id string, contents string")
    corpus.write_table(one, path)
    opened = corpus.open_table(spark, path)
    fails = one.withColumn("contents", F.raise_error(F.lit("lost")).cast("string"))
    for append in (False, True):
        with pytest.raises(Exception, match="lost|duplicate"):
            corpus.write_table(fails, path, append)
    with monkeypatch.context() as patch:
        patch.setattr(corpus.manifest, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            corpus.write_table(one.withColumn("contents", F.lit("b")), path)
    assert corpus.open_table(spark, path).collect() == [("1", "a")]
    # Whoever opened the table before a replacement can go on with it; of two before nothing is left.
    corpus.write_table(one.withColumn("contents", F.lit("b")), path)
    assert opened.collect() == [("1", "a")] and corpus.open_table(spark, path).collect() == [("1", "b")]
    corpus.write_table(one.withColumn("contents", F.lit("c")), path)
    named = [p["name"] for p in corpus.manifest.newest(spark, path)["parts"]]
    assert len(named) == 1 and corpus.open_table(spark, path).collect() == [("1", "c")]
    with pytest.raises(ValueError, match="no table"):
        corpus.open_table(spark, str(tmp_path / "none"))


def test_a_batch_is_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i, "a")], "id string, contents string") for i in "12")
    for batch, rows in (("s/0", one), ("s/1", two), ("s/1", two), ("s/0", one)):
        corpus.write_table(rows, path, append=True, batch=batch)
    assert sorted(r.id for r in corpus.open_table(spark, path).collect()) == ["1", "2"]
