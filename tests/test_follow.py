import json

import pytest
from helpers import as_dict, topics_of

from trawl.operators import index as index_module
from trawl.operators.index import build_index, open_index
from trawl.operators.lexical import bm25
from trawl.sources.corpus import open_table
from trawl.streaming import follow
from trawl.streaming.follow import follow_index, follow_table


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(row) + "\n" for row in rows))


def doc(key, text):
    return {"id": key, "contents": text}


@pytest.fixture
def places(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_only_new_files_are_read(spark, places, monkeypatch):
    folder, path, checkpoint = places
    read = []
    write = follow.write_table
    monkeypatch.setattr(follow, "write_table", lambda rows, *a, **k: (read.append(sorted(r.id for r in rows.collect())), write(rows, *a, **k)))
    run = lambda: follow_table(spark, str(folder), path, "sparse", checkpoint, analyzer="plain")
    put(folder, "a.jsonl", doc("1", "One, two"), doc("2", "three"))
    put(folder, "notes.txt", doc("9", "no"))
    run()
    run()
    put(folder, "b.jsonl", doc("3", "four"))
    run()
    assert read == [["1", "2"], ["3"]]
    assert {r.id: r.contents for r in open_table(spark, path).collect()} == {"1": "one two", "2": "three", "3": "four"}


def test_a_batch_that_was_added_but_not_noted(spark, places, monkeypatch):
    """The run breaks off after the rows were added; the next one gets the same batch again."""
    folder, path, checkpoint = places
    write = follow.write_table

    def breaks(*args, **kwargs):
        write(*args, **kwargs)
        raise RuntimeError("lost after the write")

    put(folder, "a.jsonl", doc("1", "one"))
    with monkeypatch.context() as patch:
        patch.setattr(follow, "write_table", breaks)
        with pytest.raises(Exception, match="lost after the write"):
            follow_table(spark, str(folder), path, "sparse", checkpoint, pretokenized=True)
    put(folder, "b.jsonl", doc("2", "two"))
    follow_table(spark, str(folder), path, "sparse", checkpoint, pretokenized=True)
    assert sorted(r.id for r in open_table(spark, path).collect()) == ["1", "2"]


def test_dense_rows_and_small_batches(spark, places):
    folder, path, checkpoint = places
    for i in range(4):
        put(folder, f"{i}.jsonl", {"id": str(i), "vector": [3.0, 4.0 * i]})
    follow_table(spark, str(folder), path, "dense", checkpoint, dim=2, files_per_batch=1)
    rows = open_table(spark, path).collect()
    assert {r.id for r in rows} == set("0123") and {r.norm for r in rows} >= {3.0, 5.0}
    put(folder, "wrong.jsonl", {"id": "9", "vector": [1.0]})
    with pytest.raises(Exception, match="length|dimension|expected"):
        follow_table(spark, str(folder), path, "dense", checkpoint, dim=2)
    assert open_table(spark, path).count() == 4
    with pytest.raises(ValueError):
        follow_table(spark, str(folder), path, "graph", checkpoint)


def test_an_index_that_follows_equals_one_built_at_once(spark, places, monkeypatch):
    folder, path, checkpoint = places
    waves = [[("1", "cat dog"), ("2", "cat")], [("3", "dog dog fish")], [("4", "fish")]]
    analysed = []
    counts_of = index_module._counts_of
    monkeypatch.setattr(index_module, "_counts_of", lambda docs, facts: (analysed.append(docs.count()), counts_of(docs, facts))[1])
    for i, wave in enumerate(waves):
        put(folder, f"{i}.jsonl", *(doc(*row) for row in wave))
        follow_index(spark, str(folder), path, checkpoint, pretokenized=True)
        follow_index(spark, str(folder), path, checkpoint, pretokenized=True)
    assert analysed == [2, 1, 1]
    rows = spark.createDataFrame([row for wave in waves for row in wave], "id string, contents string")
    topics = topics_of(spark, "cat dog", "fish")
    found, want = (as_dict(bm25(index, topics), ("qid", "id"), "score") for index in (open_index(spark, path), build_index(rows, "whitespace")))
    assert found.keys() == want.keys() and all(abs(found[key] - want[key]) < 1e-12 for key in want)


def test_an_index_batch_that_comes_again(spark, places, monkeypatch):
    folder, path, checkpoint = places
    extend = follow.extend_index
    put(folder, "a.jsonl", doc("1", "cat"))
    follow_index(spark, str(folder), path, checkpoint, pretokenized=True)
    put(folder, "b.jsonl", doc("2", "dog"))

    def breaks(*args, **kwargs):
        extend(*args, **kwargs)
        raise RuntimeError("lost after the extension")

    with monkeypatch.context() as patch:
        patch.setattr(follow, "extend_index", breaks)
        with pytest.raises(Exception, match="lost after the extension"):
            follow_index(spark, str(folder), path, checkpoint, pretokenized=True)
    follow_index(spark, str(folder), path, checkpoint, pretokenized=True)
    assert sorted(r.id for r in open_index(spark, path).doclens.collect()) == ["1", "2"]
