import hashlib
from collections import defaultdict

from trawl.llm import exact_dedup
from trawl.llm.exact_dedup import drop_copies, exact_classes


def by_hand(rows):
    """Sorted (doc_id, keep_id, size, kept, digest) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named, default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = [i == keep for i in ids]
        for i, doc_id in enumerate(ids):
            found.append((doc_id, keep, len(ids), kept[i] and i == kept.index(True), digest))
    return sorted(found, key=repr)


def result(df):
    return sorted(map(tuple, exact_classes(df).collect()), key=repr)


def test_odd_rows(odd_docs):
    assert result(odd_docs) == by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_no_rows(no_docs):
    assert exact_classes(no_docs).collect() == []
    assert drop_copies(no_docs).columns == no_docs.columns and drop_copies(no_docs).count() == 0


def test_given_table(documents, texts):
    assert result(documents) == by_hand(texts.items())


def test_a_group_with_a_third_of_all_rows_and_many_middling_ones(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COUNTERS", 16)
    monkeypatch.setattr(exact_dedup, "HEAVY", 4)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 90}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert result(df) == by_hand(rows)


def test_heavy_rows_are_not_shuffled(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = exact_dedup.keyed_texts(df)
    heavy = [r.item for r in exact_dedup.heavy_digests(keyed).collect()]
    assert len(heavy) == 1
    plan = exact_dedup.resolve(keyed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Window" in plan
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_dropping_keeps_every_column(odd_docs):
    kept = drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted({r.text or "" for r in odd_docs.collect()})
    assert sorted(r.text or "" for r in kept.collect()) == want
