import random
from itertools import combinations

import numpy as np
import pytest
from trawl.llm import dart_minhash
from trawl.llm.dart_minhash import drop_near_copies, near_classes, shingles, signatures


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    """Class of each row by comparing all pairs: (doc_id, smallest doc_id, size)."""
    sets, parent = [shingle_set(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) / len(a | b) >= 0.8):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    found = []
    for ids in groups.values():
        named = [i for i in ids if i is not None]
        found += [(i, min(named, default=None), len(ids)) for i in ids]
    return sorted(found, key=repr)


def result(df, unique=True):
    rows = near_classes(df).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.class_id, []).append(r.kept)
    if unique:  # else rows that share an id may head two classes
        assert all(sum(kept) == 1 for kept in classes.values())
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in rows), key=repr)


def near_copies(rng, count, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = []
    for _ in range(count):
        text = list(base)
        for _ in range(changes):
            text[rng.randrange(words)] = f"x{rng.randrange(100000)}"
        texts.append(" ".join(text))
    return texts


def test_shingles_of_short_and_long_texts():
    values, counts = shingles(["a b c d e f", "A b\nc  d e f", "a b", "", "a b c d e", "b a", " "])
    assert counts.tolist() == [2, 2, 1, 0, 1, 1, 0]
    assert values[0] == values[2] and values[1] == values[3] and values[0] == values[5]
    assert len(set(values.tolist())) == 4


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.9])
def test_agreement_estimates_the_similarity(similarity):
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        shared = round(400 * similarity)
        only = (400 - shared) // 2
        a, b = pool[:shared + only], np.concatenate([pool[:shared], pool[shared + only:]])
        s = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - similarity) < 0.03


def test_weights_count():
    rng = np.random.default_rng(2)
    agree, want = [], []
    for _ in range(40):
        ids = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
        s = signatures(np.concatenate([ids, ids]), np.array([60, 60]), np.concatenate([a, b]))
        agree.append((s[0] == s[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_throwing_further_changes_nothing_and_repeats_do_not_count():
    ids = np.arange(1, 40, dtype=np.uint64)
    few = signatures(ids, np.array([39]), darts=40)
    many = signatures(np.concatenate([ids, ids]), np.array([78]), darts=20_000)
    assert (few == many).all() and (few != 0).all()
    assert (signatures(ids[:1], np.array([1, 0]))[1] == 0).all()


def test_given_table(documents, texts):
    assert result(documents) == by_hand(sorted(texts.items()))


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(odd_docs, unique=False) == by_hand(rows)
    kept = drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = near_classes(odd_docs).collect()
    assert kept.count() == sum(r.kept for r in classes)


def test_no_rows(no_docs):
    assert near_classes(no_docs).collect() == [] and drop_near_copies(no_docs).collect() == []


def test_a_large_group_without_all_its_pairs(spark, monkeypatch):
    rng = random.Random(5)
    texts = near_copies(rng, 150, 200, 1) + near_copies(rng, 40, 120, 9) + [
        " ".join(f"z{rng.randrange(9000)}" for _ in range(90)) for _ in range(100)]
    texts += [texts[0]] * 60 + ["same short text"] * 30
    rows = list(enumerate(texts))
    seen = []
    compared = dart_minhash._compared
    monkeypatch.setattr(dart_minhash, "_compared", lambda p, s, x: (seen.append(p.count()), compared(p, s, x))[1])
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)
    assert sum(seen) < 3000  # 11,000 pairs within the large group alone


def test_chains_hold_together(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for step in range(40):
        words = [*words[4:], *(f"v{rng.randrange(5000)}" for _ in range(4))]
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_a_family_around_the_threshold_loses_no_link(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(170)]
    texts = []
    for _ in range(160):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(170)] = f"x{rng.randrange(400)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    seen = []
    compared = dart_minhash._compared
    monkeypatch.setattr(dart_minhash, "_compared", lambda p, s, x: (seen.append(p.count()), compared(p, s, x))[1])
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)
    assert sum(seen) < 160 * 159 / 2 / 3
