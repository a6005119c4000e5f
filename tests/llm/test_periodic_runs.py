import random

import pytest
from pyspark.sql import functions as F
from trawl.llm.periodic_runs import WORDS_AT_ONCE, WaveletTree, _group, periodic_runs


def by_hand(words, exponent=4, least=6):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = q
        while i < len(words):
            begin = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            size = i - begin + q
            if i > begin and size >= max(least, exponent * q):
                found.setdefault((begin - q, size), q)
            i += i == begin
    return sorted(((start, size, q) for (start, size), q in found.items()), key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return b" ".join(word for i, word in enumerate(words) if i not in gone)


def random_words(rng):
    n, kinds = rng.choice([0, 1, 2, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 2, 3, 5, 30])
    words = []
    while len(words) < n:
        root = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
        words += (root * rng.randrange(1, 8))[:rng.randrange(1, 60)] if rng.random() < 0.6 else root[:1]
    return words[:n]


@pytest.mark.parametrize("exponent, least", [(4, 6), (4, 1), (5, 9), (7, 2)])
def test_runs_of_random_texts(exponent, least):
    rng = random.Random(exponent)
    texts = [random_words(rng) for _ in range(500)]
    runs, kept = _group(texts, exponent, least)
    assert runs == [by_hand(words, exponent, least) for words in texts] and sum(map(len, runs)) > 100
    assert kept == [collapsed(words, found) for words, found in zip(texts, runs)]


def test_words_of_neighbouring_documents_do_not_meet():
    texts = [[b"a"] * 5, [b"a"] * 5, [], [b"a", b"b"] * 3, [b"a", b"b"] * 3, [b"a"] * 6]
    assert _group(texts, 4, 6)[0] == [[], [], [], [], [], [(0, 6, 1)]]


@pytest.mark.parametrize("period", [1, 2, 31, 32, 33, 64, 65, 4999])
def test_long_periods(period):
    root = [b"%d" % i for i in range(period)]
    words = [b"x", b"y"] + (root * (20_000 // period + 1))[:20_000] + [b"z"]
    assert _group([words], 4, 6)[0] == [[(2, 20_000, period)]]


def test_wavelet_tree():
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.permutation(300)
    tree = WaveletTree(values)
    low = rng.integers(0, 300, 200)
    high = low + 1 + rng.integers(0, 300 - low)
    bound = rng.integers(0, 300, 200)
    nth = rng.integers(0, high - low)
    assert tree.smaller(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    assert tree.nth(low, high, nth).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, nth)]


def result(df):
    return sorted(((r.doc_id, r.words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()), key=repr)


def expected(rows):
    cut = [(i, (text or "").encode().split()) for i, text in rows]
    return sorted(((i, len(words), by_hand(words), collapsed(words, by_hand(words)).decode()) for i, words in cut), key=repr)


def test_odd_rows(odd_docs, no_docs):
    small = odd_docs.filter("length(coalesce(text, '')) < 1000")
    assert result(periodic_runs(small)) == expected([(r.doc_id, r.text) for r in small.collect()])
    assert periodic_runs(odd_docs).count() == odd_docs.count() and result(periodic_runs(no_docs)) == []


def test_white_space_and_other_separators(spark):
    # A no-break space and a line separator are parts of words.
    rows = [(1, "a\tb\x0ba\x0cb\ra b\na b"), (2, "a b " * 6), (3, "a  a " * 3), (4, "é É é É é É é É"), (5, "a\x00 " * 7)]
    df = spark.createDataFrame(rows, "name long, body string")
    assert result(periodic_runs(df, "name", "body")) == expected(rows)


def test_a_text_longer_than_what_is_worked_on_at_once(spark):
    text = " ".join(["x"] + ["a", "b", "c"] * WORDS_AT_ONCE)
    df = spark.createDataFrame([(1, text), (2, "one two")], "doc_id long, text string")
    rows = periodic_runs(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows[0].runs] == [(1, 3 * WORDS_AT_ONCE, 3)] and rows[0].collapsed == "x a b c"
    assert rows[1].runs == [] and rows[1].collapsed == "one two"


def test_short_exponents_are_refused(documents):
    with pytest.raises(ValueError):
        periodic_runs(documents, exponent=3)


def test_repeated_tails(spark, documents):
    """The tails the query puts in are the definition's."""
    import zlib

    from trawl.llm.queries import repeated_tails

    odd = spark.createDataFrame([(i, text) for i in range(60) for text in (None, "", " ", "one", "one two", "a b c d e f g h")],
                                "doc_id long, text string")
    for table in (odd, documents.select("doc_id", "text")):
        given = sorted(((r.doc_id, r.text) for r in table.collect()), key=repr)
        want = []
        for doc_id, text in given:
            words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
            g, n = h // 10, len(words)
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            want.append((doc_id, [word.decode() for word in words]))
        got = [(r.doc_id, [w.decode() for w in r.text.encode().split()]) for r in repeated_tails(table).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_null_ids_keep_their_text(spark):
    from trawl.llm.queries import repeated_tails

    df = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(r.text for r in repeated_tails(df).select(F.col("text")).collect()) == ["", "a b c d"]
