import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from trawl.functions.stem import porter
from trawl.functions.text import ANALYZERS, clean_query, natural_key, replace_nul, tokenize

STEMS = dict(pair.split("/") for pair in (
    "actually/actual nuggets/nugget ponies/poni ties/ti relational/relat conditional/condit hopping/hop "
    "falling/fall sized/size possibly/possibl archaeology/archaeolog vietnamization/vietnam happy/happi "
    "sky/sky is/is feed/feed agreed/agre controlling/control rolling/roll probate/probat cease/ceas rate/rate"
).split())


def sqlite_tokens(texts, tokenizer):
    """Token lists that FTS5 makes of the texts, read back from its vocabulary table."""
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize = '{tokenizer}')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts))
    tokens = [[] for _ in texts]
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        tokens[doc].append(term)
    return tokens


def analysed(spark, texts, analyzer):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    rows = df.select("n", ANALYZERS[analyzer](F.col("t")).alias("tokens")).collect()
    return [r.tokens for r in sorted(rows)]


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("word,stem", sorted(STEMS.items()))
def test_porter_examples(word, stem):
    assert porter(word) == stem


def test_bare_suffix_differs_by_flavour():
    assert (porter("ies"), porter("ies", bare=False)) == ("i", "ie")


def test_porter_equals_fts5_on_the_whole_vocabulary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).distinct()
    words = sorted(r[0] for r in words.collect())
    words += ["ies", "sses"]
    suffixes = ["ing", "ed", "ational", "iveness", "ly", "ies", "eed", "ement", "ion", "ization", "ously", "e", "y", "ll"]
    words += [w[:6] + s for w in words[::3] for s in suffixes]
    words = [w for w in words if len(w) <= 60]
    assert len(words) > 5000
    expected = [t[0] for t in sqlite_tokens(words, "porter")]
    assert [porter(w, bare=False) for w in words] == expected


def test_folded_and_porter_equal_fts5(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows] + ["Ünit u.s MARKET", "Ấn Ďáblice ŻÓŁĆ", "x_y z-9 áb", "", "!?"]
    assert analysed(spark, texts, "folded") == sqlite_tokens(texts, "unicode61")
    assert analysed(spark, texts, "porter") == sqlite_tokens(texts, "porter")


def test_english_analysis(spark):
    golden = {
        "What actual chicken nuggets": "what actual chicken nugget",
        "The cat's not in the hat": "cat hat",
        "isn't it 3.14, 1,000.5 and foo_bar __": "isn't 3.14 1,000.5 foo_bar",
        "John’s e-mail: a.b.c": "john e mail a.b.c",
        "日本 カタカナ naïve": "日 本 カタカナ naïv",
        "": "",
    }
    for text, expected in golden.items():
        assert value(spark, text, lambda t: tokenize(t, "english")) == expected


def test_null_text_has_no_tokens(spark):
    for analyzer in ANALYZERS:
        assert analysed(spark, [None, "x"], analyzer)[0] == []


def test_whitespace_analysis_changes_nothing(spark):
    assert analysed(spark, ["Ab  c.d\tÉ "], "whitespace") == [["Ab", "c.d", "É"]]


def test_simple_analysis_keeps_underscore(spark):
    assert analysed(spark, ["Ab_c d-e"], "simple") == [["ab_c", "d", "e"]]


@pytest.mark.parametrize("text", ["a & b | !c:*", "  café's  x_1 ", "½ Ⅷ 日本, ok", "", "...", "é b"])
def test_clean_query(spark, text):
    words = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text)).strip().split()
    assert value(spark, text, clean_query) == " | ".join(words)


def test_natural_order(spark):
    ids = ["q10", "q2", "PLAIN-68", "7", "-3", "007", "q2b10", "q2b9", "10", "9" * 30, "q", "1" + "0" * 25]

    def key(text):
        return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", text)]

    df = spark.createDataFrame([(i,) for i in ids], "id string")
    ours = [r.id for r in df.orderBy(natural_key(F.col("id")), "id").collect()]
    assert ours == sorted(sorted(ids), key=key)


def test_replace_nul(spark):
    assert value(spark, "a\x00b", replace_nul) == "a�b"
