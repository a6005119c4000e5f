"""The pipeline against the same steps taken one document at a time."""

import pytest
from test_dart_minhash import by_hand as near_by_hand
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from trawl.llm.crf import LEAST_SCORE, languages
from trawl.llm.queries import PACKING_TOKENIZER


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]


def test_run_equals_the_steps_by_hand(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clear = {r.doc_id for r in languages(docs).collect() if r.lang_pred != "und" and r.score >= LEAST_SCORE}
    last = {}
    for doc_id in sorted(clear):
        last[texts[doc_id]] = doc_id
    distinct = sorted((i, t) for t, i in last.items())
    kept = {c for _, c, _ in near_by_hand(distinct)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == kept
    tokenizer = Tokenizer.from_file(PACKING_TOKENIZER)
    check(rows, lambda i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1])


def test_sequences_follow_the_target_shares(spark, tmp_path):
    """The source with the large share has 30 % of the rows; it must fill 24 of 28 blocks as long as it lasts."""
    rows = [(i, f"{i} " + "word of some text " * (5 + i % 4), "src0" if i % 10 < 3 else "src5") for i in range(20_000)]
    source = {i: s for i, _, s in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    packed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert sorted(r.doc_id for r in packed) == sorted(source) and max(r.offset + r.length for r in packed) <= 2048
    buckets = sorted({r.sequence_id >> 32 for r in packed})
    assert len(buckets) == 5

    def share(last):
        until = [r for r in packed if r.sequence_id >> 32 <= last]
        return sum(r.length for r in until if source[r.doc_id] == "src0") / sum(r.length for r in until)

    assert abs(share(buckets[0]) - 24 / 28) < 0.04
    assert abs(share(buckets[-1]) - 0.3) < 0.02
    order = {r.doc_id: n for n, r in enumerate(corpus_pipeline.mix(spark, docs, "").collect())}
    assert all(order[r.doc_id] // 4000 == r.sequence_id >> 32 for r in packed)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, number):
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (odd_docs, no_docs):
        found = stage(spark, docs, "")
        rows = found.collect()
        if name != "pack":
            assert found.columns == docs.columns
        assert bool(rows) == (docs is odd_docs)
