"""

``documents`` is the corpus, ``benchmark`` the topics, ``embeddings`` the dense table; the vectors
of the topics are the embeddings with their ids. Every query reads its whole tables.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracles import ORACLES
from trawl.functions.stem import stem_tokens
from trawl.functions.text import clean_query, drop_stop_words, natural_key, plain_tokens, tokenize
from trawl.functions.vectors import norm
from trawl.operators.dense import cosine_top_k
from trawl.operators.evaluate import combine_topics, judge_by_runs, mean_ndcg, ndcg
from trawl.operators.fusion import rrf
from trawl.operators.grouped import group_table, grouped_top_k
from trawl.operators.index import (
    Index, build_index, corpus_stats, doc_freq, doc_lengths, extend_index, open_index, postings_of,
)
from trawl.operators.lexical import bm25, bm25_terms, match_any, match_phrases, pad, ts_rank_terms
from trawl.operators.pruned import best
from trawl.operators.topk import drop_self, top_k
from trawl.plans.search import index_contents, search, sparse_hits
from trawl.session import checkpoint, scratch_dir, stored
from trawl.sources.corpus import (
    load_dense, load_sparse, num_rows, open_table, parse_json_lines, parse_tsv_lines, read_parquet_rows, read_raw, read_table,
    read_topics, write_parsed, write_table,
)
from trawl.sources.trec import read_qrels, read_run, run_lines, run_tag, write_run
from trawl.streaming.follow import follow_index, follow_table

SMALL = "/root/testdata/sf0.001"
DIMENSION = 64
HITS = 10
DEEP_HITS = 1000
DEEPER_HITS = 1500
# Length of the word runs by which documents are judged relevant.
RUN_WORDS = 8


def _docs(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    rows = read_parquet_rows(spark, f"{sf}/documents.parquet")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents"), *extra)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_parquet_rows(spark, f"{sf}/conversations.parquet")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("contents"))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    return rows.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("contents"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_parquet_rows(spark, f"{sf}/embeddings.parquet")
    return load_dense(rows.select("vec_id", "embedding"), DIMENSION)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("string").alias("id"), "label")


def _full_topics(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    return combine_topics(_topics(spark, sf), vectors)


def _index(spark: SparkSession, sf: str, **options) -> Index:
    return build_index(_docs(spark, sf), **options)


def _group_index(spark: SparkSession, sf: str, **options) -> Index:
    return build_index(_docs(spark, sf, "lang"), by=("lang",), **options)


def _group_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the documents, with the language of the document of the same id."""
    return _vectors(spark, sf).join(_docs(spark, sf, "lang").select("id", "lang"), "id")


def _shown(hits: DataFrame) -> DataFrame:
    """Scores as they are printed; ranks come from more digits."""
    return hits.withColumn("score", F.round("score", 6))


def _files(df: DataFrame, path: str, ending: str, write) -> str:
    """Write ``df`` by ``write(df, folder)`` and give its files the ending that the readers look for."""
    write(df, path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "part-*")):
        old = file.getPath()
        system.rename(old, spark._jvm.org.apache.hadoop.fs.Path(folder, old.getName().split(".")[0] + ending))
    return path


# Sources


def q_load_sparse(spark, sf):
    return load_sparse(_docs(spark, sf), analyzer="plain")


def q_load_dense(spark, sf):
    return _vectors(spark, sf).select(
        "id",
        F.size("embedding").alias("dim"),
        F.round(norm(F.col("embedding")), 6).alias("norm"),
        F.round(F.element_at("embedding", 1), 6).alias("first"),
        F.round(F.element_at("embedding", -1), 6).alias("last"),
    )


def q_num_rows(spark, sf):
    return num_rows(_docs(spark, sf).unionByName(_turns(spark, sf)))


def q_choose_text(spark, sf):
    rows = read_parquet_rows(spark, f"{sf}/documents.parquet")
    title = F.struct(F.col("doc_id").alias("_id"), F.col("source").alias("title"), "text", "lang")
    contents = F.struct(F.col("doc_id").alias("id"), "source", F.col("text").alias("contents"))
    neither = F.struct("doc_id", "lang", F.col("text").alias("body"), "n_chars")
    line = (
        F.when(F.col("lang") == "en", F.to_json(title))
        .when(F.col("lang") == "fr", F.to_json(contents))
        .otherwise(F.to_json(neither))
    )
    return parse_json_lines(rows.select(line.alias("line")))


def q_parse_tsv(spark, sf):
    rows = read_parquet_rows(spark, f"{sf}/conversations.parquet")
    line = F.concat_ws("\t", F.concat_ws("-", "conv_id", "turn"), "role", F.regexp_replace("text", r"\s+", " "))
    return parse_tsv_lines(rows.select(line.alias("line")))


def q_read_folder(spark, sf):
    """JSON lines, packed, and tab-separated lines written to one folder and read by their names."""
    docs = read_parquet_rows(spark, f"{sf}/documents.parquet")
    fields = F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text", "lang")
    turns = read_parquet_rows(spark, f"{sf}/conversations.parquet")
    line = F.concat_ws("\t", F.concat_ws("-", "conv_id", "turn"), "role", F.regexp_replace("text", r"\s+", " "))
    folder = scratch_dir(spark)
    packed = lambda df, path: df.write.option("compression", "gzip").text(path)
    _files(docs.select(F.to_json(fields).alias("value")), f"{folder}/a", ".jsonl.gz", packed)
    _files(turns.select(line.alias("value")), f"{folder}/b", ".tsv", lambda df, path: df.write.text(path))
    return read_raw(spark, f"{folder}/*")


def q_read_parsed(spark, sf):
    """A parsed corpus written as JSON lines and loaded for indexing."""
    parsed = _docs(spark, sf).select("id", tokenize(F.col("contents"), "plain").alias("contents"))
    folder = _files(parsed, scratch_dir(spark), ".jsonl", write_parsed)
    return read_table(spark, folder, "sparse", pretokenized=True)


def q_read_dense_jsonl(spark, sf):
    vectors = _vectors(spark, sf).select("id", F.col("embedding").alias("vector"))
    folder = _files(vectors, scratch_dir(spark), ".jsonl", lambda df, path: df.write.json(path))
    read = read_table(spark, folder, "dense", dim=DIMENSION)
    return read.select("id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("norm"))


def q_eight_decimals(spark, sf):
    rows = read_parquet_rows(spark, f"{sf}/embeddings.parquet")
    short = load_dense(rows.select("vec_id", "embedding"), DIMENSION, eight_decimals=True)
    first = F.format_string("%.8f", F.element_at("embedding", 1))
    return short.select("id", first.alias("first"), F.format_string("%.8f", F.element_at("embedding", -1)).alias("last"))


def q_table_appended(spark, sf):
    """A stored table that is replaced and then extended, read back."""
    path = scratch_dir(spark)
    write_table(_turns(spark, sf), path)
    write_table(_docs(spark, sf), path)
    write_table(_turns(spark, sf), path, append=True)
    return open_table(spark, path).select("id", F.length("contents").alias("chars"))


def _growing(spark: SparkSession, sf: str, follow: Callable[[str], None]) -> None:
    """A folder that holds the documents at first, the turns of the conversations as well later on."""
    folder = scratch_dir(spark)
    for name, rows in (("a", _docs(spark, sf)), ("b", _turns(spark, sf))):
        _files(rows, f"{folder}/{name}", ".jsonl", write_parsed)
        follow(f"{folder}/*")


def q_table_followed(spark, sf):
    """A stored table to which only the new files of a folder are added."""
    path, checkpoint_dir = scratch_dir(spark), scratch_dir(spark)
    _growing(spark, sf, lambda folder: follow_table(spark, folder, path, "sparse", checkpoint_dir, pretokenized=True))
    return open_table(spark, path).select("id", F.length("contents").alias("chars"))


def q_nul_replaced(spark, sf):
    rows = _docs(spark, sf, "lang")
    rows = rows.select("id", F.concat("lang", F.lit("\x00"), "contents").alias("contents"))
    return load_sparse(rows, pretokenized=True, nul_safe=True)


def q_read_topics(spark, sf):
    topics = _full_topics(spark, sf)
    packed = lambda df, path: df.write.option("compression", "gzip").json(path)
    folder = _files(topics, scratch_dir(spark), ".jsonl.gz", packed)
    read = read_topics(spark, f"{folder}/part-*.jsonl.gz")
    return read.select("qid", "contents", F.size("vector").alias("dim"), F.round(norm(F.col("vector")), 6).alias("norm"))


# Text analysis


def q_tokenize(spark, sf):
    return _turns(spark, sf).select("id", tokenize(F.col("contents"), "plain").alias("contents"))


def q_stopwords(spark, sf):
    kept = drop_stop_words(plain_tokens(F.col("contents")))
    return _docs(spark, sf).select("id", F.size(kept).alias("kept"), F.array_join(kept, " ").alias("contents"))


def q_porter_stem(spark, sf):
    words = _docs(spark, sf).select(F.array_distinct(plain_tokens(F.col("contents"))).alias("word"))
    pairs = words.select("word", stem_tokens(F.col("word")).alias("stem"))
    return pairs.select(F.inline_outer(F.arrays_zip("word", "stem"))).filter("word IS NOT NULL").distinct()


def q_tokenize_english(spark, sf):
    return _docs(spark, sf).select("id", tokenize(F.col("contents"), "english").alias("contents"))


def q_clean_query(spark, sf):
    return _turns(spark, sf).select("id", clean_query(F.col("contents")).alias("cleaned"))


def q_natural_order(spark, sf):
    rows = read_parquet_rows(spark, f"{sf}/documents.parquet")
    ids = rows.select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("qid"))
    return ids.select("qid", F.array_join(natural_key(F.col("qid")), " ").alias("key")).orderBy(natural_key(F.col("qid")))


# Index


def q_postings(spark, sf):
    return postings_of(_docs(spark, sf))


def q_doc_lengths(spark, sf):
    return doc_lengths(_docs(spark, sf))


def q_doc_freq(spark, sf):
    return doc_freq(_docs(spark, sf))


def q_corpus_stats(spark, sf):
    return corpus_stats(_docs(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


# Lexical retrieval


def q_match_any(spark, sf):
    matches = match_any(_index(spark, sf), _topics(spark, sf))
    return matches.groupBy("qid").agg(F.count("*").alias("matches"))


def q_bm25_topk(spark, sf):
    return _shown(sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", HITS))


def q_bm25_deep(spark, sf):
    return _shown(sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", DEEPER_HITS))


def q_bm25_pruned(spark, sf):
    """By score bounds, which a corpus of this size would not need."""
    return _shown(sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", HITS, prune=True))


def q_bm25_padded(spark, sf):
    return _shown(sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", DEEP_HITS, padded=True))


def q_bm25_padded_classic(spark, sf):
    """Frequent words weigh less than nothing here, so hits give way to documents scored 0."""
    index, topics = _index(spark, sf), _topics(spark, sf)
    every, _ = stored(bm25(index, topics, idf="classic"))
    return _shown(pad(top_k(every, DEEP_HITS), index, topics, DEEP_HITS, every))


def q_bm25_by_group(spark, sf):
    index = _group_index(spark, sf)
    return _shown(best(index, bm25_terms(index, _topics(spark, sf)), HITS))


def q_bm25_padded_by_group(spark, sf):
    return _shown(sparse_hits(_group_index(spark, sf), _topics(spark, sf), "bm25", DEEPER_HITS, padded=True))


def q_index_reopened(spark, sf):
    path = scratch_dir(spark)
    build_index(_docs(spark, sf), path=path)
    return _shown(sparse_hits(open_index(spark, path), _topics(spark, sf), "bm25", HITS))


def q_index_extended(spark, sf):
    """The documents indexed first, the turns of the conversations added afterwards."""
    path = scratch_dir(spark)
    build_index(_docs(spark, sf), path=path)
    extend_index(_turns(spark, sf), path)
    return _shown(sparse_hits(open_index(spark, path), _topics(spark, sf), "bm25", HITS))


def q_index_followed(spark, sf):
    """An index to which only the new files of a folder are added."""
    path, checkpoint_dir = scratch_dir(spark), scratch_dir(spark)
    _growing(spark, sf, lambda folder: follow_index(spark, folder, path, checkpoint_dir, analyzer="plain"))
    return _shown(search(_topics(spark, sf), [open_index(spark, path)], n=HITS, analyzer="plain"))


def q_index_whitespace(spark, sf):
    """Contents analysed before they were stored, and read again by blanks alone."""
    index = index_contents(load_sparse(_docs(spark, sf), "plain"), "bm25")
    return _shown(search(_topics(spark, sf), [index], n=HITS, analyzer="plain"))


def q_index_fts5(spark, sf):
    """Contents stored as stems, which the index folds and stems once more, ids with them."""
    index = index_contents(load_sparse(_docs(spark, sf), "english"), "fts5")
    return _shown(search(_topics(spark, sf), [index], flavour="fts5", n=HITS))


def q_phrase_match(spark, sf):
    clauses = _topics(spark, sf).select(F.explode_outer(F.split("contents", r"[.,\n]+")).alias("clause"))
    phrases = clauses.select(plain_tokens(F.col("clause")).alias("phrase")).filter(F.size("phrase") > 1)
    found = match_phrases(_index(spark, sf, positional=True), phrases)
    return found.select(F.array_join("phrase", " ").alias("phrase"), "id", "tf", "len")


def q_bm25_fts5(spark, sf):
    index = _index(spark, sf, analyzer="folded", with_id=True, positional=True)
    return _shown(sparse_hits(index, _topics(spark, sf), "fts5", HITS))


def _dotted_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics whose first two words are one word with inner punctuation, a phrase."""
    dotted = F.regexp_replace("contents", r"^(\S+) (\S+)", "$1.$2")
    return _topics(spark, sf).withColumn("contents", dotted)


def q_fts5_phrases(spark, sf):
    index = _index(spark, sf, analyzer="folded", with_id=True, positional=True)
    return _shown(sparse_hits(index, _dotted_topics(spark, sf), "fts5", HITS))


def q_fts5_by_group(spark, sf):
    index = _group_index(spark, sf, analyzer="folded", with_id=True, positional=True)
    return _shown(sparse_hits(index, _dotted_topics(spark, sf), "fts5", HITS))


def q_ts_rank_topk(spark, sf):
    return _shown(sparse_hits(_index(spark, sf, analyzer="simple"), _topics(spark, sf), "ts_rank", HITS))


def q_ts_rank_norm(spark, sf):
    index = _index(spark, sf, analyzer="simple")
    return _shown(best(index, ts_rank_terms(index, _topics(spark, sf), norm=1), HITS))


def q_ts_rank_english(spark, sf):
    """English analysis and scores divided by the logarithm of the length."""
    index = _index(spark, sf, analyzer="english")
    return _shown(best(index, ts_rank_terms(index, _topics(spark, sf), norm=1), HITS))


def q_ts_rank_by_group(spark, sf):
    return _shown(sparse_hits(_group_index(spark, sf, analyzer="simple"), _topics(spark, sf), "ts_rank", HITS))


def q_search_sparse(spark, sf):
    return _shown(search(_topics(spark, sf), [_index(spark, sf)], n=HITS, analyzer="plain"))


def q_search_by_group(spark, sf):
    return _shown(search(_topics(spark, sf), [_group_index(spark, sf)], n=HITS, analyzer="plain"))


# Dense and hybrid retrieval


def q_dense_topk(spark, sf):
    return _shown(cosine_top_k(_vectors(spark, sf), _full_topics(spark, sf), HITS))


def q_dense_grouped(spark, sf):
    """The same from a table in groups around pivots, whose bounds tell what need not be read."""
    return _shown(grouped_top_k(group_table(_vectors(spark, sf)), _full_topics(spark, sf), HITS))


def q_dense_by_group(spark, sf):
    return _shown(search(_full_topics(spark, sf), [_group_vectors(spark, sf)], n=HITS, by=("lang",)))


def q_self_filter(spark, sf):
    return _shown(drop_self(cosine_top_k(_vectors(spark, sf), _full_topics(spark, sf), HITS)))


def q_rrf_row_number(spark, sf):
    index, topics = _index(spark, sf), _full_topics(spark, sf)
    sparse = sparse_hits(index, topics, "bm25", DEEP_HITS, padded=True)
    return rrf(sparse, cosine_top_k(_vectors(spark, sf), topics, DEEP_HITS), DEEP_HITS)


def q_rrf_rank(spark, sf):
    topics = _full_topics(spark, sf)
    sparse = sparse_hits(_index(spark, sf, analyzer="simple"), topics, "ts_rank", DEEP_HITS)
    return rrf(sparse, cosine_top_k(_vectors(spark, sf), topics, DEEP_HITS), DEEP_HITS, ties="rank")


def q_search_hybrid(spark, sf):
    return search(
        _full_topics(spark, sf), [_vectors(spark, sf), _index(spark, sf)], n=HITS, analyzer="plain"
    )


def q_hybrid_by_group(spark, sf):
    tables = [_group_index(spark, sf), _group_vectors(spark, sf)]
    return search(_full_topics(spark, sf), tables, n=HITS, analyzer="plain")


# Topics, runs, evaluation


def q_combine_topics(spark, sf):
    topics = _full_topics(spark, sf)
    return topics.select("qid", "contents", F.size("vector").alias("dim"), F.round(norm(F.col("vector")), 6).alias("norm"))


def q_trec_run(spark, sf):
    hits = sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", HITS)
    lines = run_lines(hits, run_tag("sparse", "bm25"))
    return lines.orderBy(natural_key(F.col("qid")), "rank").select("line")


def q_run_roundtrip(spark, sf):
    """A run file and judgements written, read again and evaluated."""
    folder = scratch_dir(spark)
    hits = sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", HITS)
    write_run(hits, f"{folder}/run", run_tag("sparse", "bm25"), digits=10)
    lines = _judgements(spark, sf).select(F.concat_ws(" ", "qid", F.lit("0"), "id", F.col("rel").cast("string")).alias("value"))
    lines.write.text(f"{folder}/qrels")
    run = read_run(spark, f"{folder}/run")
    return ndcg(run, read_qrels(spark, f"{folder}/qrels")).select("qid", F.round("ndcg", 6).alias("ndcg"))


def _judgements(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Every document that shares a run of words with a topic, found or not."""
    return judge_by_runs(_docs(spark, sf, *by), _topics(spark, sf), RUN_WORDS, by)


def _sparse_run(spark: SparkSession, sf: str) -> DataFrame:
    return drop_self(sparse_hits(_index(spark, sf), _topics(spark, sf), "bm25", HITS))


def q_judgements(spark, sf):
    return _judgements(spark, sf)


def q_ndcg_at_10(spark, sf):
    return ndcg(_sparse_run(spark, sf), checkpoint(_judgements(spark, sf))).select("qid", F.round("ndcg", 6).alias("ndcg"))


def q_ndcg_mean(spark, sf):
    means = mean_ndcg(_sparse_run(spark, sf), checkpoint(_judgements(spark, sf)))
    return means.select("queries", F.round("ndcg", 6).alias("ndcg"))


def q_ndcg_by_group(spark, sf):
    """Mean nDCG of the lexical run in each language; documents labelled good are worth twice as much."""
    index = _group_index(spark, sf)
    run = best(index, bm25_terms(index, _topics(spark, sf)), HITS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.select(F.col("doc_id").cast("string").alias("id"), "quality")
    judged = _judgements(spark, sf, "lang").join(good, "id", "left")
    qrels = judged.select("lang", "qid", "id", (F.col("rel") + F.coalesce("quality", F.lit(0))).alias("rel"))
    means = mean_ndcg(run, checkpoint(qrels), by=("lang",))
    return means.select("lang", "queries", F.round("ndcg", 6).alias("ndcg"))


def _present(name: str) -> bool:
    """Whether a module or package with code of its own is there; one that is there but broken is an error."""
    spec = importlib.util.find_spec(name)
    return spec is not None and spec.origin is not None


LLM_QUERIES: dict = {}
LLM_ORACLES: dict = {}
if _present("trawl.llm") and _present("corpus_pipeline"):  # optional: both may be absent
    import corpus_pipeline
    from trawl.llm import queries as llm

    LLM_QUERIES = llm.QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_ORACLES = llm.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: BM25 top 10 of every topic."""
    return q_bm25_topk(spark, SMALL)


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: query for name, query in globals().items() if name.startswith("q_")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | LLM_ORACLES
