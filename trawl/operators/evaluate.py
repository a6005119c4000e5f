"""Topic preparation and nDCG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import plain_tokens
from trawl.session import BROADCAST_BYTES, measure


def combine_topics(topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(qid, contents, vector)``; a topic without a vector fails the job."""
    joined = topics.select("qid", "contents").join(vectors.select("qid", "vector"), "qid", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for topic "), F.col("qid")))
    return joined.select(
        "qid", "contents", F.when(F.col("vector").isNull(), missing).otherwise(F.col("vector")).alias("vector")
    )


def word_runs(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """``(keys, run)``: runs of ``length`` neighbouring ``words``, joined by blanks, one row for every place.

    Each word is a row while its run is put together, which Spark compiles; functions on arrays are
    interpreted word by word. The outer form keeps Catalyst from inferring a filter on the array, for
    which the words would be cut out a second time.
    """
    places = texts.select(*keys, "words", F.posexplode_outer("words").alias("place", "word"))
    whole = places.filter(F.col("place") <= F.size("words") - length)
    return whole.select(*keys, F.concat_ws(" ", *(F.get("words", F.col("place") + i) for i in range(length))).alias("run"))


def judge_by_runs(docs: DataFrame, topics: DataFrame, length: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, id, rel)``, rel being 1: documents that share a run of ``length`` words with a topic.

    ``docs`` are ``(by, id, contents)``, ``topics`` ``(qid, contents)``. The runs of the topics go to
    the documents if they were measured to fit a broadcast, so a run that many documents share
    gathers nowhere; else the runs of the documents are shuffled, and a run is no key of a group but
    of a join that Spark can split.
    """
    # The words are a column of their own: within the runs they would be cut out again for each.
    topics = topics.select("qid", plain_tokens(F.col("contents")).alias("words"))
    docs = docs.select(*by, "id", plain_tokens(F.col("contents")).alias("words"))
    wanted = word_runs(topics, ["qid"], length).distinct()
    _, size = measure(wanted)
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    held = word_runs(docs, [*by, "id"], length)
    return held.join(wanted, "run").select(*by, "qid", "id", F.lit(1).alias("rel")).distinct()


def _dcg(ranked: DataFrame, keys: list[str], name: str) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1.0)).alias(name))


def _first(df: DataFrame, cut: int, keys: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= cut)


def ndcg(run: DataFrame, qrels: DataFrame, cut: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, ndcg)`` of every judged query, 0 for one without hits; reads ``qrels`` three times.

    As trec_eval does, hits are put in order again by score at single precision, ties by document
    id descending as text; the ranks of the run are not used. Gain is the judgement, not below 0.
    """
    keys = [*by, "qid"]
    gain = F.greatest("rel", F.lit(0)).cast("double")
    judged = qrels.select(*keys, "id", gain.alias("gain"))
    score = F.col("score").cast("float")
    hits = _first(run.select(*keys, "id", "score"), cut, keys, score.desc(), F.desc("id"))
    # Only the first hits of each query meet the judgements.
    found = _dcg(hits.join(judged, [*keys, "id"]), keys, "dcg")
    ideal = _dcg(_first(judged.filter("gain > 0"), cut, keys, F.desc("gain")), keys, "ideal")
    scores = judged.select(*keys).distinct().join(ideal, keys, "left").join(found, keys, "left")
    return scores.select(*keys, F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def mean_ndcg(run: DataFrame, qrels: DataFrame, cut: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, queries, ndcg)``: the mean over all judged queries, per corpus if ``by`` tells them apart."""
    scores = ndcg(run, qrels, cut, by)
    return scores.groupBy(*by).agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"))
