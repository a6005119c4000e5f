"""Top-k by score bounds: exact, without scoring every document that shares a word with a query.

The n-th best score within a sample of the documents cannot exceed the n-th best score of all: it
is a floor for each query. The sample is of bounded size, whatever the size of the index.

Two bounds meet the floor. A block of documents can give a query no more than the largest parts of
its words in that block together; blocks that stay below the floor are skipped, and where few blocks
are left the others are not read. Within the blocks left, a query's terms are sorted by the most they
can add to a score; as long as the weakest of them together stay below the floor, a document holding
none of the others cannot be a hit. So only the other, essential terms bring candidates; of those,
only documents that can still reach the floor get the weak terms added. Frequent words never turn
into one row per (query, document).

The weak terms are held below half the floor rather than just below it: that reads more postings
of middling terms, but a candidate then has to earn the other half from essential terms alone.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.index import Index
from trawl.operators.lexical import PART_COLUMNS, Weighted, join_postings, score_all
from trawl.operators.topk import DIGITS, top_k
from trawl.session import BROADCAST_BYTES, stored

# Below this number of matches a core, as the document frequencies tell, scoring all of them is quicker:
# the floors cost as much as scoring all of the sample.
PRUNE_FROM = 20_000_000
# Query terms searched together: their table and what is joined to it stay below the broadcast limit.
CHUNK_TERMS = 200_000
# Weak terms together stay below this share of the floor.
WEAK_SHARE = 0.5
# Up to this many blocks are pushed down to the Parquet pages of the postings.
FEW_BLOCKS = 5000


def _worth_it(index: Index, weighted: Weighted) -> bool:
    """Whether frequent words would make many rows."""
    if index.sample is None or not weighted.prunable:
        return False
    return weighted.matches >= weighted.even * PRUNE_FROM * index.postings.sparkSession.sparkContext.defaultParallelism


def wants_pruning(index: Index, weighted: Weighted, prune: bool | None) -> bool:
    """Whether to search by bounds, as asked for or as the matches suggest."""
    if not (weighted.prunable and index.sample is not None):
        return False
    return _worth_it(index, weighted) if prune is None else prune


def spread_sample(index: Index, weighted: Weighted) -> DataFrame:
    """The postings of the sample that hold query terms, by document on all cores.

    The sample lies in the few files of its buckets, a task each. The number of tasks shares no factor
    with that of the buckets, which come from the same hash: else their documents would meet again.
    """
    words = F.broadcast(weighted.terms.select(*index.by, "term").distinct())
    asked = index.sample.join(words, [*index.by, "term"], "left_semi")
    most = 3 * asked.sparkSession.sparkContext.defaultParallelism
    tasks = next(n for n in range(most, 0, -1) if math.gcd(n, index.buckets or 1) == 1)
    return asked.repartition(tasks, "id")


def split_terms(index: Index, weighted: Weighted, n: int, slack: float) -> DataFrame:
    """The weighted terms with ``floor``, ``essential`` and ``rest``.

    rest is the most a document can get from the terms of its query that are not essential.
    """
    keys = [*index.by, "qid"]
    weakest_first = Window.partitionBy(*keys).orderBy(F.asc("ceiling"), F.desc("df"), F.asc("term"))
    upto = F.sum("ceiling").over(weakest_first.rowsBetween(Window.unboundedPreceding, 0))
    weights = F.broadcast(weighted.terms.select(*keys, "term", *PART_COLUMNS))
    sampled = spread_sample(index, weighted).join(weights, [*index.by, "term"])
    best = top_k(sampled.groupBy(*keys, "id").agg(F.sum(weighted.part).alias("score")), n, index.by, digits=None)
    floors = best.groupBy(*keys).agg(F.min("score").alias("floor"), F.count("*").alias("held"))
    floors = floors.filter(F.col("held") == n).select(*keys, (F.col("floor") - slack).alias("floor"))
    terms = weighted.terms.withColumn("upto", upto).join(floors, keys, "left")
    essential = F.col("floor").isNull() | (F.col("upto") >= WEAK_SHARE * F.col("floor"))
    marked = terms.withColumn("essential", essential)
    rest = F.max(F.when(F.col("essential"), 0.0).otherwise(F.col("upto"))).over(Window.partitionBy(*keys))
    return marked.withColumn("rest", rest).select(
        *keys, "term", *PART_COLUMNS, "floor", "essential", "rest"
    )


def open_blocks(index: Index, weighted: Weighted, split: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``(by, qid, block)`` of the blocks that can hold a hit, and how many: their largest parts reach the floor.

    A part grows with the repetitions of a word and falls with the length of its document, so that
    of the largest repetition and the least length bounds all of a block.
    """
    keys = [*index.by, "qid"]
    weights = split.select(*keys, "term", *PART_COLUMNS, "floor")
    blocks = index.blocks if weighted.few is None else index.blocks.filter(F.col("term").isin(weighted.few))
    most = blocks.join(F.broadcast(weights), [*index.by, "term"]).groupBy(*keys, "block").agg(
        F.sum(weighted.part).alias("most"), F.max("floor").alias("floor"))
    reached = F.col("floor").isNull() | (F.col("most") >= F.col("floor"))
    return stored(most.filter(reached).select(*keys, "block"))


def _in_blocks(index: Index, blocks: DataFrame, counted: dict[str, int]) -> Index:
    """The index without the postings of blocks that are open for no query, if these are few enough to name."""
    if counted["rows"] > FEW_BLOCKS * 100:
        return index
    named = [row.block for row in blocks.select("block").distinct().limit(FEW_BLOCKS + 1).collect()]
    if len(named) > FEW_BLOCKS:
        return index
    return replace(index, postings=index.postings.filter(F.col("block").isin(sorted(named))))


def _candidates(index: Index, weighted: Weighted, split: DataFrame, blocks: DataFrame, counted: dict[str, int]) -> DataFrame:
    """``(by, qid, id, part, rest)`` of the documents that can reach the floor of their query."""
    keys = [*index.by, "qid"]
    essential = Weighted(split.filter("essential"), weighted.part, weighted.rows, True, weighted.few)
    matches = join_postings(index, essential, [*index.by, "term"], ["qid", "floor", "rest", *PART_COLUMNS])
    if counted["bytes"] <= BROADCAST_BYTES:
        # More blocks than that leave little to skip.
        matches = matches.join(F.broadcast(blocks), [*keys, "block"], "left_semi")
    parts = matches.groupBy(*keys, "id").agg(
        F.sum(weighted.part).alias("part"), F.max("floor").alias("floor"), F.max("rest").alias("rest")
    )
    reach = F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))
    return parts.filter(reach).select(*keys, "id", "part", "rest")


def pruned_scores(index: Index, weighted: Weighted, n: int, slack: float) -> DataFrame:
    """``(by, qid, id, score)`` of every document that can be among the n best of its query.

    The small steps between the passes over the postings are written, so that none is computed again.
    """
    keys = [*index.by, "qid"]
    split, _ = stored(split_terms(index, weighted, n, slack))
    blocks, counted = open_blocks(index, weighted, split)
    index = _in_blocks(index, blocks, counted)
    found, _ = stored(_candidates(index, weighted, split, blocks, counted))
    open_ones, counted = stored(found.filter("rest > 0").select(*keys, "id"))
    if counted["bytes"] <= BROADCAST_BYTES:
        open_ones = F.broadcast(open_ones)
    weak = split.filter("NOT essential").select(*keys, "term", *PART_COLUMNS)
    weak_words = weak.select(*index.by, "term").distinct()
    postings = index.postings.join(F.broadcast(weak_words), [*index.by, "term"], "left_semi")
    completed = postings.join(open_ones, [*index.by, "id"]).join(F.broadcast(weak), [*keys, "term"])
    added = completed.select(*keys, "id", weighted.part.alias("part"))
    both = found.select(*keys, "id", "part").unionByName(added)
    return both.groupBy(*keys, "id").agg(F.sum("part").alias("score"))


def best(
    index: Index, weighted: Weighted, n: int, digits: int | None = DIGITS, prune: bool | None = None
) -> DataFrame:
    """``(by, qid, id, score, rank)``: the n best documents of each query.

    ``prune`` defaults to what the document frequencies of the query terms suggest; the hits are the
    same. A large table of topics is pruned in chunks, each small enough for a broadcast.
    """
    if not wants_pruning(index, weighted, prune):
        return top_k(score_all(index, weighted), n, index.by, digits, index.buckets)
    chunks = max(1, -(-weighted.rows // CHUNK_TERMS))
    if chunks > 1:
        # One query cannot be divided; where it is longer than a chunk, all matches are scored.
        longest = weighted.terms.groupBy(*index.by, "qid").count().agg(F.max("count")).first()[0]
        if (longest or 0) > CHUNK_TERMS:
            return top_k(score_all(index, weighted), n, index.by, digits, index.buckets)
    # Wide enough for scores that only rounding makes equal to the floor.
    slack = 1e-9 if digits is None else 10.0 ** -digits + 1e-9
    terms = weighted.terms
    found = None
    for nth in range(chunks):
        chunk = terms if chunks == 1 else terms.filter(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == nth)
        part = pruned_scores(index, replace(weighted, terms=chunk, small=True), n, slack)
        found = part if found is None else found.unionByName(part)
    return top_k(found, n, index.by, digits)
