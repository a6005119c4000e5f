"""Lexical retrieval: BM25 in two flavours and ts_rank, for a whole table of topics at once.

Each scorer turns topics into weighted terms, joins them to the postings, and sums per
(query, document). Topics are ``(qid, contents)``; with a multi-corpus index they may carry its
``by`` columns, else every topic is put to every corpus.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import ANALYZERS, clean_query, query_words
from trawl.operators.index import Index
from trawl.operators.topk import top_k
from trawl.session import BROADCAST_BYTES, shuffle_partitions, stored

# k1 and b of the two BM25 flavours.
K1, B = 0.9, 0.4
FTS5_K1, FTS5_B = 1.2, 0.75
# Term-frequency cap, weight and normaliser of ts_rank.
MAX_POSITIONS = 255
LABEL_WEIGHT = 0.1
SQUARES_LIMIT = 1.64493406685
# Matches it takes before score bounds are tried for ts_rank, as a multiple of those of the other scorers.
EVEN = 1000
# Floor of the FTS5 idf.
MIN_IDF = 1e-6

# Places of ids that are looked into together when lists are filled up.
CELL = 4096

# In a shuffled join a term with more than this share of all postings is split. At most
# 1 / HOT_SHARE terms can exceed it, so the list of hot terms is always small.
HOT_SHARE = 1e-4
# Up to this many query terms are pushed down to the Parquet pages of the postings.
FEW_TERMS = 2000


@dataclass(frozen=True)
class Weighted:
    """Query terms ready to be scored.

    terms     by, qid, term, ceiling and whatever ``part`` reads; the ceiling is the most a
              document can get from the term
    part      what a posting adds to the score of its document
    rows      number of query terms before they met the vocabulary
    small     whether the terms were measured to fit a broadcast
    few       the terms themselves if there are only a few
    prunable  whether no part can be negative
    even      how many times as many matches it takes until bounds pay, for parts that differ little
    matches   how many postings they match, over all queries
    """

    terms: DataFrame
    part: Column
    rows: int
    small: bool
    few: list[str] | None = None
    prunable: bool = True
    matches: int = 0
    even: int = 1


def query_terms(topics: DataFrame, analyzer: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, term, qtf)``: distinct terms of each query and how often it repeats them."""
    keys = [*(c for c in by if c in topics.columns), "qid"]
    tokens = ANALYZERS[analyzer](F.col("contents"))
    words = topics.select(*keys, F.explode_outer(tokens).alias("term")).filter("term IS NOT NULL")
    return words.groupBy(*keys, "term").agg(F.count("*").alias("qtf"))


def weigh(index: Index, terms: DataFrame, part: Column, ceiling: Column, prunable: bool = True, **weights: Column) -> Weighted:
    """Measure query terms, attach ``df, n, avgdl`` and the computed ``weights`` to them.

    Terms of no document drop out. A topic without corpus columns is copied to every corpus. Both
    the terms and what they weigh are computed once and read again from the scratch folder.
    """
    shared = [c for c in index.by if c in terms.columns]
    copies = 1 if len(shared) == len(index.by) else max(1, index.stats.count())
    terms, counted = stored(terms)
    small = 2 * counted["bytes"] * copies <= BROADCAST_BYTES
    few = None
    if 0 < counted["rows"] <= FEW_TERMS:
        few = sorted({r.term for r in terms.select("term").collect()})
    known = index.vocab if few is None else index.vocab.filter(F.col("term").isin(few))
    known = known.join(F.broadcast(terms) if small else terms, [*shared, "term"])
    weighed, found = stored(known.withColumns(weights).withColumn("ceiling", ceiling), matches=F.col("df"))
    return Weighted(weighed, part, counted["rows"] * copies, small, few, prunable, found["matches"])


def join_postings(index: Index, weighted: Weighted, on: list[str], columns: list[str]) -> DataFrame:
    """Postings of the weighted terms, with the given columns of the terms.

    A small (measured) table of terms is broadcast and the postings stay where they are. A large
    one meets the postings in a shuffle, with the postings of hot terms salted by document and the
    weights of those terms copied once per salt.
    """
    postings, weights = index.postings, weighted.terms.select(*dict.fromkeys([*on, *columns]))
    if weighted.few is not None:
        postings = postings.filter(F.col("term").isin(weighted.few))
    if weighted.small:
        return postings.join(F.broadcast(weights), on)
    words, size = stored(weights.select("term").distinct())
    if 2 * size["bytes"] <= BROADCAST_BYTES:
        # Only postings of query terms travel.
        postings = postings.join(F.broadcast(words), "term", "left_semi")
    total = index.stats.agg(F.sum("postings")).first()[0] or 0
    share = max(1, int(total * HOT_SHARE))
    hot = (
        index.vocab.filter(F.col("df") > share)
        .groupBy("term").agg(F.ceil(F.max("df") / share).cast("int").alias("salts"))
    )
    one = F.coalesce("salts", F.lit(1))
    salted = (
        postings.join(F.broadcast(hot), "term", "left")
        .withColumn("salt", F.pmod(F.xxhash64("id"), one).cast("int")).drop("salts")
    )
    copies = (
        weights.join(F.broadcast(hot), "term", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    )
    return salted.join(copies, [*on, "salt"]).drop("salt")


# Columns of the weighted terms that the parts of the scorers read.
PART_COLUMNS = ["weight", "avgdl"]


def score_all(index: Index, weighted: Weighted) -> DataFrame:
    """``(by, qid, id, score)`` of every matching document."""
    matches = join_postings(index, weighted, [*index.by, "term"], ["qid", *PART_COLUMNS])
    return matches.groupBy(*index.by, "qid", "id").agg(F.sum(weighted.part).alias("score"))


def _saturation(k1: float, b: float) -> Column:
    tf = F.col("tf")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))


def bm25_terms(
    index: Index, topics: DataFrame, k1: float = K1, b: float = B, idf: str = "plus_one"
) -> Weighted:
    """Query terms for ``bm25``."""
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    return weigh(
        index, query_terms(topics, index.analyzer, index.by), F.col("weight") * _saturation(k1, b),
        F.col("weight") * (k1 + 1), prunable=idf == "plus_one",
        weight=F.log10(odds + 1 if idf == "plus_one" else odds),
    )


def bm25(
    index: Index, topics: DataFrame, k1: float = K1, b: float = B, idf: str = "plus_one"
) -> DataFrame:
    """``(by, qid, id, score)`` of every matching document; a repeated query word counts once.

    ``idf`` is ``plus_one`` (never negative) or ``classic``.
    """
    return score_all(index, bm25_terms(index, topics, k1, b, idf))


def fts5_idf() -> Column:
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(weight <= 0, F.lit(MIN_IDF)).otherwise(weight)


def _keys(by: tuple[str, ...], table: DataFrame) -> list[str]:
    """The corpus columns that topics or phrases name."""
    return [name for name in by if name in table.columns]


def query_phrases(topics: DataFrame, analyzer: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, phrase, qtf)``: each whitespace word of a query as an array of tokens.

    Most are one token long; a word with inner punctuation becomes a phrase of several.
    """
    keys = [*_keys(by, topics), "qid"]
    words = F.regexp_extract_all(F.coalesce("contents", F.lit("")), F.lit(r"\S+"), F.lit(0))
    words = topics.select(*keys, F.explode_outer(words).alias("word")).filter("word IS NOT NULL")
    phrases = words.select(*keys, ANALYZERS[analyzer](F.col("word")).alias("phrase"))
    return phrases.filter(F.size("phrase") > 0).groupBy(*keys, "phrase").agg(F.count("*").alias("qtf"))


def phrase_units(phrase: Column, frequent: tuple[str, ...]) -> Column:
    """``array<struct<offset, term>>``: words and stored pairs that together cover a phrase.

    A frequent word is only looked up with a neighbour, a pair that the index has a posting for;
    other words stand alone or in such a pair.
    """
    common, kind = list(frequent), "array<struct<offset:int,term:string>>"

    def cover(state: Column, i: Column) -> Column:
        word, after = F.get(phrase, i), F.get(phrase, i + 1)
        pair = after.isNotNull() & (word.isin(common) | after.isin(common))
        unit = F.when(pair, F.struct(i.alias("offset"), F.concat_ws(" ", word, after).alias("term")))
        unit = unit.when(word.isin(common) & (i > 0), F.struct((i - 1).alias("offset"), F.concat_ws(" ", F.get(phrase, i - 1), word).alias("term")))
        unit = unit.otherwise(F.struct(i.alias("offset"), word.alias("term")))
        more = F.struct((i + F.when(pair, 2).otherwise(1)).alias("next"), F.concat(state["units"], F.array(unit)).cast(kind).alias("units"))
        return F.when(i < state["next"], state).otherwise(more)

    start = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("units"))
    return F.aggregate(F.sequence(F.lit(0), F.size(phrase) - 1), start, cover, lambda state: state["units"])


def match_phrases(index: Index, phrases: DataFrame) -> DataFrame:
    """``(by, phrase, id, tf, len)``: documents holding the tokens of a phrase next to each other, in order.

    The units of a phrase, none of which is a frequent word of its own, are looked up twice: for the
    documents that hold all of them, and for their places there; a phrase of one unit is looked up
    once, without places. All postings of a document lie in one bucket, so they meet without a shuffle.
    """
    if not index.positional:
        raise ValueError("phrases need an index with positions")
    by, shared = list(index.by), _keys(index.by, phrases)
    distinct = phrases.select(*shared, "phrase").filter(F.size("phrase") > 0).distinct()
    numbered = distinct.withColumn("number", F.monotonically_increasing_id())
    units = numbered.withColumn("units", phrase_units(F.col("phrase"), index.frequent))
    units, counted = stored(units.select(*shared, "phrase", "number", F.size("units").alias("needed"), F.inline_outer("units")))
    small, few = 2 * counted["bytes"] <= BROADCAST_BYTES, counted["rows"] <= FEW_TERMS
    units_of = replace(index, postings=index.units)

    def weighted(some: DataFrame) -> Weighted:
        named = sorted({r.term for r in some.select("term").collect()}) if few else None
        return Weighted(some, F.lit(0.0), counted["rows"], small, named)

    # A phrase that is one stored pair stands wherever the pair does: the posting tells all.
    single, several = units.filter("needed = 1"), units.filter("needed > 1")
    held = join_postings(units_of, weighted(single), [*shared, "term"], ["number"]).select(*by, "number", "id", F.col("tf").cast("int").alias("tf"), "len")
    if not several.isEmpty():
        held = held.unionByName(_met(index, units_of, weighted(several), shared))
    # Every phrase has one unit at its very beginning.
    names = units.filter("offset = 0").select("number", "phrase")
    return held.join(F.broadcast(names) if small else names, "number").select(*by, "phrase", "id", "tf", "len")


def _met(index: Index, units_of: Index, weighted: Weighted, shared: list[str]) -> DataFrame:
    """``(by, number, id, tf, len)`` of phrases of several units."""
    by = list(index.by)
    # Documents that hold all units somewhere; their places are read for these alone.
    present = join_postings(units_of, weighted, [*shared, "term"], ["number", "needed"]).select(*by, "number", "needed", "id")
    whole = present.groupBy(*by, "number", "needed", "id").count().filter(F.col("count") == F.col("needed"))
    whole, size = stored(whole.select(*by, "number", "id"))
    found = join_postings(units_of, weighted, [*shared, "term"], ["number", "offset", "needed"])
    found = found.join(F.broadcast(whole) if 2 * size["bytes"] <= BROADCAST_BYTES else whole, [*by, "number", "id"], "left_semi")
    begins = F.filter(F.transform("positions", lambda p: p - F.col("offset")), lambda p: p >= 0)
    starts = found.select(*by, "number", "needed", "id", "len", F.explode(begins).alias("start"))
    # Where all units of a phrase agree on its beginning.
    met = starts.groupBy(*by, "number", "needed", "id", "start").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return met.filter(F.col("n") == F.col("needed")).groupBy(*by, "number", "id").agg(F.count("*").cast("int").alias("tf"), F.max("len").alias("len"))


def fts5_terms(index: Index, phrases: DataFrame, k1: float = FTS5_K1, b: float = FTS5_B) -> Weighted:
    """Query terms for ``bm25_fts5``: the phrases of one token."""
    keys = [*_keys(index.by, phrases), "qid"]
    single = phrases.filter(F.size("phrase") == 1).select(*keys, F.col("phrase")[0].alias("term"), "qtf")
    return weigh(
        index, single, F.col("weight") * _saturation(k1, b), F.col("weight") * (k1 + 1),
        weight=F.col("qtf") * fts5_idf(),
    )


def long_phrases(index: Index, phrases: DataFrame) -> DataFrame | None:
    """The phrases of several tokens, or None if the index has no positions or there are none."""
    several = phrases.filter(F.size("phrase") > 1)
    return None if not index.positional or several.isEmpty() else several


def phrase_scores(index: Index, several: DataFrame, k1: float = FTS5_K1, b: float = FTS5_B) -> DataFrame:
    """``(by, qid, id, score)``: what phrases of several tokens add to their documents."""
    keys = list(dict.fromkeys([*index.by, *_keys(index.by, several)]))
    # Read twice below: for the document frequencies and for the scores.
    found, _ = stored(match_phrases(index, several))
    freq = found.groupBy(*keys, "phrase").agg(F.count("*").alias("df"))
    if keys:
        freq = freq.join(index.stats.select(*keys, "n", "avgdl"), keys)
    else:
        one = index.stats.select("n", "avgdl").first()
        freq = freq.withColumns({"n": F.lit(one.n), "avgdl": F.lit(one.avgdl)})
    weighed = several.join(freq, [*_keys(index.by, several), "phrase"]).withColumn("weight", F.col("qtf") * fts5_idf())
    scored = found.join(weighed.select(*keys, "phrase", "qid", *PART_COLUMNS), [*keys, "phrase"])
    return scored.groupBy(*keys, "qid", "id").agg(F.sum(F.col("weight") * _saturation(k1, b)).alias("score"))


def bm25_fts5(index: Index, topics: DataFrame, k1: float = FTS5_K1, b: float = FTS5_B) -> DataFrame:
    """``(by, qid, id, score)`` in the manner of FTS5's bm25, sign turned so that more is better.

    Build the index ``with_id``, and ``positional`` if queries may hold words that split into
    several tokens: such a word is a phrase. A repeated query word counts each time.
    """
    phrases, _ = stored(query_phrases(topics, index.analyzer, index.by))
    singles = score_all(index, fts5_terms(index, phrases, k1, b))
    several = long_phrases(index, phrases)
    if several is None:
        return singles
    both = singles.unionByName(phrase_scores(index, several, k1, b))
    return both.groupBy(*index.by, "qid", "id").agg(F.sum("score").alias("score"))


def _inverse_squares(cap: int) -> Column:
    """Literal array: element i is the sum of 1/j^2 for j up to i."""
    sums, total = [], 0.0
    for j in range(1, cap + 1):
        total += 1.0 / (j * j)
        sums.append(total)
    return F.from_json(F.lit(json.dumps(sums)), "array<double>")


def _sum_of_squares(cap: int | None) -> Column:
    """Sum of 1/j^2 for j up to tf; ``cap`` ends it, None sums to the end."""
    if cap is not None:
        return F.element_at(_inverse_squares(cap), F.least(F.col("tf"), F.lit(cap)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda a, j: a + 1.0 / (j * j).cast("double"))


def ts_query(topics: DataFrame, analyzer: str = "simple", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, term, terms)``: distinct words of the cleaned query and how many there are.

    Words are cut as the "simple" configuration does, and then go through the analyzer of the index,
    as a query does in a configuration with stop words and stems.
    """
    keys = [*_keys(by, topics), "qid"]
    words = query_words(clean_query(F.coalesce("contents", F.lit(""))))
    if analyzer not in ("simple", "plain", "whitespace"):
        words = ANALYZERS[analyzer](F.array_join(words, " "))
    sized = topics.select(*keys, F.array_distinct(words).alias("words")).withColumn("terms", F.size("words"))
    return sized.select(*keys, "terms", F.explode_outer("words").alias("term")).filter("term IS NOT NULL")


def ts_rank_terms(index: Index, topics: DataFrame, norm: int = 0, cap: int | None = MAX_POSITIONS) -> Weighted:
    """Query terms for ``ts_rank``; repetitions of a word beyond ``cap`` add nothing, None counts all."""
    part = F.col("weight") * _sum_of_squares(cap)
    if norm == 1:
        part = part / F.log2(F.col("len") + 1.0)
    elif norm != 0:
        raise ValueError(f"norm must be 0 or 1, got {norm}")
    weight = LABEL_WEIGHT / SQUARES_LIMIT / F.col("terms")
    terms = ts_query(topics, index.analyzer, index.by)
    weighted = weigh(index, terms, part, F.lit(LABEL_WEIGHT) / F.col("terms"), weight=weight)
    # All words weigh the same and repetitions add little, so bounds leave most documents.
    return replace(weighted, even=EVEN)


def ts_rank(index: Index, topics: DataFrame, norm: int = 0, cap: int | None = MAX_POSITIONS) -> DataFrame:
    """``(by, qid, id, score)`` by term repetition alone; ``norm=1`` divides by log2(len + 1).

    Meant for an index analysed as ``simple`` or ``english``.
    """
    return score_all(index, ts_rank_terms(index, topics, norm, cap))


def match_any(index: Index, topics: DataFrame) -> DataFrame:
    """``(by, qid, id)`` of the documents that share a term with the query."""
    terms = query_terms(topics, index.analyzer, index.by).drop("qtf")
    weighted = weigh(index, terms, F.lit(0.0), F.lit(0.0))
    return join_postings(index, weighted, [*index.by, "term"], ["qid"]).select(*index.by, "qid", "id").distinct()


def _all_lists(index: Index, topics: DataFrame) -> DataFrame:
    """``(by, qid)`` of every list: a topic that names no corpus has one in each."""
    named = topics.select(*_keys(index.by, topics), "qid").distinct()
    missing = [name for name in index.by if name not in named.columns]
    if not missing:
        return named
    kinds = dict(index.stats.dtypes)
    corpora = [row.asDict() for row in index.stats.select(*missing).distinct().collect()]
    schema = ", ".join(f"`{name}`: {kinds[name]}" for name in missing)
    return named.select("*", F.inline(F.from_json(F.lit(json.dumps(corpora)), f"array<struct<{schema}>>")))


def _ranked_ids(index: Index, first: int | None) -> DataFrame:
    """``(by, id, pos)``: places from 0 of the ids of each corpus in order, of all or of the ``first``."""
    by, ids = list(index.by), index.doclens.select(*index.by, "id")
    if first is not None:
        one = ids.select("*", F.lit("").alias("qid"), F.lit(0.0).alias("score"))
        return top_k(one, first, index.by, None, index.buckets).select(*by, "id", (F.col("rank") - 1).cast("long").alias("pos"))
    parts = shuffle_partitions(ids.sparkSession)
    inside = ids.repartitionByRange(parts, *by, "id").sortWithinPartitions(*by, "id").select(
        *by, "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    inside, _ = stored(inside)
    # One row per range and corpus: how many ids of the corpus lie in the ranges before.
    sizes = inside.groupBy(*by, "part").agg(F.count("*").alias("size"), F.min("place").alias("least"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = inside.join(offsets, [*by, "part"]) if by else inside.join(offsets, "part")
    return placed.select(*by, "id", (F.col("offset") + F.col("place") - F.col("least")).alias("pos"))


def _free_places(lists: DataFrame, placed: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``(keys, pos)``: the n smallest places of each list below its ``limit`` that are not among ``placed``.

    Places are counted in cells of ``CELL``. How many are free before a cell follows from its number
    and the matches before it, so only cells with the n first free places are looked into; between
    cells with matches all is free. No group is larger than a cell.
    """
    cells = placed.groupBy(*keys, F.floor(F.col("pos") / CELL).alias("cell")).agg(F.count("*").alias("taken"))
    end = F.ceil(F.col("limit") / CELL)
    every = cells.join(lists, keys).select(*keys, "limit", "cell", "taken").unionByName(
        lists.select(*keys, "limit", end.alias("cell"), F.lit(0).cast("long").alias("taken")))
    in_order = Window.partitionBy(*keys).orderBy("cell")
    earlier = F.coalesce(F.sum("taken").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.coalesce(F.lag("cell").over(in_order), F.lit(-1))
    seen = every.select(*keys, "limit", "cell", "taken", earlier.alias("earlier"), last.alias("last"))
    # Read twice below; a row of it stands for up to a cell of places.
    seen, size = stored(seen)
    begin = (F.col("last") + 1) * CELL
    stop = F.least(F.col("cell") * CELL, F.col("limit"))
    gaps = seen.select(*keys, begin.alias("begin"), stop.alias("stop"), (begin - F.col("earlier")).alias("free"))
    gaps = gaps.filter((F.col("free") < n) & (F.col("begin") < F.col("stop")))
    between = gaps.select(*keys, F.explode(F.sequence("begin", F.least("stop", F.col("begin") + n - F.col("free")) - 1)).alias("pos"))
    first = F.col("cell") * CELL
    places = F.least(F.lit(CELL).cast("long"), F.col("limit") - first)
    mixed = seen.filter((first - F.col("earlier") < n) & (F.col("taken") > 0) & (F.col("taken") < places)).select(
        *keys, "cell", places.alias("size"), (F.lit(n) - first + F.col("earlier")).cast("int").alias("wanted"))
    # The places, one for every match, stay where they are: their files are far smaller than they are in memory.
    mixed = F.broadcast(mixed) if 2 * size["bytes"] <= BROADCAST_BYTES else mixed
    held = placed.withColumn("cell", F.floor(F.col("pos") / CELL)).join(mixed, [*keys, "cell"])
    held = held.groupBy(*keys, "cell", "size", "wanted").agg(F.collect_list("pos").alias("taken"))
    free = F.array_except(F.sequence(first, first + F.col("size") - 1), "taken")
    inside = held.select(*keys, F.explode(F.slice(free, F.lit(1), F.col("wanted"))).alias("pos"))
    return between.unionByName(inside)


def pad(hits: DataFrame, index: Index, topics: DataFrame, n: int, matches: DataFrame | None = None) -> DataFrame:
    """``(by, qid, id, score, rank)``: hit lists filled up to n with documents scored 0.

    The n smallest ids that match nothing lie among the 2n smallest ids of the corpus, as long as no
    score is negative. If some are, they may have to leave for the padding; ``matches`` must then hold
    ``(by, qid, id)`` of every match, and all ids are put in order. Topics without hits are padded too.
    """
    keys = [*index.by, "qid"]
    every = _all_lists(index, topics)
    # Read twice below, for the places and for the lists; n rows of a query are little to write.
    hits, _ = stored(hits.select(*keys, "id", "score"))
    first = 2 * n if matches is None else None
    ranked, _ = stored(_ranked_ids(index, first))
    sizes = index.stats.select(*index.by, (F.least("n", F.lit(first)) if first else F.col("n")).cast("long").alias("limit"))
    if index.by:
        lists = every.join(sizes, list(index.by))
    else:
        one = sizes.first()
        lists = every.withColumn("limit", F.lit(one.limit if one else 0).cast("long"))
    lists, _ = stored(lists)
    placed, _ = stored((hits if matches is None else matches).select(*keys, "id").join(ranked, [*index.by, "id"]).select(*keys, "pos"))
    free, size = stored(_free_places(lists, placed, keys, n))
    named = ranked.join(F.broadcast(free) if 2 * size["bytes"] <= BROADCAST_BYTES else free, [*index.by, "pos"])
    zeros = named.select(*keys, "id", F.lit(0.0).alias("score"))
    return top_k(hits.unionByName(zeros), n, index.by, digits=None)
