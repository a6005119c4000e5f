"""One search call over a whole table of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import tokenize
from trawl.operators.dense import cosine_top_k
from trawl.operators.fusion import rrf
from trawl.operators.index import Index, build_index
from trawl.operators.lexical import (
    PART_COLUMNS, bm25_terms, fts5_terms, long_phrases, pad, phrase_scores, query_phrases, score_all, ts_rank_terms,
)
from trawl.operators.pruned import best, wants_pruning
from trawl.operators.topk import DIGITS, drop_self, top_k
from trawl.session import BROADCAST_BYTES, stored
from trawl.sources.corpus import DENSE, SPARSE, kind_of

HYBRID = "hybrid"
# Flavour of lexical search and the analysis its index applies to stored contents.
FLAVOURS = {"bm25": "whitespace", "fts5": "porter", "ts_rank": "simple"}
DEFAULT_HITS = 1000


def index_contents(docs: DataFrame, flavour: str = "bm25", **options) -> Index:
    """Index a sparse table ``(id, contents)`` the way the flavour reads its text."""
    if flavour == "fts5":
        options = {"with_id": True, "positional": True, **options}
    return build_index(docs, analyzer=FLAVOURS[flavour], **options)


def method_of(tables: list[Index | DataFrame]) -> str:
    """Search method for one table, or for a sparse and a dense one in either order."""
    kinds = [SPARSE if isinstance(t, Index) else kind_of(t) for t in tables]
    if len(kinds) == 1:
        return kinds[0]
    if sorted(kinds) == sorted([SPARSE, DENSE]):
        return HYBRID
    raise ValueError(f"need one table, or a sparse and a dense one, got {kinds}")


def _one(tables: list, kind: type):
    found = [t for t in tables if isinstance(t, kind)]
    if not found:
        raise ValueError(f"this search needs a {kind.__name__} among its tables")
    return found[0]


def _fts5_hits(index: Index, topics: DataFrame, n: int, digits: int | None, prune: bool | None) -> DataFrame:
    """What phrases add to their documents joins the scores of single words.

    With pruning, documents that hold a phrase of a query get their whole score apart from the n
    best by single words: no other document can come before these, since phrases only add.
    """
    phrases, _ = stored(query_phrases(topics, index.analyzer, index.by))
    singles = fts5_terms(index, phrases)
    several = long_phrases(index, phrases)
    if several is None:
        return best(index, singles, n, digits, prune)
    keys = [*index.by, "qid", "id"]
    added = phrase_scores(index, several)
    if not wants_pruning(index, singles, prune):
        both = score_all(index, singles).unionByName(added)
        return top_k(both.groupBy(*keys).agg(F.sum("score").alias("score")), n, index.by, digits)
    added, size = stored(added)
    holders = added.select(*keys)
    by_words = best(index, singles, n, None, True).select(*keys, "score").join(holders, keys, "left_anti")
    # Postings meet the holders by document, where they lie, before they are multiplied by queries.
    weights = singles.terms.select(*index.by, "qid", "term", *PART_COLUMNS)
    asked = weights.select(*index.by, "term").distinct()
    postings = index.postings.join(F.broadcast(asked) if singles.small else asked, [*index.by, "term"], "left_semi")
    held = F.broadcast(holders) if 2 * size["bytes"] <= BROADCAST_BYTES else holders
    words = postings.join(held, [*index.by, "id"]).join(F.broadcast(weights) if singles.small else weights, [*index.by, "qid", "term"])
    both = words.groupBy(*keys).agg(F.sum(singles.part).alias("score")).unionByName(added)
    whole = both.groupBy(*keys).agg(F.sum("score").alias("score"))
    return top_k(by_words.unionByName(whole), n, index.by, digits)


def sparse_hits(
    index: Index, topics: DataFrame, flavour: str, n: int, padded: bool = False, digits: int | None = DIGITS,
    prune: bool | None = None,
) -> DataFrame:
    """``(by, qid, id, score, rank)`` of one lexical flavour."""
    if flavour == "bm25":
        hits = best(index, bm25_terms(index, topics), n, digits, prune)
    elif flavour == "fts5":
        hits = _fts5_hits(index, topics, n, digits, prune)
    elif flavour == "ts_rank":
        hits = best(index, ts_rank_terms(index, topics), n, digits, prune)
    else:
        raise ValueError(f"unknown flavour: {flavour}")
    return pad(hits, index, topics, n) if padded else hits


def search(
    topics: DataFrame,
    tables: list[Index | DataFrame],
    method: str | None = None,
    flavour: str = "bm25",
    n: int = DEFAULT_HITS,
    rrf_k: int = 60,
    analyzer: str | None = "english",
    padded: bool = False,
    digits: int | None = DIGITS,
    by: tuple[str, ...] | None = None,
) -> DataFrame:
    """Hits ``(by, qid, id, score, rank)`` of every topic ``(qid, contents, vector)``.

    ``tables`` holds an index (sparse), a DataFrame with embeddings (dense), or both in either
    order (hybrid). ``by`` tells corpora apart, each searched and ranked on its own; it defaults to
    that of the index, and an embeddings table has to carry the same columns. ``analyzer=None`` takes
    query text as analysed already. A query's own id is removed from its hits after the cut to n.
    """
    method = method or method_of(tables)
    if method not in (SPARSE, DENSE, HYBRID):
        raise ValueError(f"unknown search method: {method}")
    if method == HYBRID and len(tables) != 2:
        raise ValueError("hybrid search needs exactly two tables")
    indexes = [t for t in tables if isinstance(t, Index)]
    by = tuple(by if by is not None else indexes[0].by if indexes else ())
    if any(index.by != by for index in indexes) or any(set(by) - set(t.columns) for t in tables if not isinstance(t, Index)):
        raise ValueError(f"tables differ in their corpus columns {by}")
    if method != DENSE and analyzer is not None:
        topics = topics.withColumn("contents", tokenize(F.col("contents"), analyzer))
    if method == SPARSE:
        hits = sparse_hits(_one(tables, Index), topics, flavour, n, padded, digits)
    elif method == DENSE:
        hits = cosine_top_k(_one(tables, DataFrame), topics, n, digits, by)
    else:
        # The BM25 flavour ranks documents scored 0 as well and breaks ties by position; the
        # ts_rank flavour ranks matches only and lets ties share a rank.
        fills = padded or flavour == "bm25"
        hits = rrf(
            sparse_hits(_one(tables, Index), topics, flavour, n, fills, digits),
            cosine_top_k(_one(tables, DataFrame), topics, n, digits, by),
            n, rrf_k, "rank" if flavour == "ts_rank" else "row_number", by,
        )
    return drop_self(hits, by)
