"""Near copies by DartMinHash signatures, banded joining and exact verification.

Every element of a document (a five-word shingle) owns a region of the plane: its weight wide, and
without end along the rank axis. Darts fall on the plane as a Poisson process fixed by hashes
alone; those inside the document's regions belong to it. Each dart names one of ``COORDINATES``
coordinates, and the dart of lowest rank per coordinate is the signature there. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity. Only darts below a rank
bound are thrown, about ``k ln k`` per document however many shingles it has; a document with an
empty coordinate throws again with a bound twice as high, which changes no earlier dart.

Documents with equal bands are candidates, checked by the exact similarity of their shingle sets.
A set with too many elements that no other candidate has cannot reach the similarity with any, and
leaves; two sets that can share too little are not compared. Within a bucket the members meet a few
leaders first; classes grow from the links, and only members of buckets that still hold several
classes meet more leaders, until every pair of different classes in a bucket was compared or ruled
out. A group of thousands of copies so costs thousands of pairs, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import SMALLER, digest_of, keep_one, map_texts, same_text, stored, whole_text, worker_memo

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 shares one of 28 bands of 6 coordinates with probability 0.9998.
BANDS = 28
BAND_ROWS = 6
COORDINATES = BANDS * BAND_ROWS
#: Darts of an element are thrown one at a time, those after the first few in blocks. The ranks are
#: sums whose last bits depend on this, so it is the same for every element.
SINGLE_THROWS = 4
THROWN_TOGETHER = 32
#: Leaders each bucket has tried after the first, second, ... round.
FIRST_LEADERS = 3
MORE_LEADERS = 8
MEMO_WORDS = 300_000
CHUNK_CHARS = 1_000_000

_U = np.uint64


class _Words(dict):
    """64-bit hashes of words, remembered by a Python worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes their bits look random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, one after the other, and the number of each text.

    Words are lower-cased runs without white space. A text of one to four words has one shingle, of
    all its words; a text without words has none.
    """
    remembered = worker_memo("shingles", _Words)
    split = [text.lower().split() for text in texts]
    counts = np.array([len(words) for words in split], np.int64)
    hashes = np.fromiter((remembered[w] for words in split for w in words), _U, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - position
    total = np.zeros(len(hashes), _U)
    with np.errstate(over="ignore"):
        for step in range(SHINGLE):
            ahead = np.zeros(len(hashes), _U)
            ahead[:len(hashes) - step] = hashes[step:]
            inside = left > step
            total = np.where(inside, mixed_bits(total * _U(0x9E3779B97F4A7C15) + ahead), total)
    whole = (left >= SHINGLE) | (position == 0)
    return total[whole], np.bincount(owner[whole], minlength=len(texts))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper bits."""
    return ((bits >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(
    elements: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None, coordinates: int = COORDINATES,
    darts: int | None = None,
) -> np.ndarray:
    """Signature of each set: ``elements`` holds the sets one after the other, ``counts`` their sizes.

    ``weights`` (default 1) are positive. A repeated element counts once with its largest weight.
    The dart process of an element is cut along the weight axis into cells of width 1; a dart beyond
    the element's weight within its last cell misses. An empty set gets zeros.
    """
    darts = darts or int(coordinates * (np.log(coordinates) + 2))
    found = np.zeros((len(counts), coordinates), _U)
    if weights is None:
        weights = np.ones(len(elements))
    cells = np.ceil(weights).astype(np.int64)
    cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.minimum(np.repeat(weights, cells) - cell, 1.0)
    with np.errstate(over="ignore"):
        seed = mixed_bits(np.repeat(elements, cells) + _U(0x9E3779B97F4A7C15) * (cell.astype(_U) + _U(1)))
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), cells)
    mass = np.bincount(owner, weights=width, minlength=len(counts))
    open_sets = np.flatnonzero(mass > 0)
    bound = np.zeros(len(counts))
    bound[open_sets] = darts / mass[open_sets]
    while len(open_sets):
        mine = np.isin(owner, open_sets) if len(open_sets) < len(counts) else slice(None)
        filled = _throw(seed[mine], width[mine], owner[mine], bound, found, coordinates)
        open_sets = open_sets[~filled[open_sets]]
        bound[open_sets] *= 2
    return found


def _throw(seed, width, owner, bound, found, coordinates) -> np.ndarray:
    """Throws all darts below each set's rank bound; tells which sets have every coordinate."""
    first = np.full(found.size, np.inf)
    flat = found.reshape(-1)
    rank, thrown, number = np.zeros(len(seed)), [], 0
    with np.errstate(over="ignore"):
        while len(seed):
            together = 1 if number < SINGLE_THROWS else THROWN_TOGETHER
            numbers = np.arange(number + 1, number + 1 + together, dtype=_U) * _U(0xD1B54A32D192ED03)
            number += together
            bits = mixed_bits(seed[:, None] + numbers)
            ranks = rank[:, None] - np.cumsum(np.log(_uniform(bits)), axis=1)
            below = ranks < bound[owner][:, None]
            element = np.nonzero(below)[0]
            bits, ranks_below = bits[below], ranks[below]
            dart = mixed_bits(bits ^ _U(0xA0761D6478BD642F))
            hit = _uniform(dart) <= width[element]
            dart, ranks_below = dart[hit], ranks_below[hit]
            at = owner[element[hit]] * coordinates + (mixed_bits(dart) % _U(coordinates)).astype(np.int64)
            np.minimum.at(first, at, ranks_below)
            thrown.append((at, ranks_below, dart))
            more = below[:, -1]
            seed, width, owner, rank = seed[more], width[more], owner[more], ranks[more, -1]
    for at, ranks, dart in thrown:
        wins = ranks == first[at]
        flat[at[wins]] = dart[wins]
    return np.isfinite(first).reshape(found.shape).all(axis=1)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands do not share keys."""
    rows = signature.reshape(len(signature), bands, -1)
    keys = np.tile(np.arange(1, bands + 1, dtype=_U), (len(rows), 1))
    with np.errstate(over="ignore"):
        for column in range(rows.shape[2]):
            keys = mixed_bits(keys * _U(0x9E3779B97F4A7C15) + rows[:, :, column])
    return keys.view(np.int64)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for text in texts:
        chunk.append(text.as_py())
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _add_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column("text")):
            elements, counts = shingles(texts)
            keys = band_keys(signatures(elements, counts))
            sizes = np.where(counts > 0, BANDS, 0)
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), _lists(keys[counts > 0].reshape(-1), sizes)],
                names=["doc_id", "digest", "bands"])


def _add_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column("text")):
            elements, counts = shingles(texts)
            ends = np.cumsum(counts)
            sets = [np.unique(elements[end - n:end]) for end, n in zip(ends, counts)]
            sizes = np.array([len(s) for s in sets], np.int64)
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), _lists(np.concatenate(sets), sizes)], names=["node", "shingles"])


def banded(texts: DataFrame) -> DataFrame:
    """``row, doc_id, digest, bands`` of rows ``doc_id, digest, text``; ``bands`` is empty for a text without words."""
    kind = dict(texts.dtypes)["doc_id"]
    signed = map_texts(texts.select("doc_id", "digest", "text"), _add_bands, f"doc_id {kind}, digest string, bands array<long>")
    return signed.select(F.monotonically_increasing_id().alias("row"), "*")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``leader, member, shared, similar``: the common elements of each pair's sets, and whether they suffice."""
    left = sets.select(F.col("node").alias("member"), F.col("shingles").alias("of_member"))
    right = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("of_leader"))
    both = pairs.join(right, "leader").join(left, "member")
    shared = F.size(F.array_intersect("of_member", "of_leader"))
    union = F.size("of_member") + F.size("of_leader") - F.col("shared")
    return both.withColumn("shared", shared).select(
        "leader", "member", "shared", (F.col("shared") >= similarity * union).alias("similar"))


def _grow(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining those that ``links`` connect: the smallest label spreads along the links.

    Each step sends every class the smallest class number among its neighbours, and then follows
    two pointers at once, so that the number of steps grows with the logarithm of a chain's length.
    """
    ends = links.join(labels.select(F.col("node").alias("member"), F.col("label").alias("a")), "member").join(
        labels.select(F.col("node").alias("leader"), F.col("label").alias("b")), "leader")
    edges = ends.filter("a != b").select("a", "b").distinct()
    edges = stored(edges.union(edges.select("b", "a")).distinct())
    if edges.isEmpty():
        return labels
    parents = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent"))
    while True:
        parents = stored(parents)
        up = parents.select(F.col("a").alias("b"), F.col("parent").alias("b_parent"))
        near = edges.join(up, "b").groupBy("a").agg(F.min("b_parent").alias("near"))
        jump = parents.select(F.col("a").alias("parent"), F.col("parent").alias("over"))
        following = parents.join(near, "a").join(jump, "parent").select(
            "a", F.col("parent").alias("was"), F.least("parent", "near", "over").alias("parent"))
        following = stored(following)
        parents = following.select("a", "parent")
        if following.filter("was != parent").isEmpty():
            break
    moved = parents.select(F.col("a").alias("label"), "parent")
    return stored(labels.join(moved, "label", "left").select("node", F.coalesce("parent", "label").alias("label")))


def _linkable(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, size, common`` of the sets that can be similar to another one.

    ``common`` is the number of elements that any other set has, and bounds every intersection.
    """
    elements = sets.select("node", F.explode("shingles").alias("element"))
    alone = elements.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    lonely = alone.groupBy("node").agg(F.count("*").alias("lonely"))
    sized = sets.select("node", F.size("shingles").alias("size")).join(lonely, "node", "left")
    common = sized.select("node", "size", (F.col("size") - F.coalesce("lonely", F.lit(0))).alias("common"))
    return common.filter(F.col("common") >= similarity * F.col("size"))


def _order() -> Column:
    """Sets that have the least of their own come first: they are nearest to the middle of a group."""
    return F.struct(((F.col("size") - F.col("common")) / F.col("size")).alias("lonely"), "node")


def _pivots(compared: DataFrame, able: DataFrame) -> DataFrame:
    """``node, pivot, held``: of the sets that ``node`` was compared with the first, and what they share."""
    places = able.select("node", _order().alias("place"))
    both = compared.select(F.col("leader").alias("node"), F.col("member").alias("other"), "shared").unionByName(
        compared.select(F.col("member").alias("node"), F.col("leader").alias("other"), "shared"))
    met = both.join(places.select(F.col("node").alias("other"), "place"), "other").select("node", "other", "shared", "place")
    own = able.select("node", F.col("node").alias("other"), F.col("size").alias("shared"), _order().alias("place"))
    first = F.min_by(F.struct("other", "shared"), "place").alias("first")
    return met.unionByName(own).groupBy("node").agg(first).select(
        "node", F.col("first.other").alias("pivot"), F.col("first.shared").alias("held"))


def _within_bounds(similarity: float) -> Column:
    """Whether what two sets can share at all allows the similarity.

    They share no more than either shares with any other set. With one pivot for both, they share
    within it no more than either does, and beyond it no more than either has there in common with
    any other set.
    """
    most = F.least("common", "leader_common")
    beyond = F.least(F.col("common") - F.col("held"), F.col("leader_common") - F.col("leader_held"))
    by_pivot = F.least("held", "leader_held") + F.greatest(beyond, F.lit(0))
    most = F.when(F.col("pivot") == F.col("leader_pivot"), F.least(most, by_pivot)).otherwise(most)
    return most >= similarity * (F.col("size") + F.col("leader_size") - most)


def classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row, doc_id, digest, label`` of rows ``doc_id, text``, ``row`` being a number of its own for each.

    ``label`` is the smallest row of a distinct text of the class. Texts without words are near
    copies only of equal texts. ``texts`` is read twice, and no text is written.
    """
    texts = texts.withColumn("digest", digest_of(F.col("text")))
    signed = stored(banded(texts))
    # Equal texts collapse before anything else; from here on a node is a distinct text.
    first = F.min(F.struct("row", "doc_id")).alias("first")
    nodes = stored(signed.groupBy("digest").agg(first, F.first("bands").alias("bands")).select(
        F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), "digest", "bands"))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    in_buckets = stored(members.join(shared, "bucket"))
    ids = nodes.select("node", F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"))
    candidates = stored(in_buckets.select("node").distinct().join(ids, "node"))
    wanted = texts.join(candidates.hint(SMALLER), same_text()).select("node", "text")
    # Rows that repeat with their id bring a node's text more than once.
    sets = stored(map_texts(wanted, _add_shingles, "node long, shingles array<long>").dropDuplicates(["node"]))

    able = stored(_linkable(sets, similarity))
    labels = able.select("node", F.col("node").alias("label"))
    unknown = F.lit(None).cast("long").alias("pivot"), F.lit(None).cast("int").alias("held")
    left = stored(in_buckets.join(able.select("*", *unknown), "node"))
    tried, leaders, tested = 0, FIRST_LEADERS, None
    while not left.isEmpty():
        turn = Window.partitionBy("bucket").orderBy(_order())
        heads = left.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= leaders)
        heads = heads.filter(F.col("turn") > tried).select(
            "bucket", F.col("node").alias("leader"),
            *(F.col(c).alias(f"leader_{c}") for c in ("size", "common", "pivot", "held")))
        known = labels.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
        met = left.join(labels, "node").join(heads.join(known, "leader"), "bucket")
        pairs = met.filter(F.col("label") != F.col("leader_label")).filter(_within_bounds(similarity)).select(
            F.least("node", "leader").alias("leader"), F.greatest("node", "leader").alias("member")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("leader", "member"), ["leader", "member"], "left_anti")
        compared = stored(_compared(pairs, sets, similarity))
        labels = _grow(labels, compared.filter("similar"))
        # Buckets go on while they hold several classes and members that led nobody yet.
        open_buckets = left.join(labels, "node").groupBy("bucket").agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members"))
        open_buckets = open_buckets.filter((F.col("least") != F.col("most")) & (F.col("members") > leaders))
        left = left.join(open_buckets.select("bucket"), "bucket", "left_semi")
        if tested is None:
            left = left.drop("pivot", "held").join(_pivots(compared, able), "node")
        left = stored(left)
        tested = compared if tested is None else tested.unionByName(compared)
        tried, leaders = leaders, leaders * MORE_LEADERS
    named = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    return signed.select("row", "doc_id", "digest").join(named, "digest")


def _chosen(found: DataFrame) -> DataFrame:
    """Adds the class's size and its first row, ``first``; classes are counted before they meet their rows."""
    found = stored(found)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "digest")
    # Written, so that the join does not reuse the aggregate's layout and Spark can split a large class.
    each = stored(found.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("class_size")))
    return found.join(each, "label")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of every row.

    Rows are in one class when a chain of links connects them; equal texts are linked, and so are
    texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. ``class_id`` is
    the smallest doc_id of the class, and one row with that id is kept. A null text is empty; a null
    id counts as larger than any other. Repeated rows are copies of each other.
    """
    return _chosen(classes(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")))).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``near_classes``, with all its columns unchanged."""
    chosen = _chosen(classes(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return keep_one(docs, chosen.select("doc_id", "digest", kept.alias("kept")), id_col, text_col)
