"""Runs: stretches of words that repeat with a period, found by internal pattern matching.

The suffix array of a document's words comes from prefix doubling, whose rounds also give, for every
block of 2^k words, the interval of suffixes that begin with it. A wavelet tree over the suffix array
answers where in the document the next and the previous occurrence of a block lie. For a block of m
words the occurrences within m words of it form an arithmetic progression; its difference, the
distance of the nearest one, is a candidate period. A run of period q and exponent 4 holds an aligned
block of the one dyadic length in [q, 2q), so no run is missed, and on that level the nearest
occurrence cannot be nearer than q, so every candidate is the smallest period of its stretch.

Documents are worked on side by side: words are numbered by document, so that no interval of the
suffix array holds two of them. A text is never cut; memory is linear in the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.tables import map_texts, whole_text

#: Runs repeat at least so often; what is proved above needs no less.
LEAST_EXPONENT = 4
LEAST_LENGTH = 6
#: Words of documents worked on at once; a longer document stands alone.
WORDS_AT_ONCE = 200_000

SCHEMA = (
    "doc_id {kind}, words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


class WaveletTree:
    """Order statistics of the numbers 0..n-1 in any interval of a permutation, for many intervals at once."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, int(len(values)).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def smaller(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval ``[low, high)`` are below its ``bound``."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            left, right = zeros[low], zeros[high]
            one = (bound >> bit & 1).astype(bool)
            found += np.where(one, right - left, 0)
            low, high = np.where(one, n_zeros + low - left, left), np.where(one, n_zeros + high - right, right)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of rank ``n``, from 0, in each interval."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            left, right = zeros[low], zeros[high]
            one = n >= right - left
            n = np.where(one, n - (right - left), n)
            low, high = np.where(one, n_zeros + low - left, left), np.where(one, n_zeros + high - right, right)
            value |= one.astype(np.int64) << bit
        return value


def _regroup(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a sorted list: the first place of its group of equal keys, and the group's size."""
    places = np.arange(len(sorted_keys))
    begins = np.ones(len(sorted_keys), bool)
    begins[1:] = sorted_keys[1:] != sorted_keys[:-1]
    heads = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    return places[heads][group], np.diff(np.append(heads, len(sorted_keys)))[group]


def suffix_blocks(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The suffix array of all documents, and by level ``(m, starts, low, high)`` of their repeated blocks.

    ``codes`` numbers the words so that no two documents share a number; ``first`` and ``end`` bound
    the document of each place. Blocks of m words begin at multiples of m and lie within a document
    of at least 2m words; ``[low, high)`` is the interval of suffixes that begin with the block.
    """
    n = len(codes)
    rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(codes, kind="stable")
    rank[order], size[order] = _regroup(codes[order])
    levels, m, active = [], 1, order
    while True:
        active = active[(size[active] > 1) & (end[active] - first[active] >= 2 * m)]
        if not len(active):
            return np.argsort(rank, kind="stable"), levels
        aligned = active[((active - first[active]) % m == 0) & (active + m <= end[active])]
        aligned = np.sort(aligned)
        levels.append((m, aligned, rank[aligned], rank[aligned] + size[aligned]))
        # Groups keep their places in the suffix array and are sorted within by what follows after m words.
        after = active + m
        follows = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follows
        by_key = np.argsort(key, kind="stable")
        active, key = active[by_key], key[by_key]
        group, _ = _regroup(rank[active])
        slot = rank[active] + np.arange(len(active)) - group
        head, count = _regroup(key)
        rank[active], size[active] = slot[head], count
        m *= 2


def candidate_stretches(tree: WaveletTree, m: int, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """``(period, begin, end)`` of stretches that two neighbouring occurrences of a block span, those in touch merged."""
    rank = tree.smaller(low, high, starts)
    has_next, has_previous = rank + 1 < high - low, rank > 0
    after = tree.nth(low[has_next], high[has_next], rank[has_next] + 1)
    before = tree.nth(low[has_previous], high[has_previous], rank[has_previous] - 1)
    begin = np.concatenate([starts[has_next], before])
    period = np.concatenate([after - starts[has_next], starts[has_previous] - before])
    near = (period <= m) & (2 * period > m)
    begin, period = begin[near], period[near]
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    # Stretches that share a period's length of words are one.
    new = np.ones(len(begin), bool)
    new[1:] = (period[1:] != period[:-1]) | (begin[1:] > begin[:-1] + m)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(begin))[: len(heads)] - 1
    return period[heads], begin[heads], begin[last] + period[heads] + m


def _equal_ahead(codes: np.ndarray, at: int, other: int, most: int) -> int:
    """How many words from ``at`` on equal those from ``other`` on, at most ``most``."""
    found, width = 0, 8
    while found < most:
        width = min(width, most - found)
        differ = codes[at + found:at + found + width] != codes[other + found:other + found + width]
        where = int(differ.argmax())
        if differ[where]:
            return found + where
        found += width
        width *= 4
    return most


def runs_of(codes: np.ndarray, first: np.ndarray, end: np.ndarray, exponent: int, length: int) -> list[tuple]:
    """``(begin, length, period)`` of every run, in order."""
    order, levels = suffix_blocks(codes, first, end)
    if not levels:
        return []
    tree, backwards = WaveletTree(order), codes[::-1]
    n, found = len(codes), set()
    for m, starts, low, high in levels:
        for q, b, e in zip(*(column.tolist() for column in candidate_stretches(tree, m, starts, low, high))):
            e += _equal_ahead(codes, e, e - q, int(end[b]) - e)
            b -= _equal_ahead(backwards, n - b, n - b - q, b - int(first[b]))
            if e - b >= max(length, exponent * q):
                found.add((b, e - b, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _collapsed(words: list[bytes], runs: list[tuple]) -> bytes:
    """The words that no run holds after its first period, joined by single blanks."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


def _group(texts: list[list[bytes]], exponent: int, length: int) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs and collapsed texts of some documents, given as lists of words."""
    sizes = np.array([len(words) for words in texts], np.int64)
    stop = np.cumsum(sizes)
    words = pa.array([word for text in texts for word in text], pa.binary()).dictionary_encode()
    document = np.repeat(np.arange(len(texts)), sizes)
    codes = document * (len(words.dictionary) + 1) + words.indices.to_numpy(zero_copy_only=False)
    first = np.repeat(stop - sizes, sizes)
    runs: list[list[tuple]] = [[] for _ in texts]
    for begin, size, period in runs_of(codes, first, np.repeat(stop, sizes), exponent, length):
        runs[document[begin]].append((begin - int(first[begin]), size, period))
    return runs, [_collapsed(text, found) for text, found in zip(texts, runs)]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = LEAST_EXPONENT,
    length: int = LEAST_LENGTH,
) -> DataFrame:
    """``doc_id, words, runs, collapsed`` of every row.

    Words are what white space (blank, tab, line feed, vertical tab, form feed, carriage return)
    separates, numbered from 0. A run is a longest stretch of at least ``length`` words and
    ``exponent`` (4 or more) times its smallest period; ``runs`` lists ``start, length, period`` by
    start, then period. ``collapsed`` is the text, single blanks between its words, without what
    follows the first period of a run. A null, empty or blank text has no words, no runs and an
    empty ``collapsed``. Rows with null or repeated ids are rows like others; other columns do not
    matter.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"exponent must be {LEAST_EXPONENT} or more, got {exponent}")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            # UTF-8 holds these bytes for the characters themselves only.
            texts = [text.as_buffer().to_pybytes().split() for text in batch.column("text")]
            at = 0
            while at < len(texts):
                stop, n_words = at + 1, len(texts[at])
                while stop < len(texts) and n_words + len(texts[stop]) <= WORDS_AT_ONCE:
                    n_words += len(texts[stop])
                    stop += 1
                runs, collapsed = _group(texts[at:stop], exponent, length)
                listed = [[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, stop - at), pa.array([len(words) for words in texts[at:stop]], pa.int64()),
                    pa.array(listed, kind), pa.array(collapsed, pa.string()),
                ], names=["doc_id", "words", "runs", "collapsed"])
                at = stop

    return map_texts(rows, find, SCHEMA.format(kind=dict(rows.dtypes)["doc_id"]))
