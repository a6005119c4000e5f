"""Porter stemming of token arrays.

The word rules run in Python, but only once per distinct word of an Arrow batch: the batch is
dictionary-encoded, the dictionary is stemmed, and the indices rebuild the token arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules of M. F. Porter, "An algorithm for suffix stripping" (1980), with the
# two later revisions bli -> ble and logi -> log. In each step the longest suffix decides.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)

# Stems a task remembers across batches before it starts over.
KNOWN_WORDS = 500_000

# Executors get these functions inside the task, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _shape(word: str) -> str:
    """The word as v (vowel) and c (consonant); y is a vowel after a consonant."""
    shape: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(shape) and shape[-1] == "c")
        shape.append("v" if vowel else "c")
    return "".join(shape)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    for size in range(min(len(word), 7), 0, -1):
        if word[-size:] in suffixes:
            return word[-size:]
    return None


def _plural(word: str, bare: bool) -> str:
    if word.endswith(("sses", "ies")) and (bare or word not in ("sses", "ies")):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, {"ed", "ing"})
    if suffix is None or not _has_vowel(word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def _replace(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    if suffix is not None and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + rules[suffix]
    return word


def _drop(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) < 2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter(word: str, bare: bool = True) -> str:
    """Stem one lower-cased word; words of one or two letters stay as they are.

    ``bare`` tells whether a word that is nothing but the suffix ``ies`` or ``sses`` counts as
    having it: Lucene says yes, FTS5 no.
    """
    if len(word) < 3:
        return word
    word = _past(_plural(word, bare))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_drop(_replace(_replace(word, STEP_2), STEP_3)))


def _stem_words(words: list[str], known: dict[str, str], bare: bool) -> list[str]:
    if len(known) > KNOWN_WORDS:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = porter(word, bare)
    return [known[word] for word in words]


def _stem_batches(batches: Iterator[pa.Array], bare: bool) -> Iterator[pa.Array]:
    known: dict[str, str] = {}
    for tokens in batches:
        words = tokens.flatten().dictionary_encode()
        stems = pa.array(_stem_words(words.dictionary.to_pylist(), known, bare), pa.string())
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        yield pa.ListArray.from_arrays(offsets, stems.take(words.indices))


def stem_tokens(tokens: Column, bare: bool = True) -> Column:
    """Porter stems of an ``array<string>`` column, order and repeats kept."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stem(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _stem_batches(batches, bare)

    return stem(tokens)
