"""Text analysis as Column expressions: text column in, ``array<string>`` of tokens out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.stem import stem_tokens

# The 33 English stop words of Lucene's default English analysis.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
]

# Letters and digits; with underscore for the "simple" text-search configuration.
PLAIN_TOKEN = r"[\p{L}\p{N}]+"
SIMPLE_TOKEN = r"[\p{L}\p{N}_]+"
# Combining marks belong to the letter before them and are dropped when accents are folded.
FOLDED_TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"

# Word rule close to Unicode word segmentation, for lower-cased text: a Han or Hiragana character
# stands alone; other letters and digits run on, across ' . : between letters and ' . , ; between
# digits; underscores alone are no word.
_WORD = r"[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]\p{M}*"
ENGLISH_TOKEN = (
    r"[\p{IsHan}\p{IsHiragana}]\p{M}*"
    rf"|(?=_*+[\p{{L}}\p{{N}}])(?:{_WORD})+"
    rf"(?:(?:(?<=[\p{{L}}\p{{M}}])['’‘.:·](?=\p{{L}})|(?<=\p{{Nd}})['’‘.,;](?=\p{{Nd}}))(?:{_WORD})+)*"
)
# Possessive endings.
POSSESSIVES = ["'s", "’s", "＇s"]


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return _extract(F.lower(text), PLAIN_TOKEN)


def whitespace_tokens(text: Column) -> Column:
    """Whitespace-separated pieces, unchanged: the reading of text that is analysed already."""
    return _extract(text, r"\S+")


def simple_tokens(text: Column) -> Column:
    """Lower-cased words, underscore included, no stop words, no stemming."""
    return _extract(F.lower(text), SIMPLE_TOKEN)


def _single_mark_folds() -> tuple[str, str]:
    """Letters made of a base letter and exactly one combining mark, and their base letters."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    """Drop combining marks and replace letters carrying a single accent by their base letter."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_single_mark_folds())


def folded_tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    return _extract(fold_accents(F.lower(text)), FOLDED_TOKEN)


def porter_tokens(text: Column) -> Column:
    """``folded_tokens``, stemmed the way FTS5 does."""
    return stem_tokens(folded_tokens(text), bare=False)


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def _drop_possessive(token: Column) -> Column:
    size = F.length(token)
    return F.when(F.substr(token, size - 1).isin(POSSESSIVES), F.substr(token, F.lit(1), size - 2)).otherwise(token)


def english_words(text: Column) -> Column:
    """English analysis up to the stemmer: lower-case words, possessive 's removed, stop words out."""
    return drop_stop_words(F.transform(_extract(F.lower(text), ENGLISH_TOKEN), _drop_possessive))


def english_tokens(text: Column) -> Column:
    """Default English analysis: words, possessives, lower case, stop words, Porter stems."""
    return stem_tokens(english_words(text))


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "plain": plain_tokens,
    "whitespace": whitespace_tokens,
    "simple": simple_tokens,
    "folded": folded_tokens,
    "porter": porter_tokens,
    "english": english_tokens,
}


def tokenize(text: Column, analyzer: str = "english") -> Column:
    """Tokens joined by single spaces, the stored form of a parsed document."""
    return F.array_join(ANALYZERS[analyzer](text), " ")


def clean_query(text: Column) -> Column:
    """Words of a query joined by `` | ``, everything but word characters and spaces removed."""
    spaced = F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.array_join(F.regexp_extract_all(spaced, F.lit(r"(?U)\S+"), F.lit(0)), " | ")


def query_words(cleaned: Column) -> Column:
    """Lower-cased words of a ``clean_query`` string."""
    return F.filter(F.split(F.lower(cleaned), r" \| "), lambda w: w != "")


def natural_key(text: Column) -> Column:
    """Array that sorts ids naturally: text runs as text, digit runs as integers of any length.

    The array alternates text, digits, text, ...; a digit run becomes its length and its digits
    without leading zeros, so plain string order is integer order.
    """
    runs = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(run)

    keys = F.transform(runs, key)
    return F.when(text.rlike(r"^\d"), F.concat(F.array(F.lit("")), keys)).otherwise(keys)


def replace_nul(text: Column) -> Column:
    """NUL characters become U+FFFD, for stores that refuse them."""
    return F.translate(text, "\x00", "�")
