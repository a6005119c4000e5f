"""License scan by a positional index of rare words.

Template texts are indexed by their words. Document frequencies over the whole corpus give every
template word its IDF. In a file, the license words of highest IDF look up their postings
``(template, position)``; hits that agree, give or take a few words, on the place where the template
would begin are counted. Where enough of them agree, the template's words are matched in order within
the window, so that words put in or left out do no harm, and its mandatory key phrases are looked
for there. Plain phrases are found by the same index: a phrase is a template of which every word
must stand in its place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.tables import map_texts, whole_text

#: Phrases whose every place counts, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notices as their licences word them, with the key phrases that must stand near a match.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["free of charge", "obtaining a copy"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software", ["substantial portions of the software"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis", ["agreed to in writing"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license", ["general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "affero general public license as published by the free software foundation", ["affero general public license"]),
    ("cc", "licensed under cc by nc 4 0", ["licensed under", "cc by"]),
    ("cc", "this work is licensed under a creative commons attribution license", ["creative commons"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["source and binary forms"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution",
     ["list of conditions"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies",
     ["with or without fee"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable for any damages arising from the use of this software", ["authors be held liable"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["public domain"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
              "and accompanying documentation covered by this license", ["person or organization"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
]
#: Rarest words of a template that are looked up in its postings.
RARE_WORDS = 6
#: Part of a template's IDF that must be found in place.
COVERAGE = 0.7
#: Words by which places may differ, and by which a window is wider than its template on either side.
SLACK = 4

#: Maps A-Z to a-z and every byte that is not of a word to a blank; bytes of other scripts stay.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


@dataclass
class Index:
    """Templates as words, postings of their rare words, IDF of all their words and of the rare ones together."""

    templates: list[tuple[str, list[bytes], list[list[bytes]]]]
    whole_idf: list[float]
    rare_idf: list[float]
    phrases: list[tuple[str, list[bytes]]]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]
    anchors: dict[bytes, list[tuple[int, int]]]


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> list[str]:
    texts = [text for _, text, _ in templates] + [p for _, _, keys in templates for p in keys] + list(phrases)
    return sorted({word.decode() for text in texts for word in words_of(text)})


def build_index(frequencies: dict[str, int], documents: int, templates=TEMPLATES, phrases=PHRASES) -> Index:
    idf = {
        word.encode(): math.log1p(documents / (1 + frequencies.get(word, 0)))
        for word in vocabulary(templates, phrases)}
    parsed = [(label, words_of(text), [words_of(key) for key in keys]) for label, text, keys in templates]
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    rare_idf = []
    for number, (_, words, _) in enumerate(parsed):
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        rare_idf.append(sum(idf[word] for word in words if word in rare))
        for place, word in enumerate(words):
            if word in rare:
                postings[word].append((number, place))
    fixed = [(label, words_of(phrase)) for phrase, label in phrases.items()]
    anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for number, (_, words) in enumerate(fixed):
        place = min(range(len(words)), key=lambda i: (-idf[words[i]], i))
        anchors[words[place]].append((number, place))
    whole_idf = [sum(idf[word] for word in words) for _, words, _ in parsed]
    return Index(parsed, whole_idf, rare_idf, fixed, idf, dict(postings), dict(anchors))


def _has(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def in_order(template: list[bytes], window: list[bytes], idf: dict[bytes, float]) -> float:
    """The most IDF of template words that stand in the window in the template's order."""
    best = [0.0] * (len(window) + 1)
    for word in template:
        weight, diagonal = idf[word], 0.0
        for i, found in enumerate(window, 1):
            above = best[i]
            best[i] = max(above, best[i - 1], diagonal + weight if found == word else 0.0)
            diagonal = above
    return best[-1]


def agreeing(index: Index, number: int, begins: dict[int, set[int]]) -> Iterator[int]:
    """Places that a rare word in its place gives as the template's begin and that enough others agree with.

    ``begins`` has the places of rare words in the template, by the begin they give. Each counts once.
    """
    template = index.templates[number][1]
    for begin in sorted(begins):
        near = set().union(*(begins.get(begin + d, ()) for d in range(-SLACK, SLACK + 1)))
        if sum(index.idf[template[place]] for place in near) >= COVERAGE * index.rare_idf[number]:
            yield begin


def scan(index: Index, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of all phrase places, base labels, all labels, and the best template coverage."""
    lookups = {*index.postings, *index.anchors}.intersection(words)
    starts, base, labels, score = [], set(), set(), 0.0
    if not lookups:
        return starts, base, labels, score
    begins: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for at, word in enumerate(words):
        if word not in lookups:
            continue
        for number, place in index.anchors.get(word, ()):
            label, phrase = index.phrases[number]
            if at >= place and words[at - place:at - place + len(phrase)] == phrase:
                starts.append(at - place)
                base.add(label)
        for number, place in index.postings.get(word, ()):
            begins[number][at - place].add(place)
    for number, found in begins.items():
        label, template, keys = index.templates[number]
        for begin in agreeing(index, number, found):
            window = words[max(0, begin - SLACK):max(0, begin + len(template) + SLACK)]
            covered = round(in_order(template, window, index.idf) / index.whole_idf[number], 12)
            if covered >= COVERAGE and all(_has(window, key) for key in keys):
                labels.add(label)
                score = max(score, min(1.0, covered))
    if base:
        score = max(score, COVERAGE)
    return starts, base, base | labels, score


def _distinct_terms(terms: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents = Counter(), 0
        for batch in batches:
            for text in batch.column("text"):
                documents += 1
                found.update(terms.intersection(words_of(text.as_py())))
        rows = [(term.decode(), n) for term, n in found.items()] + [(None, documents)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
            names=["term", "n"])

    return count


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many rows each term stands, and the number of rows; a task sends one row per term at most."""
    wanted = frozenset(term.encode() for term in terms)
    counted = map_texts(docs.select(whole_text(text_col).alias("text")), _distinct_terms(wanted), "term string, n long")
    totals = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return totals, totals.pop(None, 0)


def licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, starts`` of every row.

    ``starts`` lists the first words of all phrase places. A text without words, or null, has none
    of anything and score 0. Of several matches of one label only the label counts; a tie between
    templates changes nothing, since labels are sets. ``score`` is the largest part of a matched
    template's IDF found in order, at least ``COVERAGE`` where a phrase stands, else 0.
    """
    index = build_index(*document_frequencies(docs, vocabulary(templates, phrases), text_col), templates, phrases)
    named = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = dict(named.dtypes)["doc_id"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                starts, base, labels, score = scan(index, words)
                starts = sorted(starts)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), score, starts))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "starts"])

    return map_texts(
        named, label, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
               "labels string, score double, starts array<long>")
