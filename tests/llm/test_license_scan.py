import math
import random
import re

from trawl.llm.license_scan import COVERAGE, PHRASES, RARE_WORDS, SLACK, TEMPLATES, build_index, document_frequencies, licenses, scan, vocabulary, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text):
    """n_words, n_base, first, last, base labels."""
    words, starts, labels = plain_words(text), [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert {"mit", "apache", "gpl", "cc"} <= {r.labels for r in rows}


def test_phrases_anywhere(spark):
    texts = {
        1: "MIT License. mit-license? MIT\nLICENSE mitlicense mit  license", 2: "xapache license apache licenses Apache license",
        3: "gnu general public license general public public license", 4: "mit", 5: "license mit", 6: "été mit license", 7: "mit é license",
        8: "apache mit license apache license"}
    rows = licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(rows, texts)
    assert {r.doc_id: r.n_base for r in rows} == {1: 4, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 2}
    assert {r.doc_id: r.starts for r in rows}[8] == [1, 3]


def test_templates_with_changed_words_and_without_key_phrases():
    index = build_index({}, 1000)
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    assert scan(index, words_of(f"x y {bsd} z"))[1:] == (set(), {"bsd"}, 1.0)
    _, _, labels, score = scan(index, words_of(f"a {bsd.replace('modification', 'changes')}"))
    assert labels == {"bsd"} and 0.7 <= score < 1
    assert scan(index, words_of(bsd.replace("source and binary forms", "text and other things")))[2] == set()
    assert scan(index, words_of(" ".join(sorted(bsd.split()))))[2] == set()
    _, base, labels, _ = scan(index, words_of("Licensed under CC BY-NC 4.0, released under the MIT License"))
    assert base == {"mit"} and labels == {"cc", "mit"}


def test_frequencies_cover_all_rows(odd_docs):
    counts, rows = document_frequencies(odd_docs, vocabulary())
    texts = [r.text for r in odd_docs.collect()]
    assert rows == len(texts)
    assert counts["of"] == sum("of" in plain_words(t) for t in texts)
    assert {p for p, _, _ in TEMPLATES} >= set(PHRASES.values())


def test_odd_rows(odd_docs, no_docs):
    rows = licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and licenses(no_docs).collect() == []
    by_id = {r.doc_id: r.text for r in odd_docs.filter("doc_id <> 8").collect()}
    check([r for r in rows if r.doc_id in by_id], by_id)


def labels_by_hand(text, idf):
    """Every place of a text tried for every template, with the longest common subsequence by plain recursion over a table."""
    words, labels, score = plain_words(text), set(), 0.0
    weight = lambda some: math.fsum(idf[w] for w in some)
    for label, notice, keys in TEMPLATES:
        template = notice.split()
        rare = sorted(set(template), key=lambda w: (-idf[w], w.encode()))[:RARE_WORDS]
        for begin in range(-len(template), len(words)):
            exact = any(0 <= begin + p < len(words) and words[begin + p] == w for p, w in enumerate(template) if w in rare)
            agree = [w for p, w in enumerate(template) if w in rare
                     and w in words[max(0, begin + p - SLACK):max(0, begin + p + SLACK + 1)]]
            if not exact or weight(agree) < COVERAGE * weight(w for w in template if w in rare) - 1e-9:
                continue
            window = words[max(0, begin - SLACK):max(0, begin + len(template) + SLACK)]
            table = [[0.0] * (len(window) + 1) for _ in range(len(template) + 1)]
            for i, w in enumerate(template, 1):
                for j, v in enumerate(window, 1):
                    table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + idf[w] if w == v else 0.0)
            covered = table[-1][-1] / weight(template)
            if round(covered, 12) >= COVERAGE and all(f" {key} " in f" {' '.join(window)} " for key in keys):
                labels.add(label)
                score = max(score, min(1.0, covered))
    base = set(filter(None, by_hand(text)[4].split(",")))
    return ",".join(sorted(base | labels)), max(score, COVERAGE) if base else score


def changed(rng, text):
    """A notice with some words put in, left out and replaced, between other words."""
    words = []
    for word in text.split():
        chance = rng.random()
        words += [] if chance < 0.05 else ["other"] if chance < 0.1 else [word, "more"] if chance < 0.15 else [word]
    around = lambda: [rng.choice("plain words of all kinds the software license".split()) for _ in range(rng.randrange(12))]
    return " ".join(around() + words + around())


def test_labels_and_scores_of_changed_notices(spark):
    rng = random.Random(3)
    rows = [(i, changed(rng, TEMPLATES[i % len(TEMPLATES)][1])) for i in range(150)]
    rows += [(1000 + i, rng.choice([t for _, t, _ in TEMPLATES]) + ". " + changed(rng, rng.choice(TEMPLATES)[1])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, n = document_frequencies(docs, vocabulary())
    idf = {w: math.log1p(n / (1 + counts.get(w, 0))) for w in vocabulary()}
    found = {r.doc_id: (r.labels, r.score) for r in licenses(docs).collect()}
    for doc_id, text in rows:
        labels, score = labels_by_hand(text, idf)
        assert found[doc_id][0] == labels and abs(found[doc_id][1] - score) < 1e-9
    assert sum(bool(labels) for labels, _ in found.values()) > 100


def test_words_put_into_a_notice(spark):
    index = build_index({}, 1000)
    grant = ("permission is hereby granted without written agreement and free of any charge to any natural person obtaining a copy of "
             "this software and all associated documentation files")
    assert scan(index, words_of(grant))[2] == set()  # a key phrase is broken
    assert scan(index, words_of(grant.replace("any charge", "charge")))[2] == {"mit"}
    assert scan(index, words_of(grant.replace("any charge", "charge").replace("obtaining a copy", "using a copy")))[2] == set()
