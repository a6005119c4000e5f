"""Language of whole texts by a linear-chain conditional random field over their words.

Each word is a position of the chain, each language a label; what has no blanks is cut into
positions of bounded length, so that every character is read. A word's score for a language is the
sum of weights of its features: the word itself, affixes, n-grams (hashed), and the shares of the
languages in a lexicon. Learned transitions tie neighbouring words together. The labels of the
words, and so of code-switched text, are their marginals by forward-backward; the language of a
text is the label with the largest mean marginal.

The field is fitted on the driver to a bounded sample of labelled rows (``SAMPLE_ROWS`` per
language, ``MAX_LANGUAGES`` languages); every row and every word of the table is labelled by tasks.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import RECORD, map_texts, whole_text, worker_memo

#: Labelled rows per language that the field is fitted to, and languages at most (the most frequent).
SAMPLE_ROWS = 120
MAX_LANGUAGES = 200
#: Characters of sample text per language that are read; long rows give the same number each, short ones all.
SAMPLE_CHARS = 600_000
BUCKETS = 1 << 16
LEXICON_WORDS = 20_000
SEQUENCE = 48
EPOCHS = 3
BATCH = 64
RATE = 0.3
UNKNOWN = "und"
#: Texts whose best language scores less are rejected.
LEAST_SCORE = 0.3
#: Words a Python worker remembers with their scores; texts and words it works on at a time.
MEMO_WORDS = 200_000
CHUNK_WORDS = 200_000
#: Words whose features are held at a time.
SCORED_WORDS = 8192
#: Characters of a position of the chain, and of one in a script that sets no blanks between words:
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Bopomofo, Han and their like.
MAX_WORD = 40
MAX_RUN = 8
_RUN = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u312f\u31a0-\u31bf\u31f0-\u9fff" \
    "\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_RUN}]")
PARTS = re.compile(f"[{_RUN}]{{1,{MAX_RUN}}}|[^{_RUN}]{{1,{MAX_WORD}}}")


def words_of(text: str) -> list[str]:
    """Positions of the chain: words between blanks, long ones and runs of unspaced scripts in parts.

    The parts of a word are the whole word.
    """
    words = text.split()
    if not text.isascii() and UNSPACED.search(text):
        return [part for word in words for part in ([word] if word.isascii() and len(word) <= MAX_WORD else PARTS.findall(word))]
    if words and max(map(len, words)) > MAX_WORD:
        return [part for word in words for part in ([word] if len(word) <= MAX_WORD else PARTS.findall(word))]
    return words


def bare(token: str) -> str:
    """The word of a token: lower case, letters and inner marks only at its ends; empty if it has no letter."""
    if token.isalpha():
        return token.lower()
    start, end = 0, len(token)
    while start < end and not token[start].isalpha():
        start += 1
    while end > start and not token[end - 1].isalpha():
        end -= 1
    return token[start:end].lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the features of all words, one word after the other, and their numbers.

    A word's features are itself, its first and last one to four bytes, and all pairs and triples of
    neighbouring bytes, the ends being marked.
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    data = np.frombuffer(b"".join(b"<" + r + b">" for r in raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - starts[owner]
    left = sizes[owner] - place
    ahead = [np.concatenate([data[step:], np.zeros(step, np.uint64)]) for step in range(4)]
    owners, codes = [], []

    def add(kind: int, who: np.ndarray, code: np.ndarray) -> None:
        owners.append(who)
        codes.append(code * np.uint64(16) + np.uint64(kind))

    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x100000001B3, np.uint64))
        add(0, np.arange(len(words)), np.add.reduceat(data * powers[place], starts))
        pair = data * np.uint64(256) + ahead[1]
        add(1, owner[left >= 2], pair[left >= 2])
        triple = pair * np.uint64(256) + ahead[2]
        add(2, owner[left >= 3], triple[left >= 3])
        code = np.zeros(len(data), np.uint64)
        for n in range(1, 5):
            code = code * np.uint64(256) + ahead[n - 1]
            long = np.flatnonzero(sizes - 2 > n)
            add(2 * n + 1, long, code[starts[long] + 1])
            add(2 * n + 2, long, code[starts[long] + sizes[long] - 1 - n])
        who, code = np.concatenate(owners), np.concatenate(codes)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    buckets = ((code >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(who, kind="stable")
    return buckets[order], np.bincount(who, minlength=len(words))


@dataclass
class Field:
    """Weights of the field. ``lexicon`` maps a word to its row of ``shares``, row 0 is for others."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    shares: np.ndarray
    shares_weight: np.ndarray
    start: np.ndarray
    transitions: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        if len(words) > SCORED_WORDS:
            return np.concatenate([self.scores(words[at:at + SCORED_WORDS]) for at in range(0, len(words), SCORED_WORDS)])
        flat, sizes = features(words)
        sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        known = np.fromiter((self.lexicon.get(word, 0) for word in words), np.int64, len(words))
        return sums + self.shares[known] @ self.shares_weight


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray):
    """Forward-backward over a batch of chains, longest first: ``scores`` is (chain, place, label).

    Gives the marginals of each place and the expected number of each transition.
    """
    chains, places, labels = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    alive = [int((lengths > t).sum()) for t in range(places)]
    forward = np.zeros_like(emit)
    forward[:, 0] = emit[:, 0] * np.exp(start)
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, places):
        n = alive[t]
        step = (forward[:n, t - 1] @ move) * emit[:n, t]
        forward[:n, t] = step / step.sum(axis=1, keepdims=True)
    backward = np.ones_like(emit)
    expected = np.zeros((labels, labels))
    for t in range(places - 2, -1, -1):
        n = alive[t + 1]
        ahead = emit[:n, t + 1] * backward[:n, t + 1]
        back = ahead @ move.T
        scale = (forward[:n, t] * back).sum(axis=1, keepdims=True)
        expected += move * ((forward[:n, t] / scale).T @ ahead)
        backward[:n, t] = back / back.sum(axis=1, keepdims=True)
    both = forward * backward
    total = both.sum(axis=2, keepdims=True)
    return np.divide(both, total, out=np.zeros_like(both), where=total > 0), expected


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Field:
    """The field learned from ``(text, language)`` rows.

    Words take the language of their text. Chains for training alternate runs of words from texts of
    different languages, so that transitions learn how often a text changes its language.
    """
    languages = sorted({language for _, language in samples})
    number = {language: i for i, language in enumerate(languages)}
    runs = [([w for w in map(bare, words_of(text)) if w], number[language]) for text, language in sorted(samples)]
    runs = [(words, label) for words, label in runs if words]
    counts: dict[str, Counter] = defaultdict(Counter)
    for words, label in runs:
        for word in words:
            counts[word][label] += 1
    frequent = sorted(counts, key=lambda w: (-sum(counts[w].values()), w))
    frequent = [w for w in frequent if sum(counts[w].values()) >= 3][:LEXICON_WORDS]
    size = len(languages)
    shares = np.zeros((len(frequent) + 1, size))
    for row, word in enumerate(frequent, 1):
        for label, n in counts[word].items():
            shares[row, label] = n
        shares[row] /= shares[row].sum()
    model = Field(
        languages, np.zeros((BUCKETS, size), np.float64), {w: i for i, w in enumerate(frequent, 1)}, shares,
        np.zeros((size, size)), np.zeros(size), np.zeros((size, size)))
    if size < 2:
        return model

    vocabulary = sorted(counts)
    place = {word: i for i, word in enumerate(vocabulary)}
    flat, sizes = features(vocabulary)
    buckets = np.split(flat, np.cumsum(sizes)[:-1])
    known = np.array([model.lexicon.get(word, 0) for word in vocabulary])
    random = np.random.default_rng(seed)
    chains = _chains(runs, place, random)
    squares = [np.full_like(a, 1e-6) for a in (model.weights, model.shares_weight, model.start, model.transitions)]
    for _ in range(EPOCHS):
        order = random.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            _step(model, [chains[i] for i in order[at:at + BATCH]], buckets, known, squares)
    return model


def _chains(runs, place, random) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training chains of ``SEQUENCE`` words; half of them switch between languages."""
    streams: dict[int, list[int]] = defaultdict(list)
    for words, label in runs:
        streams[label] += [place[w] for w in words]
    chains = []
    labels = sorted(streams)
    for label in labels:
        words = np.array(streams[label])
        for at in range(0, len(words), SEQUENCE):
            chains.append((words[at:at + SEQUENCE], np.full(len(words[at:at + SEQUENCE]), label)))
    pure = len(chains)
    for _ in range(pure // 2):
        words, tags = [], []
        while len(words) < SEQUENCE:
            label = labels[random.integers(len(labels))]
            length = int(random.integers(3, 20))
            at = int(random.integers(max(1, len(streams[label]) - length)))
            part = streams[label][at:at + length]
            words += part
            tags += [label] * len(part)
        chains.append((np.array(words[:SEQUENCE]), np.array(tags[:SEQUENCE])))
    return chains


def _step(model: Field, chains, buckets, known, squares) -> None:
    """One step of Adagrad on the log-likelihood of a batch of chains."""
    chains = sorted(chains, key=lambda c: -len(c[0]))
    lengths = np.array([len(words) for words, _ in chains])
    size, places = len(model.languages), int(lengths[0])
    flat = np.concatenate([words for words, _ in chains])
    tags = np.concatenate([labels for _, labels in chains])
    at_chain = np.repeat(np.arange(len(chains)), lengths)
    at_place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sizes = np.array([len(buckets[w]) for w in flat])
    features = np.concatenate([buckets[w] for w in flat])
    scale = 1 / np.sqrt(sizes)
    emission = np.add.reduceat(model.weights[features], np.cumsum(sizes) - sizes, axis=0) * scale[:, None]
    share = model.shares[known[flat]]
    emission += share @ model.shares_weight
    scores = np.zeros((len(chains), places, size))
    scores[at_chain, at_place] = emission
    found, expected = marginals(scores, lengths, model.start, model.transitions)
    wrong = np.eye(size)[tags] - found[at_chain, at_place]
    count = len(flat)
    gradient = np.repeat(wrong * scale[:, None], sizes, axis=0)
    weights = np.stack([np.bincount(features, gradient[:, k], BUCKETS) for k in range(size)], axis=1)
    moves = -expected
    follows = at_place[1:] > 0
    np.add.at(moves, (tags[:-1][follows], tags[1:][follows]), 1)
    begin = wrong[at_place == 0].sum(axis=0)
    parts = (model.weights, model.shares_weight, model.start, model.transitions)
    for value, change, square in zip(parts, (weights, share.T @ wrong, begin, moves), squares):
        change = change / count ** 0.5
        square += change * change
        value += RATE * change / np.sqrt(square)


class _Seen:
    """Scores of the words a Python worker has seen: the place of each token and word, the scores."""

    def __init__(self, languages: int):
        self.place: dict[str, int] = {}
        self.words = {"": 0}
        self.table = np.zeros((1 << 12, languages), np.float32)
        self.used = 1


def _scored(model: Field, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token in the table of scores, 0 for a token without a letter, and the table."""
    seen = worker_memo(("crf", model.name), lambda: _Seen(len(model.languages)))
    if len(seen.place) > MEMO_WORDS:
        seen.__init__(len(model.languages))
    places = list(map(seen.place.get, tokens))
    unknown = [i for i, found in enumerate(places) if found is None]
    if unknown:
        new = {}
        for token in {tokens[i] for i in unknown}:
            word = bare(token)
            row = seen.words.get(word)
            if row is None:
                row = seen.words[word] = seen.used + len(new)
                new[word] = row
            seen.place[token] = row
        while seen.used + len(new) > len(seen.table):
            seen.table = np.concatenate([seen.table, np.zeros_like(seen.table)])
        seen.table[seen.used:seen.used + len(new)] = model.scores(list(new))
        seen.used += len(new)
        for i in unknown:
            places[i] = seen.place[tokens[i]]
    return np.array(places, np.int64), seen.table


def label_texts(model: Field, texts: list[str]) -> list[tuple[str, float]]:
    """Language and mean marginal of each text; ``und`` and 0 for a text without a letter."""
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    split = [words_of(text) for text in texts]
    places, table = _scored(model, [token for tokens in split for token in tokens])
    ends = np.cumsum([len(tokens) for tokens in split])
    kept = [own[own > 0] for own in np.split(places, ends[:-1])] if texts else []
    order = sorted((i for i, own in enumerate(kept) if len(own)), key=lambda i: -len(kept[i]))
    at = 0
    while at < len(order):
        # Chains of like length go through together; a batch holds a bounded number of places.
        longest = len(kept[order[at]])
        batch = order[at:at + max(1, CHUNK_WORDS // longest)]
        at += len(batch)
        lengths = np.array([len(kept[i]) for i in batch])
        inside = np.arange(longest) < lengths[:, None]
        scores = np.zeros((len(batch), longest, len(model.languages)))
        scores[inside] = table[np.concatenate([kept[i] for i in batch])]
        shares = marginals(scores, lengths, model.start, model.transitions)[0].sum(axis=1) / lengths[:, None]
        for i, share in zip(batch, shares):
            best = int(share.argmax())
            found[i] = (model.languages[best], float(min(1.0, share[best])))
    return found


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """``(text, language)`` of a bounded sample of rows that are not held out and have a language.

    Counts per language set a rate that yields about twice the wanted rows, of which those with the
    smallest hashes are taken; no other text leaves its task. Of rows too long for all of them to be
    read whole, the same number of characters each.
    """
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))
    learned = named.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    hashed = learned.withColumn("hash", F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")))
    grain = 1 << 30
    rates = F.create_map(*[
        x for lang, n in counts for x in (F.lit(lang), F.lit(min(grain, 2 * SAMPLE_ROWS * grain // n + 1)))])
    # Few rows of a language: all of them. Else rows below the rate, ranked by the rest of the hash.
    likely = hashed.withColumn("rate", rates[F.col("lang")]).filter(
        (F.col("rate") >= grain) | (F.pmod("hash", F.lit(grain)) < F.col("rate")))
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    ranked = likely.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= SAMPLE_ROWS)
    # Shorter rows leave what they do not use to the longer ones, which share the rest evenly.
    every, rising = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.length("text"), "turn")
    shorter = F.coalesce(F.sum(F.length("text")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = (F.lit(SAMPLE_CHARS) - shorter) / (F.count("*").over(every) - F.row_number().over(rising) + 1)
    rows = ranked.withColumn("each", each).withColumn("most", F.floor(F.max("each").over(every)).cast("int"))
    return [(r.text, r.lang) for r in rows.select(F.expr("substring(text, 1, most)").alias("text"), "lang").collect()]


def held_out(doc_id):
    """Rows never learned from: a third, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, and the columns named in ``keep``.

    Predictions see the text alone. A null, empty or letterless text is ``und`` with score 0, and so
    is every text when no row has a language to learn from. A null id is not held out.
    """
    rows = sample(docs, id_col, text_col, lang_col)
    model = fit(rows) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [F.col(c) for c in keep or []]
    named = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), whole_text(text_col).alias("text"),
        *([F.struct(*extra).alias("kept")] if extra else []))
    schema = ", ".join(f"{n} {t}" for n, t in named.dtypes if n != "text") + ", lang_pred string, score double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text"), []
            for chunk in _chunks(texts):
                found += label_texts(shared.value, chunk) if shared.value else [(UNKNOWN, 0.0)] * len(chunk)
            columns = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*names, "lang_pred", "score"])

    return map_texts(named, label, schema)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for text in texts:
        chunk.append(text.as_py())
        chars += len(chunk[-1])
        if chars >= 6 * CHUNK_WORDS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def drop_unclear(
    docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Rows whose text has a language with at least this score; all columns unchanged.

    Texts in two or three languages stay; what goes has no letters, or no language for a third of its words.
    """
    named = (F.col(column).alias(name) for column, name in ((id_col, "doc_id"), (text_col, "text"), (lang_col, "lang")))
    found = languages(docs.select(F.struct(F.col("*")).alias(RECORD), *named), keep=[RECORD])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(f"kept.{RECORD}.*")
