"""The registered queries in DuckDB SQL, written from the scoring formulas.

Core SQL only: no full-text extension. Each statement stands alone; shared CTEs are put in front.
"""

from __future__ import annotations

import re

from trawl.functions.stem import STEP_2, STEP_3, STEP_4

PLAIN = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SIMPLE = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
FOLDED = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
STOP = (
    "['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or',"
    "'such','that','the','their','then','there','these','they','this','to','was','will','with']"
)
TURNS = "turns AS (SELECT conv_id || '-' || turn AS id, role, text FROM conversations)"
DOCS = "docs AS (SELECT doc_id::VARCHAR AS id, text AS contents, lang FROM documents)"
TOPICS = "topics AS (SELECT item_id::VARCHAR AS qid, text AS contents FROM benchmark)"
VECTORS = "vectors AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS embedding, label FROM embeddings)"
FULL_TOPICS = (
    "full_topics AS (SELECT t.qid, t.contents, v.embedding AS vector FROM topics t LEFT JOIN vectors v ON v.id = t.qid)"
)


def index_ctes(pattern: str, by: str = "", with_id: bool = False, docs: str = DOCS) -> str:
    """tokens, postings, doclens, vocab and stats; ``by`` is '' or 'lang, '."""
    tokens = pattern.format("contents")
    if with_id:
        tokens = f"list_concat({pattern.format('id')}, {tokens})"
    group = f"GROUP BY {by[:-2]}" if by else ""
    return f"""{docs},
    doc_tokens AS (SELECT {by} id, {tokens} AS tokens FROM docs),
    doclens AS (SELECT {by} id, len(tokens) AS len FROM doc_tokens),
    exploded AS (SELECT {by} id, unnest(tokens) AS term FROM doc_tokens),
    postings AS (SELECT {by} id, term, count(*) AS tf FROM exploded GROUP BY {by} id, term),
    vocab AS (SELECT {by} term, count(*) AS df FROM postings GROUP BY {by} term),
    stats AS (SELECT {by} count(*)::DOUBLE AS n, avg(len) AS avgdl FROM doclens {group})"""


def ranked(scored: str, n: int, keys: str = "qid", digits: int | None = 10) -> str:
    """The n best of each query; ties are scores equal in so many decimals."""
    score = "score" if digits is None else f"round(score, {digits})"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS rank
    FROM (SELECT {keys}, id, {score} AS score FROM {scored})) WHERE rank <= {n}"""


def top(scored: str, n: int, keys: str = "qid") -> str:
    """The same, with scores as they are printed."""
    return f"SELECT * REPLACE (round(score, 6) AS score) FROM ({ranked(scored, n, keys)})"


QUERY_TERMS = f"""{TOPICS},
    qwords AS (SELECT qid, unnest({PLAIN.format('contents')}) AS term FROM topics),
    qterms AS (SELECT DISTINCT qid, term FROM qwords)"""

def bm25(by: str = "", docs: str = DOCS, classic: bool = False) -> str:
    """CTE ``bm25``; ``by`` is '' or 'lang'."""
    keys, same = (f"p.{by}, ", f" AND {{}}.{by} = p.{by}") if by else ("", "")
    stats = f"JOIN stats s ON s.{by} = p.{by}" if by else ", stats s"
    idf = "log10((s.n - v.df + 0.5) / (v.df + 0.5))" if classic else "log10((s.n - v.df + 0.5) / (v.df + 0.5) + 1)"
    return f"""{index_ctes(PLAIN, f"{by}, " if by else "", docs=docs)}, {QUERY_TERMS},
    bm25 AS (SELECT {keys}q.qid, p.id, sum({idf}
            * p.tf * 1.9 / (p.tf + 0.9 * (0.6 + 0.4 * d.len / s.avgdl))) AS score
        FROM qterms q JOIN postings p USING (term) JOIN vocab v ON v.term = p.term{same.format("v")}
        JOIN doclens d ON d.id = p.id{same.format("d")} {stats}
        GROUP BY {keys}q.qid, p.id)"""


BM25 = bm25()
PADDED = """padded AS (SELECT t.qid, d.id, coalesce(b.score, 0) AS score
        FROM topics t CROSS JOIN docs d LEFT JOIN bm25 b ON b.qid = t.qid AND b.id = d.id)"""
BM25_PADDED = f"{BM25}, {PADDED}"
BM25_BY_GROUP = bm25("lang")
PADDED_BY_GROUP = """padded AS (SELECT d.lang, t.qid, d.id, coalesce(b.score, 0) AS score FROM topics t CROSS JOIN docs d
        LEFT JOIN bm25 b ON b.qid = t.qid AND b.id = d.id AND b.lang = d.lang)"""
MORE_DOCS = """docs AS (SELECT doc_id::VARCHAR AS id, text AS contents FROM documents
        UNION ALL SELECT conv_id || '-' || turn AS id, text AS contents FROM conversations)"""
DOTTED = r"topics AS (SELECT item_id::VARCHAR AS qid, regexp_replace(text, '^(\S+) (\S+)', '\1.\2') AS contents FROM benchmark)"


def fts5(topics: str = TOPICS, by: str = "") -> str:
    """CTE ``fts5``: every word of a query is a phrase, most of one token; ``by`` is '' or 'lang, '."""
    same = " AND {0}.lang = {1}.lang" if by else ""
    stats = "JOIN stats s ON s.lang = m.lang" if by else ", stats s"
    return rf"""{index_ctes(FOLDED, by, with_id=True)}, {topics},
    qwords AS (SELECT qid, unnest(regexp_extract_all(contents, '\S+')) AS word FROM topics),
    qphrases AS (SELECT qid, {FOLDED.format('word')} AS phrase FROM qwords),
    qcounts AS (SELECT qid, phrase, count(*) AS qtf FROM qphrases WHERE len(phrase) > 0 GROUP BY qid, phrase),
    parts AS (SELECT phrase, unnest(phrase) AS term, generate_subscripts(phrase, 1) AS at
        FROM (SELECT DISTINCT phrase FROM qcounts)),
    fenced AS (SELECT {by}id, list_concat({FOLDED.format('id')}, [''], {FOLDED.format('contents')}) AS tokens FROM docs),
    places AS (SELECT {by}id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS at FROM fenced),
    starts AS (SELECT {by}phrase, id, p.at - q.at AS start FROM parts q JOIN places p USING (term)
        GROUP BY {by}phrase, id, p.at - q.at HAVING count(*) = len(phrase)),
    matches AS (SELECT {by}phrase, id, count(*) AS tf FROM starts GROUP BY {by}phrase, id),
    freq AS (SELECT {by}phrase, count(*) AS df FROM matches GROUP BY {by}phrase),
    fts5 AS (SELECT {"m.lang, " if by else ""}q.qid, m.id, sum(q.qtf
            * CASE WHEN s.n - f.df + 0.5 <= f.df + 0.5 THEN 1e-6 ELSE ln((s.n - f.df + 0.5) / (f.df + 0.5)) END
            * m.tf * 2.2 / (m.tf + 1.2 * (0.25 + 0.75 * d.len / s.avgdl))) AS score
        FROM qcounts q JOIN matches m USING (phrase) JOIN freq f ON f.phrase = m.phrase{same.format("f", "m")}
        JOIN doclens d ON d.id = m.id{same.format("d", "m")} {stats}
        GROUP BY {"m.lang, " if by else ""}q.qid, m.id)"""


def ts_rank(norm: int, by: str = "") -> str:
    """CTE ``ts``; ``by`` is '' or 'lang, '."""
    divisor = "/ log2(any_value(d.len) + 1)" if norm else ""
    group = "p.lang, " if by else ""
    return f"""{index_ctes(SIMPLE, by)}, {TOPICS},
    qwords AS (SELECT DISTINCT qid, unnest({SIMPLE.format('contents')}) AS term FROM topics),
    qsize AS (SELECT qid, count(*) AS terms FROM qwords GROUP BY qid),
    parts AS (SELECT {by}id, term, 0.1 / 1.64493406685
        * list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0::DOUBLE / (j * j))) AS part FROM postings),
    ts AS (SELECT {group}q.qid, p.id, sum(p.part) / any_value(z.terms) {divisor} AS score
        FROM qwords q JOIN parts p USING (term) JOIN qsize z ON z.qid = q.qid JOIN doclens d ON d.id = p.id
        GROUP BY {group}q.qid, p.id)"""


COSINE = f"""{TOPICS}, {VECTORS}, {FULL_TOPICS},
    cosine AS (SELECT t.qid, v.id, list_cosine_similarity(v.embedding, t.vector) AS score
        FROM full_topics t, vectors v)"""
COSINE_TAIL = f"""{VECTORS}, {FULL_TOPICS},
    cosine AS (SELECT t.qid, v.id, list_cosine_similarity(v.embedding, t.vector) AS score
        FROM full_topics t, vectors v)"""


COSINE_BY_GROUP = f"""{VECTORS}, {FULL_TOPICS},
    cosine AS (SELECT g.lang, t.qid, v.id, list_cosine_similarity(v.embedding, t.vector) AS score
        FROM full_topics t, vectors v JOIN docs g ON g.id = v.id)"""


def fused(sparse: str, n: int, rank: str, keys: str = "qid") -> str:
    """CTEs fusing ``sparse`` and ``cosine``, each cut to n; ``rank`` is row_number or rank."""
    score_rank = "rank" if rank == "row_number" else f"rank() OVER (PARTITION BY {keys} ORDER BY score DESC)"
    return f"""list_a AS (SELECT {keys}, id, {score_rank} AS r FROM ({ranked(sparse, n, keys)})),
    list_b AS (SELECT {keys}, id, {score_rank} AS r FROM ({ranked('cosine', n, keys)})),
    fused AS (SELECT {keys}, id, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score
        FROM list_a a FULL OUTER JOIN list_b b USING ({keys}, id))"""


def without_self(hits: str, keys: str = "qid") -> str:
    return f"""SELECT {keys}, id, score, row_number() OVER (PARTITION BY {keys} ORDER BY rank) AS rank
    FROM ({hits}) WHERE id <> qid"""


RUNS = "CASE WHEN len(tokens) >= 8 THEN list_transform(range(1, len(tokens) - 6), lambda i: array_to_string(tokens[i:i + 7], ' ')) ELSE [] END"


def judged(by: str = "") -> str:
    """CTE ``judged``: documents that share eight neighbouring words with a topic; needs doc_tokens and topics."""
    return f"""topic_tokens AS (SELECT qid, {PLAIN.format('contents')} AS tokens FROM topics),
    topic_runs AS (SELECT DISTINCT qid, unnest({RUNS}) AS run FROM topic_tokens),
    doc_runs AS (SELECT DISTINCT {by}id, unnest({RUNS}) AS run FROM doc_tokens),
    judged AS (SELECT DISTINCT {by}qid, id, 1 AS rel FROM topic_runs JOIN doc_runs USING (run))"""


def ndcg(by: str = "") -> str:
    """CTE ``scores`` of CTEs ``run`` and ``qrels``; ``by`` is '' or 'lang, '."""
    keys = f"{by}qid"
    return f"""placed AS (SELECT {keys}, id, row_number() OVER
            (PARTITION BY {keys} ORDER BY score::FLOAT DESC, id DESC) AS place FROM run),
    dcg AS (SELECT {keys}, sum(rel / log2(place + 1)) AS dcg
        FROM placed JOIN qrels USING ({keys}, id) WHERE place <= 10 GROUP BY {keys}),
    best AS (SELECT {keys}, rel, row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC) AS place FROM qrels),
    ideal AS (SELECT {keys}, sum(rel / log2(place + 1)) AS ideal FROM best WHERE place <= 10 GROUP BY {keys}),
    scores AS (SELECT {keys}, coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0) AS ndcg
        FROM ideal LEFT JOIN dcg USING ({keys}))"""


def run_and_judgements(hits: str) -> str:
    return f"{BM25}, {judged()}, run AS ({hits}), qrels AS (SELECT * FROM judged), {ndcg()}"


SPARSE_RUN = run_and_judgements(without_self(ranked("bm25", 10)))

def shape(word: str) -> str:
    """A word as V (vowel) and C (consonant): y is a vowel after a consonant."""
    marked = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    marked = f"regexp_replace({marked}, '^y', 'C')"
    for _ in range(3):
        marked = f"regexp_replace(regexp_replace({marked}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return marked


def measure(shaped: str) -> str:
    return f"len(regexp_extract_all({shaped}, 'V+C+'))"


def short_end(word: str, shaped: str) -> str:
    return f"(ends_with({shaped}, 'CVC') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _suffix_step(name: str, source: str, rules: dict[str, str]) -> str:
    """The longest suffix decides; it is replaced behind a stem of measure above 0."""
    cases = " ".join(f"WHEN '{suffix}' THEN '{new}'" for suffix, new in rules.items())
    return f"""{name}_found AS (SELECT word, w, {shape('w')} AS s, regexp_extract(w, '({"|".join(rules)})$') AS suffix FROM {source}),
    {name} AS (SELECT word, CASE WHEN suffix <> '' AND {measure("left(s, length(w) - length(suffix))")} > 0
        THEN left(w, length(w) - length(suffix)) || CASE suffix {cases} END ELSE w END AS w FROM {name}_found)"""


def stems(words: str) -> str:
    """CTE ``stems (word, stem)`` of a CTE with distinct lower-case words, by the rules of M. F. Porter (1980)."""
    return f"""plural AS (SELECT word, CASE WHEN regexp_matches(word, '(sses|ies)$') THEN left(word, length(word) - 2)
        WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN left(word, length(word) - 1) ELSE word END AS w
        FROM {words} WHERE length(word) > 2),
    past_found AS (SELECT word, w, {shape('w')} AS s, regexp_extract(w, '(eed|ed|ing)$') AS suffix FROM plural),
    past_cut AS (SELECT word, suffix, CASE
        WHEN suffix = 'eed' THEN CASE WHEN {measure("left(s, length(w) - 3)")} > 0 THEN left(w, length(w) - 1) ELSE w END
        WHEN suffix <> '' AND contains(left(s, length(w) - length(suffix)), 'V') THEN left(w, length(w) - length(suffix))
        ELSE w END AS w, suffix IN ('ed', 'ing') AND contains(left(s, length(w) - length(suffix)), 'V') AS cut FROM past_found),
    past_shaped AS (SELECT *, {shape('w')} AS s FROM past_cut),
    past AS (SELECT word, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
        WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND ends_with(s, 'C') THEN
            CASE WHEN right(w, 1) NOT IN ('l', 's', 'z') THEN left(w, length(w) - 1)
            WHEN {measure('s')} = 1 AND {short_end('w', 's')} THEN w || 'e' ELSE w END
        WHEN {measure('s')} = 1 AND {short_end('w', 's')} THEN w || 'e' ELSE w END AS w FROM past_shaped),
    ending AS (SELECT word, CASE WHEN ends_with(w, 'y') AND contains(left({shape('w')}, length(w) - 1), 'V')
        THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM past),
    {_suffix_step("second", "ending", STEP_2)},
    {_suffix_step("third", "second", STEP_3)},
    fourth_found AS (SELECT word, w, {shape('w')} AS s, regexp_extract(w, '({"|".join(STEP_4)})$') AS suffix FROM third),
    fourth AS (SELECT word, CASE WHEN suffix <> '' AND {measure("left(s, length(w) - length(suffix))")} > 1
        AND (suffix <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN left(w, length(w) - length(suffix)) ELSE w END AS w
        FROM fourth_found),
    without_e AS (SELECT word, w, left(w, length(w) - 1) AS v, left({shape('w')}, length(w) - 1) AS s FROM fourth),
    fifth AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({measure('s')} > 1 OR {measure('s')} = 1 AND NOT {short_end('v', 's')})
        THEN v ELSE w END AS w FROM without_e),
    stems AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {measure(shape('w'))} > 1 THEN left(w, length(w) - 1) ELSE w END AS stem
        FROM fifth UNION ALL SELECT word, word FROM {words} WHERE length(word) < 3)"""


# Inner marks of a word are found with captures, as there is no look-around: each gets a private character
# behind it, twice over, since neighbouring matches overlap. The tables hold no Han or Hiragana.
_MARK = "\ue000"
_MARKED = "lower(contents)"
for _rule in (r"([\p{L}\p{M}])(['’‘.:·])(\p{L})", r"(\p{Nd})(['’‘.,;])(\p{Nd})"):
    _escaped = _rule.replace("'", "''")
    for _ in range(2):
        _MARKED = rf"regexp_replace({_MARKED}, '{_escaped}', '\1\2{_MARK}\3', 'g')"
_LETTERS = r"(?:[\p{L}\p{N}_]\p{M}*)+"
ENGLISH = rf"""list_transform(list_filter(
        regexp_extract_all({_MARKED}, '{_LETTERS}(?:[^\p{{L}}\p{{N}}_\s]{_MARK}{_LETTERS})*'),
        lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]')), lambda t: regexp_replace(replace(t, '{_MARK}', ''), '[''’＇]s$', ''))"""

WHITE = r"regexp_extract_all({}, '\S+')"


def analysed(source: str, name: str, key: str) -> str:
    """CTE ``name (key, contents)``: English analysis of a table with the same columns, stems joined by blanks."""
    return f"""{name}_cut AS (SELECT {key}, list_filter({ENGLISH}, lambda t: NOT list_contains({STOP}, t)) AS tokens FROM {source}),
        {name}_places AS (SELECT {key}, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM {name}_cut),
        {name}_joined AS (SELECT {key}, string_agg(stem, ' ' ORDER BY place) AS contents FROM {name}_places JOIN stems USING (word) GROUP BY {key}),
        {name} AS (SELECT r.{key}, coalesce(j.contents, '') AS contents FROM {source} r LEFT JOIN {name}_joined j USING ({key}))"""


_RAW = """raw_docs AS (SELECT doc_id::VARCHAR AS id, text AS contents FROM documents),
        raw_topics AS (SELECT item_id::VARCHAR AS qid, text AS contents FROM benchmark)"""
_RAW_WORDS = f"""words AS (SELECT DISTINCT unnest({ENGLISH}) AS word FROM (SELECT contents FROM raw_docs UNION ALL SELECT contents FROM raw_topics))"""
#: Documents and topics after English analysis.
STEMMED = f"""{_RAW}, {_RAW_WORDS}, {stems('words')}, {analysed('raw_docs', 'docs', 'id')}, {analysed('raw_topics', 'topics', 'qid')}"""
_AGAIN = stems("twice_words")
for _name in re.findall(r"(\w+) AS \(", _AGAIN):
    _AGAIN = re.sub(rf"\b{_name}\b", f"again_{_name}", _AGAIN)

ENGLISH_TS_RANK = f"""{index_ctes(WHITE, docs=STEMMED)},
    qwords AS (SELECT DISTINCT qid, unnest({WHITE.format('contents')}) AS term FROM topics),
    qsize AS (SELECT qid, count(*) AS terms FROM qwords GROUP BY qid),
    ts AS (SELECT q.qid, p.id, sum(0.1 / 1.64493406685 * list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0::DOUBLE / (j * j))))
            / any_value(z.terms) / log2(any_value(d.len) + 1) AS score
        FROM qwords q JOIN postings p USING (term) JOIN qsize z ON z.qid = q.qid JOIN doclens d ON d.id = p.id GROUP BY q.qid, p.id)"""

#: Stored contents are stems already; the index folds and stems them, and the ids, once more.
TWICE_STEMMED = f"""{STEMMED},
    pieces AS (SELECT id, NULL AS qid, list_concat({FOLDED.format('id')}, {FOLDED.format('contents')}) AS tokens FROM docs
        UNION ALL SELECT NULL, qid, {FOLDED.format('contents')} FROM topics),
    spots AS (SELECT id, qid, unnest(tokens) AS word FROM pieces),
    twice_words AS (SELECT DISTINCT word FROM spots), {_AGAIN},
    stemmed AS (SELECT id, qid, stem AS term FROM spots JOIN again_stems USING (word)),
    postings AS (SELECT id, term, count(*) AS tf FROM stemmed WHERE id IS NOT NULL GROUP BY id, term),
    vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    doclens AS (SELECT id, len(tokens) AS len FROM pieces WHERE id IS NOT NULL),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM doclens),
    qcounts AS (SELECT qid, term, count(*) AS qtf FROM stemmed WHERE qid IS NOT NULL GROUP BY qid, term),
    twice AS (SELECT q.qid, p.id, sum(q.qtf
            * CASE WHEN s.n - v.df + 0.5 <= v.df + 0.5 THEN 1e-6 ELSE ln((s.n - v.df + 0.5) / (v.df + 0.5)) END
            * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.len / s.avgdl))) AS score
        FROM qcounts q JOIN postings p USING (term) JOIN vocab v USING (term) JOIN doclens d ON d.id = p.id, stats s GROUP BY q.qid, p.id)"""

ORACLES: dict[str, str] = {
    "load_sparse": f"SELECT doc_id::VARCHAR AS id, array_to_string({PLAIN.format('text')}, ' ') AS contents FROM documents",
    "load_dense": """SELECT vec_id::VARCHAR AS id, len(embedding) AS dim,
        round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
        round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings""",
    "num_rows": "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS num_rows",
    "choose_text": """SELECT doc_id::VARCHAR AS id, CASE lang WHEN 'en' THEN source || ' ' || text WHEN 'fr' THEN text
        ELSE lang || ' ' || text || ' ' || n_chars END AS contents FROM documents""",
    "parse_tsv": rf"""WITH {TURNS} SELECT id, role || ' ' || regexp_replace(text, '\s+', ' ', 'g') AS contents FROM turns""",
    "tokenize": f"WITH {TURNS} SELECT id, array_to_string({PLAIN.format('text')}, ' ') AS contents FROM turns",
    "stopwords": f"""WITH kept AS (SELECT doc_id::VARCHAR AS id,
        list_filter({PLAIN.format('text')}, lambda t: NOT list_contains({STOP}, t)) AS tokens FROM documents)
        SELECT id, len(tokens) AS kept, array_to_string(tokens, ' ') AS contents FROM kept""",
    "porter_stem": f"""WITH words AS (SELECT DISTINCT unnest({PLAIN.format('text')}) AS word FROM documents), {stems('words')}
        SELECT word, stem FROM stems""",
    "tokenize_english": f"""WITH {DOCS}, cut AS (SELECT id, list_filter({ENGLISH}, lambda t: NOT list_contains({STOP}, t)) AS tokens FROM docs),
        places AS (SELECT id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM cut),
        words AS (SELECT DISTINCT word FROM places), {stems('words')},
        joined AS (SELECT id, string_agg(stem, ' ' ORDER BY place) AS contents FROM places JOIN stems USING (word) GROUP BY id)
        SELECT d.id, coalesce(j.contents, '') AS contents FROM docs d LEFT JOIN joined j USING (id)""",
    "clean_query": rf"""WITH {TURNS} SELECT id, array_to_string(
        regexp_extract_all(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\S+'), ' | ') AS cleaned FROM turns""",
    "natural_order": r"""WITH ids AS (SELECT source || '-' || doc_id AS qid FROM documents),
        runs AS (SELECT qid, list_transform(regexp_extract_all(qid, '\d+|\D+'), lambda x: CASE
            WHEN regexp_matches(x, '^\d') THEN lpad(len(x::HUGEINT::VARCHAR)::VARCHAR, 6, '0') || x::HUGEINT::VARCHAR
            ELSE x END) AS key FROM ids)
        SELECT qid, array_to_string(key, ' ') AS key FROM runs ORDER BY key""",
    "postings": f"""WITH {index_ctes(PLAIN)} SELECT p.id, p.term, p.tf, d.len
        FROM postings p JOIN doclens d ON d.id = p.id""",
    "doc_lengths": f"WITH {index_ctes(PLAIN)} SELECT id, len FROM doclens",
    "doc_freq": f"WITH {index_ctes(PLAIN)} SELECT term, df FROM vocab",
    "corpus_stats": f"WITH {index_ctes(PLAIN)} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM stats",
    "match_any": f"""WITH {index_ctes(PLAIN)}, {QUERY_TERMS}
        SELECT q.qid, count(DISTINCT p.id) AS matches FROM qterms q JOIN postings p USING (term) GROUP BY q.qid""",
    "bm25_topk": f"WITH {BM25} {top('bm25', 10)}",
    "bm25_deep": f"WITH {BM25} {top('bm25', 1500)}",
    "bm25_pruned": f"WITH {BM25} {top('bm25', 10)}",
    "bm25_padded": f"WITH {BM25_PADDED} {top('padded', 1000)}",
    "bm25_padded_classic": f"WITH {bm25(classic=True)}, {PADDED} {top('padded', 1000)}",
    "bm25_padded_by_group": f"WITH {BM25_BY_GROUP}, {PADDED_BY_GROUP} {top('padded', 1500, 'lang, qid')}",
    "index_reopened": f"WITH {BM25} {top('bm25', 10)}",
    "index_extended": f"WITH {bm25(docs=MORE_DOCS)} {top('bm25', 10)}",
    "index_followed": f"WITH {bm25(docs=MORE_DOCS)} {without_self(top('bm25', 10))}",
    "index_whitespace": f"WITH {BM25} {without_self(top('bm25', 10))}",
    "bm25_by_group": f"WITH {BM25_BY_GROUP} {top('bm25', 10, 'lang, qid')}",
    "phrase_match": rf"""WITH {index_ctes(PLAIN)}, {TOPICS},
        clauses AS (SELECT unnest(string_split_regex(contents, '[.,\n]+')) AS clause FROM topics),
        phrases AS (SELECT DISTINCT {PLAIN.format('clause')} AS phrase FROM clauses),
        parts AS (SELECT phrase, unnest(phrase) AS term, generate_subscripts(phrase, 1) AS at
            FROM phrases WHERE len(phrase) > 1),
        places AS (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS at FROM doc_tokens),
        starts AS (SELECT q.phrase, p.id, p.at - q.at AS start FROM parts q JOIN places p USING (term)
            GROUP BY q.phrase, p.id, p.at - q.at HAVING count(*) = len(q.phrase))
        SELECT array_to_string(s.phrase, ' ') AS phrase, s.id, count(*) AS tf, any_value(d.len) AS len
        FROM starts s JOIN doclens d ON d.id = s.id GROUP BY s.phrase, s.id""",
    "bm25_fts5": f"WITH {fts5()} {top('fts5', 10)}",
    "fts5_phrases": f"WITH {fts5(DOTTED)} {top('fts5', 10)}",
    "fts5_by_group": f"WITH {fts5(DOTTED, 'lang, ')} {top('fts5', 10, 'lang, qid')}",
    "ts_rank_by_group": f"WITH {ts_rank(0, 'lang, ')} {top('ts', 10, 'lang, qid')}",
    "search_by_group": f"WITH {BM25_BY_GROUP} {without_self(top('bm25', 10, 'lang, qid'), 'lang, qid')}",
    "dense_by_group": f"""WITH {DOCS}, {TOPICS}, {COSINE_BY_GROUP}
        {without_self(top('cosine', 10, 'lang, qid'), 'lang, qid')}""",
    "hybrid_by_group": f"""WITH {BM25_BY_GROUP}, {PADDED_BY_GROUP}, {COSINE_BY_GROUP},
        {fused('padded', 10, 'row_number', 'lang, qid')}
        {without_self(ranked('fused', 10, 'lang, qid', None), 'lang, qid')}""",
    "ts_rank_topk": f"WITH {ts_rank(0)} {top('ts', 10)}",
    "ts_rank_norm": f"WITH {ts_rank(1)} {top('ts', 10)}",
    "ts_rank_english": f"WITH {ENGLISH_TS_RANK} {top('ts', 10)}",
    "index_fts5": f"WITH {TWICE_STEMMED} {without_self(top('twice', 10))}",
    "search_sparse": f"WITH {BM25} {without_self(top('bm25', 10))}",
    "dense_topk": f"WITH {COSINE} {top('cosine', 10)}",
    "dense_grouped": f"WITH {COSINE} {top('cosine', 10)}",
    "self_filter": f"WITH {COSINE} {without_self(top('cosine', 10))}",
    "rrf_row_number": f"""WITH {BM25_PADDED}, {COSINE_TAIL}, {fused('padded', 1000, 'row_number')}
        {ranked('fused', 1000, digits=None)}""",
    "rrf_rank": f"WITH {ts_rank(0)}, {COSINE_TAIL}, {fused('ts', 1000, 'rank')} {ranked('fused', 1000, digits=None)}",
    "search_hybrid": f"""WITH {BM25_PADDED}, {COSINE_TAIL}, {fused('padded', 10, 'row_number')}
        {without_self(ranked('fused', 10, digits=None))}""",
    "combine_topics": f"""WITH {TOPICS}, {VECTORS}, {FULL_TOPICS} SELECT qid, contents, len(vector) AS dim,
        round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm FROM full_topics""",
    "trec_run": f"""WITH {BM25}, hits AS ({ranked('bm25', 10)})
        SELECT qid || ' Q0 ' || id || ' ' || rank || ' ' || printf('%.6f', score) || ' sparse_bm25' AS line FROM hits""",
    "judgements": f"WITH {index_ctes(PLAIN)}, {TOPICS}, {judged()} SELECT qid, id, rel FROM judged",
    "ndcg_at_10": f"WITH {SPARSE_RUN} SELECT qid, round(ndcg, 6) AS ndcg FROM scores",
    "run_roundtrip": f"WITH {run_and_judgements(ranked('bm25', 10))} SELECT qid, round(ndcg, 6) AS ndcg FROM scores",
    "ndcg_mean": f"WITH {SPARSE_RUN} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg FROM scores",
    "ndcg_by_group": f"""WITH {BM25_BY_GROUP}, {judged('lang, ')},
        run AS ({ranked('bm25', 10, 'lang, qid')}),
        qrels AS (SELECT j.lang, j.qid, j.id, j.rel + coalesce(l.quality, 0) AS rel
            FROM judged j LEFT JOIN labels l ON l.doc_id::VARCHAR = j.id),
        {ndcg('lang, ')}
        SELECT lang, count(*) AS queries, round(avg(ndcg), 6) AS ndcg FROM scores GROUP BY lang""",
    "read_folder": rf"""WITH {TURNS} SELECT doc_id::VARCHAR AS id, source || ' ' || text AS contents FROM documents
        UNION ALL SELECT id, regexp_replace(role || ' ' || regexp_replace(text, '\s+', ' ', 'g'), '\s+$', '') FROM turns""",
    "read_parsed": f"SELECT doc_id::VARCHAR AS id, array_to_string({PLAIN.format('text')}, ' ') AS contents FROM documents",
    "read_dense_jsonl": """SELECT vec_id::VARCHAR AS id, len(embedding) AS dim,
        round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings""",
    "eight_decimals": """SELECT vec_id::VARCHAR AS id, printf('%.8f', embedding[1]::DOUBLE) AS first,
        printf('%.8f', embedding[-1]::DOUBLE) AS last FROM embeddings""",
    "table_appended": f"""WITH {TURNS} SELECT doc_id::VARCHAR AS id, length(text) AS chars FROM documents
        UNION ALL SELECT id, length(text) FROM turns""",
    "table_followed": f"""WITH {TURNS} SELECT doc_id::VARCHAR AS id, length(text) AS chars FROM documents
        UNION ALL SELECT id, length(text) FROM turns""",
    "nul_replaced": "SELECT doc_id::VARCHAR AS id, lang || chr(65533) || text AS contents FROM documents",
    "read_topics": f"""WITH {TOPICS}, {VECTORS}, {FULL_TOPICS} SELECT qid, contents, len(vector) AS dim,
        round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm FROM full_topics""",
}
