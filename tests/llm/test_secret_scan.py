import hashlib
import random
import re
import string

import pytest
from trawl.llm import secret_scan
from trawl.llm.queries import op13_secret_scan
from trawl.llm.secret_scan import compressor_of, dictionary_of, frequent_identifiers, novelty, secrets

# The definition's own patterns, every failing match dropped after the search.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
]


def by_hand(text):
    found = []
    for nth, (kind, pattern, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), nth, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base_of(row):
    return [(s.kind, s.start, s.stop) for s in row.spans if s.kind != "novel"]


def test_given_table(spark, sf_dir, texts):
    for row in op13_secret_scan(spark, sf_dir).collect():
        want = by_hand(texts[row.doc_id])
        listed = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w[0] == kind for w in want) for kind, _, _ in BASE)
        assert [s for s in row.spans.split(",") if s and not s.startswith("novel")] == [s for s in listed.split(",") if s]


def test_random_strings_around_the_base_patterns(spark):
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", "api__key", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA",
             "A1B2C3D4E5F6G7H8", "akia", "0123456789abcdef", "01234567", "ſecret", "toKen", "K", "é", "\U0001f600", "\n", "\t", ".", "-"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: base_of(r) for r in secrets(df, identifiers=[]).collect()}
    assert found == {i: by_hand(text) for i, text in rows} and sum(map(len, found.values())) > 500


def test_odd_rows(odd_docs, no_docs):
    found = secrets(odd_docs)
    assert sorted((base_of(r) for r in found.collect()), key=repr) == sorted((by_hand(r.text) for r in odd_docs.collect()), key=repr)
    assert secrets(no_docs).collect() == [] and frequent_identifiers(no_docs) == []


CODE = '''
class Handler(BaseHandler):
    def get(self, request):
        user = self.authenticate(request)
        return Response(json.dumps({"user": user.name, "roles": [role.name for role in user.roles]}))
%s
        session = requests.Session()
        return session.get(f"https://{host}:{port}/v1/status", timeout=DEFAULT_TIMEOUT)
'''
KEYS = {
    "letters": string.ascii_letters + string.digits, "hex": "0123456789ABCDEF", "base64": string.ascii_letters + string.digits + "+/",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("size", [20, 32, 64])
def test_random_keys_are_reported(kind, size):
    rng, compressor, found = random.Random(size), compressor_of(dictionary_of([])), 0
    for _ in range(200):
        key = "".join(rng.choice(KEYS[kind]) for _ in range(size))
        text = CODE % f'        headers["authorization"] = "Bearer {key}"'
        base = secret_scan.base_spans(text)
        spans = secret_scan.novel_spans(text, base, compressor, secret_scan.LEAST_NOVELTY)
        start = text.index(key)
        found += (start, start + size) in spans or any(a < start + size and start < b for a, _, b in base)
    assert found >= 196


def test_names_and_places_without_a_sensitive_word_are_not(spark):
    rng, compressor = random.Random(2), compressor_of(dictionary_of([]))
    reported = 0
    for _ in range(300):
        words = [rng.choice(secret_scan.IDENTIFIERS) for _ in range(rng.randrange(3, 6))]
        name = rng.choice(["_".join(words), "/".join(words), words[0] + "".join(w.capitalize() for w in words[1:])]) + "2"
        reported += bool(secret_scan.novel_spans(CODE % f"        auth({name})", [], compressor, secret_scan.LEAST_NOVELTY))
    assert reported <= 30
    key = "Zk3vQ9xW7mB2nR5tY8uP1"
    for line in (f"value {key}", f"auth\nvalue {key}", "auth " + "x y " * 20 + key):
        assert not secret_scan.novel_spans(CODE % line, [], compressor, secret_scan.LEAST_NOVELTY)
    assert secret_scan.novel_spans(CODE % f"auth {key}", [], compressor, secret_scan.LEAST_NOVELTY)


def test_a_repeated_key_is_novel_at_each_place(spark):
    key = "Zk3vQ9xW7mB2nR5tY8uP1"
    df = spark.createDataFrame([(1, f"auth {key}\nauth {key}\n")], "doc_id long, text string")
    spans = secrets(df).first().spans
    assert [(s.kind, s.start) for s in spans] == [("novel", 5), ("novel", 32)] and all(s.novelty > 0.8 for s in spans)


def test_no_span_of_the_method_touches_a_base_span(spark):
    key = "Zk3vQ9xW7mB2nR5tY8uP1"
    df = spark.createDataFrame([(1, f"auth token = {key} bearer Qp8sD2fG6hJ4kL1zX3cV5")], "doc_id long, text string")
    assert [(s.kind, s.start, s.stop) for s in secrets(df).first().spans] == [("assign", 5, 34), ("novel", 42, 63)]


def test_frequent_identifiers_are_exact(spark, documents):
    word = re.compile(secret_scan.WORD)
    counts: dict[str, int] = {}
    for row in documents.collect():
        for found in set(word.findall(row.text or "")):
            counts[found] = counts.get(found, 0) + 1
    total = sum(counts.values())
    want = sorted((n, w) for w, n in counts.items() if n >= 0.001 * total)
    assert frequent_identifiers(documents.repartition(7)) == [w for _, w in want] and want


def test_known_words_cost_less():
    text = CODE % "        auth(Zanzibarism9Quokkaberry)"
    start, stop = text.index("Zanz"), text.index("berry") + 5
    plain = novelty(compressor_of(dictionary_of([])), text, start, stop)
    assert novelty(compressor_of(dictionary_of(["Zanzibarism", "Quokkaberry"])), text, start, stop) < plain - 0.3
