"""Secret scan against the patterns themselves, run by ``re``."""

import hashlib
import random
import re
import time

import pytest

from specmill.llm import automaton, q_secrets, secrets

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
BITS = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", ":", "=", " ", "  ", "'", '"', "AKIA", "abcdef0123", "ABCDEF9", "xyz", "é", "\n", "-", "_", ".",
        "ſecret", "0123456789abcdef", "K", "ghp_", "eyJ", "://", "@", "漢"]


def brute(text):
    found = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_as_by_re():
    rnd = random.Random(4)
    for _ in range(8_000):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 14)))
        assert [s for s in secrets.find_spans(text) if s[0] in PATTERNS] == brute(text), text


def test_further_kinds():
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "Ab1" * 12 + " http://bob:hunter2@host xoxb-123456789012-abc eyJhbGciOiJI.eyJzdWIiOiIx.sflKxwRJSMeK"
    assert [text[a:b][:12] for k, a, b in secrets.find_spans(text) if k not in PATTERNS] == ["-----BEGIN R", "ghp_Ab1Ab1Ab", "://bob:hunte", "xoxb-1234567", "eyJhbGciOiJI"]


def test_automaton_is_minimal_and_exact():
    dfa = automaton.compile_rules([("a(b|c)*d", False), ("x{2,3}", True)], anywhere=False)
    data = b"abcbd".translate(dfa.classes)
    assert dfa.longest(data, 0, 5) == 5
    assert dfa.longest(b"xXx".translate(dfa.classes), 0, 3) == 3
    assert dfa.longest(b"xy".translate(dfa.classes), 0, 2) == -1
    assert automaton.compile_rules([("ab|cb", False)]).states == automaton.compile_rules([("[ac]b", False)]).states == 3


def test_mask():
    text = "key: token=abcdef0123456789 end"
    assert secrets._masked(text, secrets.find_spans(text)) == "key: <assign> end"
    assert secrets._masked(None, []) is None


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q_secrets.op1_secret_scan(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in spans) for x in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert sum(r["n_assign"] + r["n_access"] for r in rows) > 0


@pytest.mark.parametrize("make", [lambda n: "eyJ" * n + " " + "a0" * 20, lambda n: "://" + "a" * 3 * n + " " + "a0" * 20, lambda n: "token" * (n // 2) + ("a0" * 20), lambda n: "eyJa.b" * (n // 2) + ".c " + "f" * 30,
                                  lambda n: "://a:b" * (n // 2), lambda n: "AKIA" * n])
def test_time_grows_with_the_text(make):
    def seconds(text):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            secrets.find_spans(text)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(make(24_000)) < 5 * seconds(make(8_000)) + 0.02


def test_states_that_failed_are_remembered_only_where_they_failed():
    rnd = random.Random(11)
    rules = (secrets.Rule("x", r"ab[ab]+c"), secrets.Rule("y", r"a[ab]+ca"))
    for _ in range(300):
        text = "".join(rnd.choice("aaabbbc") for _ in range(rnd.randrange(90)))
        expected = sorted((m.start(), n, m.end()) for n, p in enumerate((r"ab[ab]+c", r"a[ab]+ca")) for m in re.finditer(p, text))
        assert secrets.find_spans(text, rules) == [("xy"[n], a, b) for a, n, b in expected]
