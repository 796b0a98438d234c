import hashlib
import re

from echoset.llm.secret_scan import find_spans, scan_secrets, secret_digest

from .fixtures import awkward_rows, docs_frame

KEY = "AKIA" + "Q7" * 8
HEXA = "0123456789abcdef" * 2
OPAQUE = "wJalrXUtnFEMI7K7MDENG8bPxRfiCYEXAMPLEKEYx"
TEXTS = [
    f"login {KEY} and password=hunter22 or TOKEN = \"{HEXA}\" é {HEXA}",
    "token: abc secret=token:abcdef passwd='x' Api_Key := zzzzzz api-key=123456 ſecret=aaaaaaa",
    "AKIA123 AKIAAKIA" + "A" * 12 + " " + "a" * 23 + " " + "a" * 24 + "g" + "f" * 30,
    f"endpoint https://db.example.com/x near password: s3cretvalue {OPAQUE}",
    f"a lone endpoint https://db.example.com/x and user=alice {'pad ' * 100} password=abcdef1",
    f"only {OPAQUE} here", f"user: alice {OPAQUE}", "password=" + "x" * 5 + " 😀😀 password=" + "y" * 400,
    f"{HEXA} " * 500 + "user=bob",
]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    a = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    b = [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    h = [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(a + b + h))
    return len(a), len(b), len(h), hashlib.sha256(joined.encode()).hexdigest()


def linked(text, reach=200):
    """Weak spans that have a complementary part within reach, by comparing all pairs."""
    role = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
    spans = find_spans(text)
    return {
        w for w in spans if w[0] in ("account", "endpoint", "opaque") and any(
            (role[o[0]] == "secret") != (role[w[0]] == "secret") and o[1] <= w[2] + reach and o[2] >= w[1] - reach for o in spans)}


def test_base_spans_and_links_equal_brute_force(spark):
    rows = awkward_rows() + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    got = {}
    for r in secret_digest(scan_secrets(docs_frame(spark, rows))).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in rows:
        weak = {f"{k}:{s}:{e}" for k, s, e in linked(t)}
        mine = [g for g in got[i] if g[:4] == base(t)]
        assert mine, i
        spans = mine[0][4].split(",") if mine[0][4] else []
        assert {s for s in spans if s.split(":")[0] in ("account", "endpoint", "opaque")} == weak
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert sum(map(len, got.values())) == len(rows)


def test_weak_parts_need_their_complement(spark):
    spans = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in scan_secrets(docs_frame(spark, list(enumerate(TEXTS)))).collect()}
    assert {"endpoint", "opaque", "assign"} <= spans[3]
    assert "endpoint" not in spans[4] and "account" not in spans[4]  # too far from the password
    assert spans[5] == set() and {"account", "opaque"} <= spans[6]


def test_empty_table(spark):
    assert scan_secrets(docs_frame(spark, [])).collect() == []
