import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echoset.llm import collocations as C
from echoset.llm.collocations import collocations, phrase_counts

from .fixtures import awkward_rows, docs_frame

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_counts(rows):
    f = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(" ".join(words[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    return f


def brute(rows, min_count, top, cover=80):
    out = []
    for lang, f in brute_counts(rows).items():
        n = sum(c for p, c in f.items() if " " not in p)
        found = {p: c for p, c in f.items() if " " in p and c >= min_count}
        best = []
        for p, a in found.items():
            w = p.split(" ")
            if any(100 * b >= cover * a for q, b in found.items() if q.count(" ") > p.count(" ") and f" {p} " in f" {q} "):
                continue
            score, k, left, right = min(
                (2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            best.append((-score, -a, p.encode(), p, left, right))
        out += [(lang, i, p, -a, left, right, n, -s) for i, (s, a, _, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["new", "york", "city", "hall", "of", "the", "Straße", "x\x01", "x", "x\x02y", "é", "naïve", "a" * 30, "\x0e"]
    fixed = ["New York city hall", "of the", "x x x x x", "the\t \tnew", "naïve é x\x01 x"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t"]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", "z z"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, n bigint, rank string")


@pytest.mark.parametrize("size,parts,min_count,top", [(1 << 22, None, 5, 2000), (40, 7, 3, 10), (300, 40, 1, 50)])
def test_equal_brute_force(spark, monkeypatch, size, parts, min_count, top):
    rows = texts(size)
    ranges = C._sampled_bounds(frame(spark, rows).selectExpr("text", "coalesce(lang, 'und') AS lang").where("text IS NOT NULL"), parts)
    assert parts is None or 1 <= len(ranges) < parts
    got = collocations(frame(spark, rows).repartition(3), min_count=min_count, top=top, parts=parts)
    assert found(got) == brute(rows, min_count, top)


@pytest.mark.parametrize("limit", [1, 40, 300, 1 << 22])
def test_windows_of_any_parts(limit):
    for text, _ in texts(limit, 30):
        data = np.frombuffer(text.encode(), np.uint8)
        got, seen = Counter(), 0
        for lo, hi, end in C._parts(data, limit):
            windows, words = C.windows_of(data[lo:end], hi - lo)
            held = [b"", *words.to_pylist()]
            assert held == sorted(set(held))
            got.update(tuple(held[r] for r in w) for w in windows.tolist())
            assert lo == seen
            seen = hi
        want = Counter()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want.update(tuple([*w[i:i + 4], b"", b"", b""][:4]) for i in range(len(w)))
        assert got == want and seen == len(data)


@pytest.mark.parametrize("top", [3, 1 << 16, 1 << 31])
def test_sorted_counts_packed_or_not(top):
    rng = np.random.default_rng(top)
    windows = rng.choice(np.array([0, 1, 2, top - 1, top], np.uint64), (500, 4))
    counts = rng.integers(1, 9, 500)
    for c in (None, counts):
        got, sums = C._sorted_counts(windows, c)
        want = Counter()
        for w, x in zip(windows.tolist(), counts.tolist() if c is not None else [1] * 500):
            want[tuple(w)] += x
        assert [tuple(w) for w in got.tolist()] == sorted(want) and sums.tolist() == [want[w] for w in sorted(want)]


def test_bounds_part_the_sorted_windows():
    data = np.frombuffer(b"b c d. b c. b d, a a a a", np.uint8)
    windows, words = C.windows_of(data, len(data))
    windows, _ = C._sorted_counts(windows, None)
    held = [b"", *words.to_pylist()]
    rows = [tuple(held[r] for r in w) for w in windows.tolist()]
    bounds = [(b"", b"", b"", b""), (b"a", b"b", b"", b""), (b"b", b"", b"", b""), (b"b", b"c", b"cc", b"z"), (b"bb", b"a", b"", b""), (b"zz", b"", b"", b"")]
    assert C._bound_places(windows, words, bounds) == [sum(r < b for r in rows) for b in bounds]


def test_block_round_trip():
    data = np.frombuffer(b"one two three four five one two. three four", np.uint8)
    windows, words = C.windows_of(data, len(data))
    windows, counts = C._sorted_counts(windows, None)
    f = C._phrases("en", [C._block(windows[:4], counts[:4], words), C._block(windows[4:], counts[4:], words)], 1)
    got = {p: n for p, n in zip(f["phrase"], f["f"]) if p}
    assert got == dict(brute_counts([("one two three four five one two. three four", "en")])["en"])
    assert C._dictionary(pa.array([], pa.large_binary()))[0].tolist() == []


def test_counts_go_on_over_ranges(spark):
    """One word opens most windows, so its runs lie in many ranges."""
    rng = random.Random(1)
    rows = [(" ".join(x for _ in range(40) for x in ("the", rng.choice("abcdefgh") + rng.choice("xyz"))), "en") for _ in range(30)]
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrase_counts(frame(spark, rows), min_count=20, parts=12).collect() if r["size"]}
    assert got == {("en", p): c for p, c in brute_counts(rows)["en"].items() if c >= 20} and got[("en", "the")] == 1200


def test_awkward_rows_and_empty(spark):
    rows = awkward_rows()
    df = docs_frame(spark, rows)
    pairs = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    assert found(collocations(df, min_count=4)) == brute(pairs, 4, 2000)
    assert collocations(docs_frame(spark, [])).collect() == []
    assert collocations(docs_frame(spark, [(1, None), (2, ""), (3, " \t."), (4, "one")])).collect() == []
