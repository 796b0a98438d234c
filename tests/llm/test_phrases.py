import hashlib
import random

import numpy as np
import pytest

from echoset.llm import phrases
from echoset.llm.phrases import edited_fingerprints, fingerprint_string, fingerprints, likeness, parse, sketch_texts
from echoset.llm.words import mix

from .fixtures import awkward_rows, docs_frame, prose

Q, M64 = 0xD6E8FEB86659FD93, (1 << 64) - 1


def mixed(x):
    return int(mix(np.array([x & M64], np.uint64))[0])


def toss(before, sym):
    low = (before ^ sym) & -(before ^ sym)
    at = low.bit_length() - 1
    return 2 * at + (sym >> at & 1)


def brute_level(symbols):
    """Phrases of a list of symbols, one symbol after another: (names, symbols of each)."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    seq = [s if n == 1 else mixed(s * Q + n) for s, n in runs]
    labels = [toss(~s & M64 if i == 0 else seq[i - 1], s) for i, s in enumerate(seq)]
    for _ in range(3):
        labels = [toss(x ^ 1 if i == 0 else labels[i - 1], x) for i, x in enumerate(labels)]
    assert max(labels) < 6
    for high in (5, 4, 3):
        labels = [
            min({0, 1, 2} - set(labels[max(0, i - 1):i] + labels[i + 1:i + 2])) if x == high else x for i, x in enumerate(labels)]
    assert all(a != b for a, b in zip(labels, labels[1:]))
    starts = [0] + [i for i in range(2, len(seq) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(seq)]):
        assert b - a <= 5
        h = 0
        for s in seq[a:b]:
            h = (h * Q + s) & M64
        out.append((mixed(h * Q + b - a), seq[a:b]))
    return out


def brute_phrases(text):
    """(level, name) of every phrase."""
    seq, level, out = [ord(c) for c in text], 0, []
    while seq:
        found = brute_level(seq)
        if level and len(found) == 1 and len(found[0][1]) == 1:
            break
        out += [(level, name) for name, _ in found]
        seq, level = [name for name, _ in found], level + 1
    return out


def parsed(texts):
    got = [[] for _ in texts]
    parse(phrases._blocks(texts), lambda k, names, docs: [got[d].append((k, n)) for n, d in zip(names.tolist(), docs.tolist())])
    return got


def sample_texts():
    rng = random.Random(4)
    some = [prose(rng, rng.randint(1, 80)) for _ in range(25)]
    return some + ["", "x", "xy", "xx", "x" * 1000, "ab" * 300, "a", "naïve 😀 mixed　space", "aab" * 50, "\ud800x" * 9, some[0]]


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_phrases_equal_brute_force_in_any_blocks(monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    texts = sample_texts()
    for text, got in zip(texts, parsed(texts)):
        assert sorted(got) == sorted(brute_phrases(text)), text[:40]


def test_equal_substrings_share_their_inner_phrases():
    rng = random.Random(9)
    shared = prose(rng, 400)
    a, b = prose(rng, 100) + shared, prose(rng, 33) + shared + prose(rng, 50)
    inner = set(brute_phrases(shared))
    x, y = (set(g) for g in parsed([a, b]))
    assert len(inner & x & y) > 0.9 * len(inner)
    one, other = (fingerprint_string(s) for s in sketch_texts([a, b]))
    assert likeness(one, other) > 0.5


def test_long_text_in_bounded_memory(monkeypatch):
    rng = random.Random(3)
    text = prose(rng, 60_000)
    whole = sketch_texts([text])[0]
    held = []
    feed = phrases._Level.feed
    monkeypatch.setattr(phrases, "BLOCK", 1000)
    monkeypatch.setattr(phrases._Level, "feed", lambda self, *a: (feed(self, *a), held.append(len(self.sym)))[0])
    parts = sketch_texts([text])[0]
    assert all((x == y).all() for x, y in zip(whole, parts)) and max(held) < 100


def test_sketch_is_the_least_names():
    for text, (main, short) in zip(sample_texts(), sketch_texts(sample_texts())):
        upper = lambda x: x >> 16
        found = brute_phrases(text)
        want = sorted({upper(n) for k, n in found if k >= phrases.MAIN})[:64]
        assert main.tolist() == want
        if len(want) < phrases.ENOUGH:
            small = {upper(n) for k, n in found if k < phrases.MAIN} | ({upper(mixed(ord(c))) for c in text} if len(text) < phrases.SHORT else set())
            assert short.tolist() == sorted(small)[:16]
        else:
            assert not len(short)


def test_likeness_near_the_true_share():
    rng = random.Random(7)
    for n in (300, 1500):
        a, b = prose(rng, n), prose(rng, n)
        half = a[:len(a) // 2] + b[:len(a) // 2]
        x, y, z = (fingerprint_string(s) for s in sketch_texts([a, half, b]))
        assert likeness(x, x) == 1.0 and likeness(x, z) < 0.2 and 0.3 < likeness(x, y) < 0.75
    empty, other = (fingerprint_string(s) for s in sketch_texts(["", "x"]))
    assert empty == "." and likeness(empty, empty) == 1.0 and likeness(empty, other) == 0.0


def brute_rows(rows):
    """Expected rows but for the order among rows that share an id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        f, g, h = (fingerprint_string(s) for s in sketch_texts([t, edited, u]))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, h)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_next_documents_over_any_partitions(spark, parts):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] != 120] + [(None, "nameless row")]
    random.Random(parts).shuffle(rows)
    df = edited_fingerprints(docs_frame(spark, rows).repartition(5), parts=parts)
    assert df.columns == COLUMNS
    assert sorted([tuple(r) for r in df.collect()], key=str) == brute_rows(rows)


def test_repeated_ids_and_nulls(spark):
    rows = awkward_rows() + [(None, "a"), (None, "b"), (None, None)]
    got = [edited_fingerprints(docs_frame(spark, r).repartition(k), parts=k).collect() for r, k in ((rows, 1), (rows[::-1], 3))]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == len(rows)


def test_empty_table_single_row_and_plain_fingerprints(spark):
    assert edited_fingerprints(docs_frame(spark, [])).collect() == []
    row = edited_fingerprints(docs_frame(spark, [(7, "abcdefghij")])).collect()
    assert len(row) == 1 and row[0]["edited_sha256"] == hashlib.sha256(b"abcdeabcde").hexdigest() and row[0]["near_next"] == 1.0
    rows = awkward_rows()
    got = sorted([tuple(r) for r in fingerprints(docs_frame(spark, rows)).collect()], key=str)
    assert got == sorted([(i, fingerprint_string(sketch_texts([t or ""])[0])) for i, t in rows], key=str)
