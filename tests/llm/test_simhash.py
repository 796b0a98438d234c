import random
import re

import numpy as np
import pytest
import xxhash

from echoset.llm import simhash
from echoset.llm.simhash import fingerprint_texts, near_pairs, simhash_dedup, simhash_groups

from .fixtures import awkward_rows, docs_frame, union_find


def brute_fingerprint(text, k=3, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_equal_brute_force(spark):
    rows = awkward_rows()
    got = simhash_groups(docs_frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = union_find(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = [(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("radius,segments,tile_rows", [(2, 4, 4096), (2, 4, 3), (3, 2, 50), (1, 8, 7), (0, 4, 5)])
def test_all_pairs_within_radius(spark, radius, segments, tile_rows):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    words = set(base)
    for w in base:  # dense balls around some words: chains and crowded tiles
        for _ in range(6):
            x = w
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            words.add(x)
    words = sorted(words)
    signed = np.array(words, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = [frozenset((r["a"], r["b"])) for r in near_pairs(df, radius, segments, tile_rows).collect()]
    want = {
        frozenset((signed[i], signed[j])) for i in range(len(words)) for j in range(i)
        if (words[i] ^ words[j]).bit_count() <= radius}
    assert set(got) == want and len(got) == len(want)  # each pair once


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert simhash_groups(empty).collect() == []
    assert simhash_dedup(empty).collect() == []


def test_dedup_keeps_one_of_each_group(spark):
    rows = awkward_rows()
    docs = docs_frame(spark, rows)
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    groups = simhash_groups(docs).collect()
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in groups if r["component_id"] is not None})


def test_nameless_rows_stay_once_a_text(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (1, "other words here now"), (None, "other words here now")]
    kept = [(r["doc_id"], r["text"]) for r in simhash_dedup(docs_frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, "alpha beta gamma delta"), (1, "other words here now")], key=str)


def test_every_group_keeps_its_first_row(spark):
    a, b = "alpha beta gamma delta epsilon", "quite other words stand here today"
    rows = [(3, a), (5, a), (5, b), (7, a), (7, a), (9, b)]
    for parts in (1, 3):
        for order in (rows, rows[::-1]):
            kept = simhash_dedup(docs_frame(spark, order).repartition(parts)).collect()
            assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, a), (5, b)]
    kept = simhash_dedup(docs_frame(spark, [(5, a), (5, b), (5, a)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(5, a), (5, b)]


@pytest.mark.parametrize("piece,flush", [(1, 1), (5, 2), (64, 7), (1000, 100)])
def test_long_texts_are_folded_in_pieces(monkeypatch, piece, flush):
    rng = random.Random(piece)
    words = ["a", "B", "naïve", "x" * 40, "😀", "the"]
    texts = [rng.choice(["", " ", "\n\t"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\x0b "]) for _ in range(n))[:rng.choice([-1, 10**6])]
             for n in (0, 1, 2, 3, 4, 5, 30, 300) for _ in range(4)] + ["", " " * 50, "x" * 500, "one two", "one two three"]
    for k in (1, 2, 3, 5):
        want = fingerprint_texts(texts, k, 42)
        assert want.tolist() == [brute_fingerprint(t, k) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(simhash, "PIECE", piece)
            m.setattr(simhash, "FLUSH", flush)
            assert fingerprint_texts(texts, k, 42).tolist() == want.tolist()


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    text = "a bc def " * 300_000  # 2.7 MB of short words
    tracemalloc.start()
    fingerprint_texts([text], 3, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
