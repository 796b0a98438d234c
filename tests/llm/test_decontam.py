import collections
import hashlib
import random
import re

import pytest

from echoset.llm.decontam import contamination, decontaminate

from .fixtures import awkward_rows, docs_frame, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    by = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            by[tuple(w[k:k + size])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in by}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in by:
                    hit.update(range(k, k + size))
                    found |= by[tuple(w[k:k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(12)] + [(20, "short item of five"), (21, "one"), (22, ""), (23, None), (None, prose(rng, 12))]
    items += [(30, items[0][1]), (31, items[0][1]), (31, items[1][1])]  # equal items, a repeated id
    items.append((40, "the the the the the the the the the the the the"))
    docs = awkward_rows()
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        docs.append((200 + k, prose(rng, 30) + ", " + "! ".join(w[k % 5:k % 5 + 8 + k % 6]).upper() + ". " + prose(rng, 9)))
    docs.append((300, "The the the " * 40))
    docs.append((301, items[0][1] + " " + items[0][1]))
    docs.append((302, "a short  item-of FIVE words, one"))
    return docs, items


@pytest.mark.parametrize("bits", [24, 6])
def test_equals_brute_force(spark, bits):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in contamination(docs_frame(spark, docs), bench, filter_bits=bits).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = planted()
    none = spark.createDataFrame([], "item_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert not any(r["contaminated"] for r in contamination(docs_frame(spark, docs), none).collect())
    assert contamination(docs_frame(spark, []), bench).collect() == []


def test_contaminated_rows_go_and_clean_ones_stay(spark):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs_frame(spark, docs)
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns
    clean = [(r[0], t) for r, (_, t) in zip([brute([d], items)[0] for d in docs], docs) if not r[5]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)
