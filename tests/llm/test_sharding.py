import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from echoset.llm.sharding import permute, place_of, row_at, shard_rows

from .fixtures import awkward_rows, docs_frame


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000, 4096, 5000])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    p = permute(x, n, key=7)
    assert sorted(p) == list(range(n))
    assert (permute(p, n, key=7, back=True) == x).all()
    shard, slot = place_of(x, n, 7, key=7)
    assert (row_at(shard, slot, n, 7, key=7) == x).all()
    if n >= 1000:
        assert (permute(x, n, key=8) != p).mean() > 0.9  # another key, another order
        assert abs(np.corrcoef(x, p)[0, 1]) < 0.1


def test_shards_are_even_and_slots_gapless(spark):
    rows = awkward_rows()
    got = shard_rows(docs_frame(spark, rows), shards=7).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    count = Counter(r["shard"] for r in got)
    assert len(count) == 7 and max(count.values()) - min(count.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_order_of_input_does_not_matter(spark):
    rows = awkward_rows()
    one = shard_rows(docs_frame(spark, rows), shards=5).collect()
    two = shard_rows(docs_frame(spark, rows[::-1], extra=False).repartition(3), shards=5).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_empty_table(spark):
    assert shard_rows(docs_frame(spark, [])).collect() == []
