"""Corpus-wide grouping with leaders only, and groups kept up to date."""

import math

import numpy as np
import pytest

from echoset.operators import leaders as L
from echoset.operators.leaders import group_corpus, group_onto

from .test_grouping import cos, walk


def dense(spark, vecs, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vecs)], "pos bigint, vector array<double>")


def groups(df):
    out = {}
    for r in df.collect():
        assert r.a < r.b
        out.setdefault(r.a, [r.a]).append(r.b)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("leaf,hold,tile,edges", [(4, 5, 3, 0), (10, 16, 7, 1), (30, 64, 1024, 64), (1000, 1000, 9, 64), (2, 1000, 1024, 0)])
def test_equal_the_walk_however_it_is_cut(spark, monkeypatch, leaf, hold, tile, edges):
    monkeypatch.setattr(L, "TILE", tile)
    monkeypatch.setattr(L, "EDGES", edges)
    rng = np.random.default_rng(leaf)
    vecs = rng.normal(size=(60, 3))
    vecs[5] = 0.0
    stats = {}
    got = group_corpus(dense(spark, vecs), 0.7, sparse=False, leaf_rows=leaf, hold_rows=hold, stats=stats)
    assert groups(got) == walk(vecs.tolist(), 0.7)
    for r in got.collect():
        assert abs(r.sim - cos(vecs[r.a], vecs[r.b])) < 1e-12


def test_sparse_counts(spark):
    rng = np.random.default_rng(3)
    rows, vecs = [], []
    for i in range(80):
        idx = sorted(rng.choice(12, size=rng.integers(0, 5), replace=False).tolist())
        cnt = rng.integers(1, 4, size=len(idx)).tolist()
        rows.append((i, idx, cnt, int(sum(c * c for c in cnt))))
        v = np.zeros(12)
        v[idx] = cnt
        vecs.append(v.tolist())
    df = spark.createDataFrame(rows, "pos bigint, idx array<int>, cnt array<bigint>, sq bigint")
    for leaf in (9, 500):
        assert groups(group_corpus(df, 0.8, leaf_rows=leaf, hold_rows=20)) == walk(vecs, 0.8)


def test_one_cluster_of_near_copies_writes_rows_linear_in_it(spark, monkeypatch):
    n = 20_000
    written = []
    cut = type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, eager=True: (out := cut(self, eager), written.append(
        out.count() if {"a", "b", "sim"} <= set(out.columns) else 0))[0])
    rows = spark.range(n).selectExpr("id AS pos", "array(1.0D, 0.001D * pmod(xxhash64(id), 100), 0.001D * pmod(id, 7)) AS vector")
    got = group_corpus(rows.repartition(8), 0.9, sparse=False)
    summary = got.groupBy("a").count().collect()
    assert [(r["a"], r["count"]) for r in summary] == [(0, n - 1)]
    assert sum(written) < 4 * n


def test_nan_copies_and_empty(spark):
    assert group_corpus(dense(spark, []), 0.5, sparse=False).collect() == []
    vecs = [[1, 0], [float("nan"), 1], [float("nan"), 1], [0, 0], [0, 0], [2, 0]]
    for leaf in (2, 100):
        assert groups(group_corpus(dense(spark, vecs), 0.5, sparse=False, leaf_rows=leaf)) == [[0, 5]]
    with pytest.raises(Exception, match="lengths differ"):
        group_corpus(dense(spark, [[1, 0], [1, 0, 0]]), 0.5, sparse=False).collect()


@pytest.mark.parametrize("first", [0, 1, 25, 60])
def test_appended_items_give_the_groups_of_all(spark, first):
    rng = np.random.default_rng(first)
    vecs = rng.normal(size=(60, 3))
    old, new = dense(spark, vecs[:first]), dense(spark, vecs[first:], first)
    before = group_corpus(old, 0.7, sparse=False)
    leaders = old.join(before.select(before.b.alias("pos")), "pos", "left_anti")
    after = group_onto(new, leaders, 0.7, sparse=False, leaf_rows=10)
    assert groups(before.unionByName(after)) == walk(vecs.tolist(), 0.7)


def test_block_pairs_copy_no_item_to_a_shuffle(spark, monkeypatch):
    """Blocks are kept once and met by a cross join: the job that compares them has no exchange."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, sorted(rng.choice(900, 4, replace=False).tolist()), [1, 2, 1, 1], 7) for i in range(300)],
                               "pos bigint, idx array<int>, cnt array<bigint>, sq bigint").repartition(3)
    plans = []
    cut = type(df).checkpoint

    def noted(self, eager=True):
        if {"a", "b", "sim"} == set(self.columns):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return cut(self, eager)

    monkeypatch.setattr(type(df), "checkpoint", noted)
    L.near_edges(L._payload(df, "pos", True), 300, 0.8, True, 30, {}).count()
    assert plans and not any("Exchange" in p for p in plans)


def test_bounds_are_no_less_than_similarities():
    rng = np.random.default_rng(8)
    size = rng.integers(0, 30, 200)
    idx = np.concatenate([np.empty(0, np.int64), *[np.sort(rng.choice(4096, n, replace=False)) for n in size]])
    cnt = rng.integers(1, 60, len(idx)).astype(float)
    sq = np.bincount(np.repeat(np.arange(200), size), cnt * cnt, 200)
    x = L._Rows({"v": rng.permutation(200), "idx": (idx, size), "cnt": (cnt, size), "sq": sq}, True, alike=64)
    sim = L._similar(x, 0, 200, x, 0, 200)
    assert (x.bounds @ x.bounds.T + L.BOUND_MARGIN >= sim).all()
    i, j, s = L._Hits(x, x, 0.2).of(0, 200, 0, 200)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(sim >= 0.2))) and (s == sim[i, j]).all()


def counted(rng, n, buckets, copies):
    """Rows of counts, every ``copies``-th a near copy of the first, as a block and laid out."""
    base = np.sort(rng.choice(buckets, 40, replace=False))
    rows = [(base, rng.integers(5, 8, 40)) if i % copies == 0 else
            (np.sort(rng.choice(buckets, rng.integers(0, 60), replace=False)), None) for i in range(n)]
    rows = [(idx, rng.integers(1, 9, len(idx)) if cnt is None else cnt) for idx, cnt in rows]
    full = np.zeros((n, buckets))
    for i, (idx, cnt) in enumerate(rows):
        full[i, idx] = cnt
    return rows, full


def block(rows, pos, alike=0):
    idx, cnt = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    size = np.array([len(r[0]) for r in rows])
    sq = np.array([int((r[1] * r[1]).sum()) for r in rows])
    return L._Rows({"v": pos, "idx": (idx, size), "cnt": (cnt, size), "sq": sq}, True, alike)


@pytest.mark.parametrize("tile,pairwise,buckets", [(1024, 24, 300), (64, 1, 300), (40, 10**9, 6000)])
def test_blocks_in_stages_give_all_pairs_leaders_and_members(monkeypatch, tile, pairwise, buckets):
    """Negative and descending positions, empty rows, near copies; rows taken in parts and pair by pair."""
    monkeypatch.setattr(L, "TILE", tile)
    monkeypatch.setattr(L, "PAIRWISE", pairwise)
    rng = np.random.default_rng(tile)
    rows, full = counted(rng, 300, buckets, 7)
    norm = np.linalg.norm(full, axis=1)
    sim = full @ full.T / np.where(norm > 0, norm, 1)[:, None] / np.where(norm > 0, norm, 1)
    pos = np.arange(300) * 3 - 500
    x, y = block(rows[:150], pos[:150], tile), block(rows[150:], pos[150:], tile)
    edges = L._near(x, y, 0.9, 10**9)
    got = {(int(a), int(b)) for p, q, _ in edges for a, b in zip(p, q)}
    assert got == {(int(pos[i]), int(pos[150 + j])) for i, j in zip(*np.nonzero(sim[:150, 150:] >= 0.9))} and len(got) > 400
    assert L._near(x, y, 0.9, 3) is None
    at, least, sims = L._claimed(y, x, 0.9)
    want = {150 + j: int(np.flatnonzero(sim[:150, 150 + j] >= 0.9)[0]) for j in range(150) if (sim[:150, 150 + j] >= 0.9).any()}
    assert dict(zip(y.pos[at].tolist(), least.tolist())) == {int(pos[j]): int(pos[i]) for j, i in want.items()}
    leader, member, sims = L._led_alone(block(rows, pos), 0.9)
    assert groups_of(leader, member) == [[int(pos[i]) for i in g] for g in walk(full.tolist(), 0.9)]


def groups_of(leader, member):
    out = {}
    for a, b in zip(leader.tolist(), member.tolist()):
        out.setdefault(a, [a]).append(b)
    return sorted(sorted(g) for g in out.values())


def test_a_small_first_part_takes_the_cluster_and_nothing_stays(spark):
    """A cluster through the whole corpus is claimed by the leaders of a small first part: one split, not one for every half.

    No table or block that was kept meanwhile is left in the checkpoint folder, and no text is kept with the result.
    """
    import os

    from echoset.plans.passages import group_items
    from echoset.session import ensure_checkpoint_dir

    rng = np.random.default_rng(11)
    rows, full = counted(rng, 400, 500, 2)
    df = spark.createDataFrame([(i, r[0].tolist(), r[1].tolist(), int((r[1] * r[1]).sum())) for i, r in enumerate(rows)],
                               "pos bigint, idx array<int>, cnt array<bigint>, sq bigint")
    stats = {}
    assert groups(group_corpus(df, 0.9, leaf_rows=40, hold_rows=50, stats=stats)) == walk(full.tolist(), 0.9)
    assert stats["splits"] == 1
    items = spark.createDataFrame([(1, "a b c"), (2, "A b  c"), (3, "a b c"), (4, "d"), (5, None), (None, "a b c")], "doc_id bigint, text string")
    m = group_items(items, [], "doc_id", 0.9)
    assert sorted((r.leader_doc_id, r.doc_id, r.text) for r in m.collect() if r.doc_id) == [(1, 1, "a b c"), (1, 2, "A b  c"), (1, 3, "a b c")]
    assert group_items(items, [], "doc_id", 0.9, with_text=False).columns == ["leader_doc_id", "doc_id", "is_leader", "similarity"]
    kept = os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))
    assert not [f for f in kept if f.startswith(("scratch-", "blocks-"))]
