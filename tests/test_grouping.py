"""Grouping (G1-G5) and the semantic traps: order, non-transitivity,
inclusive threshold, zero and NaN vectors, copies, long chains."""

import math
import random

import numpy as np
import pytest

from echoset.plans.passages import group_items


def run_groups(spark, vecs, t, scope_of=None, **kw):
    rows = [((scope_of(i) if scope_of else "s"), i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "doc string, pos int, vector array<double>")
    out = group_items(df, ["doc"], "pos", t, text=None, vector="vector", **kw).collect()
    groups = {}
    for r in out:
        groups.setdefault((r.doc, r.leader_pos), []).append(r.pos)
    return sorted(sorted(g) for g in groups.values())


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if (a == b).all() and a.any():
        return 1.0  # copies
    na, nb = math.sqrt(a @ a), math.sqrt(b @ b)
    return 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))


def walk(vecs, t):
    """Groups by definition: a vector leads unless an earlier leader is similar; others join their smallest one."""
    n = len(vecs)
    earlier = [[i for i in range(j) if cos(vecs[i], vecs[j]) >= t] for j in range(n)]
    leaders = []
    groups = {}
    for j in range(n):
        mine = [i for i in leaders if i in earlier[j]]
        if mine:
            groups.setdefault(min(mine), [min(mine)]).append(j)
        else:
            leaders.append(j)
    return sorted(sorted(g) for g in groups.values())


def test_two_near_one_far_one_opposite(spark):
    vecs = [[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [-1, 0, 0]]
    assert run_groups(spark, vecs, 0.75) == [[0, 1]]


@pytest.mark.parametrize("vecs", [[], [[1.0, 0.0]]])
def test_no_or_single_vector_gives_no_group(spark, vecs):
    assert run_groups(spark, vecs, 0.5) == []


def test_not_transitive_and_order_matters(spark):
    a, b, c = [1.0, 0.0], [math.cos(0.6), math.sin(0.6)], [math.cos(1.2), math.sin(1.2)]
    t = 0.8  # cos 0.6 = 0.825 >= t, cos 1.2 = 0.36 < t
    assert run_groups(spark, [a, b, c], t) == [[0, 1]]
    assert run_groups(spark, [b, a, c], t) == [[0, 1, 2]]


def test_threshold_is_inclusive(spark):
    assert run_groups(spark, [[1.0, 0.0], [0.6, 0.8]], 0.6) == [[0, 1]]


def test_zero_vectors(spark):
    assert run_groups(spark, [[0.0, 0.0], [0.0, 0.0]], 0.0) == [[0, 1]]
    assert run_groups(spark, [[0.0, 0.0], [0.0, 0.0]], 0.1) == []


def test_nan_never_grouped(spark):
    assert run_groups(spark, [[float("nan"), 1.0], [float("nan"), 1.0], [1.0, 1.0]], 0.0) == []


def test_mixed_lengths_fail_only_their_scope(spark):
    vecs = [[1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0], [1.0, 0.01]]
    got = run_groups(spark, vecs, 0.9, scope_of=lambda i: "bad" if i < 2 else "good")
    assert got == [[2, 3]]


def test_copies_follow_first_occurrence(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    vecs = [base[rng.randrange(12)] for _ in range(60)]  # many exact copies
    for t in (0.3, 0.8, 1.0):
        assert run_groups(spark, vecs, t) == walk(vecs, t)


def test_chain_rounds_equal_local_walk(spark):
    # 200 near-duplicates in a chain: neighbours close, distant ones not
    vecs = [[math.cos(i * 0.05), math.sin(i * 0.05)] for i in range(200)]
    t = math.cos(0.075)
    expected = walk(vecs, t)
    stats = {}
    assert run_groups(spark, vecs, t, block_rows=8, stats=stats) == expected
    assert stats["rounds"] == 1  # one range: its walk resolves the chain
    assert run_groups(spark, vecs, t) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_random_invariants(spark, seed):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(150, 6)).tolist()
    scope_of = lambda i: f"s{i % 3}"
    t = 0.6
    got = run_groups(spark, vecs, t, scope_of=scope_of, block_rows=20)
    exp = []
    for s in range(3):
        idx = [i for i in range(150) if i % 3 == s]
        exp += [[idx[k] for k in g] for g in walk([vecs[i] for i in idx], t)]
    assert got == sorted(sorted(g) for g in exp)
    members = set()
    for g in got:
        leader = min(g)
        assert all(cos(vecs[leader], vecs[m]) >= t for m in g)
        assert not members & set(g)
        members |= set(g)
    leaders = [min(g) for g in got]
    for i in leaders:  # no two leaders of one scope are similar
        for j in leaders:
            if i < j and scope_of(i) == scope_of(j):
                assert cos(vecs[i], vecs[j]) < t


@pytest.mark.parametrize("seed", range(6))
def test_pure_rounds_equal_walk(spark, seed):
    # low-dimensional vectors: dense neighbourhoods, several rounds, vertices
    # that turn leader only because all their remaining edges disappear
    rng = np.random.default_rng(100 + seed)
    vecs = rng.normal(size=(90, 3)).tolist()
    for t in (0.6, 0.85):
        stats = {}
        assert run_groups(spark, vecs, t, block_rows=8, stats=stats) == walk(vecs, t)
        assert stats["rounds"] >= 1


def test_rounds_on_real_embeddings(spark):
    import os

    from echoset.operators.grouping import greedy_leaders
    from echoset.operators.pairs import block_pairs
    from echoset.plans.passages import distinct_vertices, encode_vertices

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables not present")
    emb = spark.read.parquet(path)
    v = encode_vertices(distinct_vertices(emb, [], "vec_id", "embedding"), "embedding", "precomputed", 0)
    e = block_pairs(v, [], 0.3, vector="vector").checkpoint(eager=True)
    edges = [(r.a, r.b) for r in e.collect()]
    later = {}
    for a, b in edges:
        later.setdefault(a, set()).add(b)
    covered, leaders = set(), set()
    for x in sorted({x for ab in edges for x in ab}):
        if x not in covered:
            leaders.add(x)
            covered |= later.get(x, set())
    assert {r.v for r in greedy_leaders(e, []).collect()} == leaders


def test_equal_word_counts_are_similar_at_one(spark):
    ten = "a b c d e f g h i j"
    texts = ["a b", "a b", "b a", ten, ten, " ".join(reversed(ten.split())), "a a b"]
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, pos int, text string")
    got = {}
    for r in group_items(items, ["doc"], "pos", 1.0).collect():
        got.setdefault(r.leader_pos, []).append(r.pos)
    assert sorted(sorted(g) for g in got.values()) == [[0, 1, 2], [3, 4, 5]]
    across = group_items(items.drop("doc"), [], "pos", 1.0).collect()
    assert sorted(r.pos for r in across) == [0, 1, 2, 3, 4, 5]


def test_rounds_and_blocks_agree(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([(f"d{i % 3}", i, " ".join(rng.choice(words, size=5))) for i in range(120)], "doc string, pos int, text string")
    one = {tuple(r) for r in group_items(items, ["doc"], "pos", 0.6).collect()}
    stats = {}
    many = {tuple(r) for r in group_items(items, ["doc"], "pos", 0.6, block_rows=7, stats=stats).collect()}
    assert one == many and stats["rounds"] >= 1


def lfmis(edges):
    """Members by definition: later ends of an edge from a leader."""
    later = {}
    for a, b in edges:
        later.setdefault(a, set()).add(b)
    members = set()
    for x in sorted({x for ab in edges for x in ab}):
        if x not in members:
            members |= later.get(x, set())
    return members


@pytest.mark.parametrize("range_edges", [40, 7, 1000])
def test_ranges_of_edges_equal_the_definition(spark, range_edges):
    from echoset.operators.grouping import greedy_leaders

    rng = random.Random(range_edges)
    edges = {tuple(sorted(rng.sample(range(90), 2))) for _ in range(200)} | {(i, i + 1) for i in range(100, 130)}
    rows = [(s, a, b) for s in ("x", "y") for a, b in edges if s == "x" or a % 3]
    df = spark.createDataFrame(rows, "s string, a bigint, b bigint")
    got = {(r.s, r.v) for r in greedy_leaders(df, ["s"], range_edges=range_edges).collect()}
    want = set()
    for s in ("x", "y"):
        own = [(a, b) for t, a, b in rows if t == s]
        want |= {(s, v) for v in {v for e in own for v in e} - lfmis(own)}
    assert got == want


def test_long_chain_in_few_rounds(spark):
    from echoset.operators.grouping import greedy_leaders

    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    for range_edges in (1_500, 500_000):
        stats = {}
        leaders = sorted(r.v for r in greedy_leaders(chain, [], stats=stats, range_edges=range_edges).collect())
        assert leaders == list(range(0, 10_001, 2)) and stats["rounds"] < 40
