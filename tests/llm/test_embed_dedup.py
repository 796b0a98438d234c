import numpy as np
from pyspark.sql import functions as F

from echoset.llm.embed_dedup import cosine_links, embedding_groups

from .fixtures import CLASHING, union_find


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def clustered(seed, n, dim, copies, noise):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    near = [x[i % 12] + noise * rng.standard_normal(dim) * np.linalg.norm(x[i % 12]) / np.sqrt(dim) for i in range(copies)]
    return np.concatenate([x, near]).astype(np.float32)


def brute(vectors, threshold):
    """(n_links, component) by position; None links with nothing."""
    n = len(vectors)
    links = []
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            a, b = np.asarray(a, float), np.asarray(b, float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    degree = np.bincount(np.array(links, int).ravel(), minlength=n) if links else np.zeros(n, int)
    return degree.tolist(), union_find(n, links)


def test_groups_equal_brute_force(spark):
    vectors = [v.tolist() for v in clustered(1, 80, 64, 60, 0.2)]
    vectors += [vectors[2]] * 3 + [[2 * x for x in vectors[4]]]  # exact copies, another length of one direction
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    odd = [[1.0] * 8, [1.0] * 7 + [1.1]]  # of another size
    every = vectors + odd + bad
    rows = [(i, v, i % 3) for i, v in enumerate(every)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(frame(spark, rows)).collect()}
    degree, root = brute(vectors + odd + [None] * len(bad), 0.95)
    want = {i: (degree[i], root[i], root[i] == i) for i in range(len(every))}
    linked = sum(degree)
    assert linked > 100
    assert sum(v[0] for v in got.values()) >= 0.98 * linked
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((300, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    w = rng.standard_normal((300, 64))
    w -= (w * z).sum(1, keepdims=True) * z
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    pair = 0.951 * z + np.sqrt(1 - 0.951 ** 2) * w
    raw = [(i, v.astype("<f8").tobytes()) for i, v in enumerate(np.concatenate([z, pair]))]
    df = spark.createDataFrame(raw, "v bigint, raw binary")
    found = {(r["a"], r["b"]) for r in cosine_links(df, 0.95).collect()}
    assert sum((i, i + 300) in found for i in range(300)) >= 0.97 * 300


def test_crowded_filters_are_split_without_loss(spark):
    vectors = clustered(5, 12, 16, 150, 0.05)
    raw = [(i, v.astype("<f8").tobytes()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(raw, "v bigint, raw binary")
    one = {(r["a"], r["b"]) for r in cosine_links(df, 0.95, tile_rows=2048).collect()}
    many = {(r["a"], r["b"]) for r in cosine_links(df, 0.95, tile_rows=4).collect()}
    assert one == many and len(one) > 500


def test_empty_null_and_repeated_ids(spark):
    assert embedding_groups(frame(spark, [])).collect() == []
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(None, a, 0), (7, a, 0), (7, b, 0), (None, None, 0), (None, [0.0, 0.0, 1.0, 0.0], 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 1, 7, False), (7, 1, 7, True), (7, 0, 7, True), (None, 0, None, True), (None, 0, None, True)], key=str)
