import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from echoset.llm.mixing import MARGINS, NONE, TEMPER, mix_documents, probabilities, rake, sample_documents

from .fixtures import awkward_rows, docs_frame, prose


def cells_frame(spark, cells):
    return spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")


def some_cells():
    rng = np.random.default_rng(4)
    return [(s, la, t, int(rng.integers(1, 5000))) for s in "abcde" for la in "xyz" for t in "pq" if rng.random() < 0.85]


def margin(rows, k, value):
    out = defaultdict(float)
    for r in rows:
        out[r[k]] += value(r)
    return out


def test_raked_margins_meet_the_targets(spark):
    cells = some_cells()
    want = {"source": dict(zip("abcde", (0.3, 0.25, 0.2, 0.15, 0.1))), "lang": dict(zip("xyz", (0.5, 0.3, 0.2))), "topic": {"p": 0.6, "q": 0.4}}
    targets = spark.createDataFrame([(m, v, s) for m, t in want.items() for v, s in t.items()] + [("lang", "absent", 0.7)], "margin string, value string, share double")
    out = rake(cells_frame(spark, cells), targets).collect()
    for k, m in enumerate(MARGINS):
        got = margin(out, k, lambda r: r["weight"])
        for v, s in want[m].items():
            assert abs(got[v] - s) < 1e-9
    # raking only scales by margins: the odds ratios of the cells stay
    w = {tuple(r[:3]): r["weight"] / r["tokens"] for r in out}
    for s in "abcd":
        a, b = [(s, "x", "p"), ("e", "y", "p")], [(s, "y", "p"), ("e", "x", "p")]
        if all(c in w for c in a + b):
            assert abs(w[a[0]] * w[a[1]] / (w[b[0]] * w[b[1]]) - 1) < 1e-6


def test_tables_of_any_size_are_raked_alike(spark, monkeypatch):
    cells = some_cells()
    targets = spark.createDataFrame(
        [("source", s, 0.2) for s in "abcde"] + [("lang", s, 1 / 3) for s in "xyz"] + [("topic", "p", 0.9), ("topic", "q", 0.1)],
        "margin string, value string, share double")
    one = {tuple(r[:3]): r for r in rake(cells_frame(spark, cells), targets, tol=0.0, max_rounds=4).collect()}
    monkeypatch.setattr("echoset.llm.mixing.SMALL_CELLS", 0)
    other = {tuple(r[:3]): r for r in rake(cells_frame(spark, cells), targets, tol=0.0, max_rounds=4).collect()}
    assert one.keys() == other.keys() == {c[:3] for c in cells}
    for c, r in one.items():
        assert abs(r["weight"] - other[c]["weight"]) < 1e-12 and abs(r["margin_error"] - other[c]["margin_error"]) < 1e-9


def test_contradicting_targets_are_reported(spark):
    cells = [("a", "x", "p", 10), ("b", "y", "p", 10)]  # a is x and b is y: their targets cannot differ
    targets = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.8), ("lang", "y", 0.2), ("topic", "p", 1.0)],
                                    "margin string, value string, share double")
    out = rake(cells_frame(spark, cells), targets, max_rounds=6).collect()
    assert len(out) == 2 and all(abs(r["margin_error"] - 0.6) < 1e-9 for r in out)
    assert rake(cells_frame(spark, cells).where("false"), targets).collect() == []


def test_probabilities_meet_the_budget(spark):
    raked = spark.createDataFrame([("a", "x", "p", 100, 0.6), ("b", "x", "p", 900, 0.3), ("c", "x", "p", 1000, 0.1)],
                                  "source string, lang string, topic string, tokens bigint, weight double")
    for keep in (0.05, 0.3, 0.7, 1.0):
        got = {r["source"]: r["probability"] for r in probabilities(raked, keep).collect()}
        expected = 100 * got["a"] + 900 * got["b"] + 1000 * got["c"]
        assert abs(expected - keep * 2000) < 1e-6 and all(0 < p <= 1 for p in got.values())
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert probabilities(raked.where("false"), 0.5).collect() == []


def test_documents_are_drawn_by_their_cells(spark):
    rows = awkward_rows()
    docs = docs_frame(spark, rows)
    got = mix_documents(docs, keep=0.5).collect()
    assert len(got) == len(rows)
    tokens = sorted(len(re.findall("[ \n]", t)) + 1 if t else 0 for _, t in rows)
    assert sorted(r["n_tokens"] for r in got) == tokens
    assert {r["source"] for r in got} >= {NONE, "src1"} and {r["lang"] for r in got} == {"en", "de", NONE}
    cells = defaultdict(int)
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    for r in got:
        u = int(hashlib.md5(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 16 ** 13
        assert r["kept"] == (u < r["probability"])
        assert (r["probability"] == 0) == (cells[r["source"], r["lang"], r["topic"]] == 0)
    expected = sum(r["probability"] * r["n_tokens"] for r in got)
    assert abs(expected - 0.5 * sum(tokens)) < 1e-3 * sum(tokens)
    sampled = sample_documents(docs, keep=0.5)
    assert sampled.columns == docs.columns
    assert sorted((r["doc_id"] for r in sampled.collect()), key=str) == sorted((r["doc_id"] for r in got if r["kept"]), key=str)


def test_sample_follows_the_weights(spark):
    import random

    rng = random.Random(1)
    rows = [(i, prose(rng, 20), "en" if i % 5 else "de", "big" if i % 10 else f"small{i % 3}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mix_documents(docs, topic=F.lit("any"), keep=0.5, temper=dict.fromkeys(MARGINS, 0.5)).collect()
    kept = [r for r in got if r["kept"]]
    assert abs(sum(r["n_tokens"] for r in kept) / sum(r["n_tokens"] for r in got) - 0.5) < 0.03
    share = margin(kept, 1, lambda r: r["n_tokens"])
    want = margin(got, 1, lambda r: r["n_tokens"] * r["probability"])
    for s in want:
        assert abs(share[s] / sum(share.values()) - want[s] / sum(want.values())) < 0.02


def test_empty_tables_and_no_python(spark):
    empty = docs_frame(spark, [])
    assert mix_documents(empty).collect() == [] and sample_documents(empty).collect() == []
    blank = docs_frame(spark, [(1, None), (2, "")])
    assert [(r["weight"], r["probability"], r["kept"]) for r in mix_documents(blank).collect()] == [(0.0, 0.0, False)] * 2
    plan = mix_documents(docs_frame(spark, awkward_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert set(TEMPER) == set(MARGINS)
