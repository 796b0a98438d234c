"""Node table against the element job; stored groups and edges against one run over everything."""

import numpy as np
import pytest

from echoset.operators import nodes as N
from echoset.operators.extract import extract_elements, parse_documents
from echoset.operators.nodes import node_table, select_elements, unreadable
from echoset.plans.passages import group_items
from echoset.plans.store import EdgeStore, GroupStore

DOCS = [
    ("flat", "<doc><p>one</p><p> two\n lines </p><p/><p>three &amp; more</p></doc>"),
    ("deep", "<?xml version='1.0'?><!DOCTYPE d [<!ENTITY e 'entity'>]><d><s k='1'>a<p>b <i>c<!-- x --></i><![CDATA[<d>]]></p>e<s><p>&e;</p></s></s>tail</d>"),
    ("prefix", "<a:doc><a:p x='1'>t u</a:p><p>plain</p></a:doc>"),
    ("wide", "<d>" + "".join(f"<s><p>w{i}</p>{'<q>x</q>' * 3}</s>" for i in range(60)) + "</d>"),
    ("broken", "<doc><p>one</doc>"), ("empty", ""), ("none", None), ("textless", "<doc><p> </p></doc>"),
]
LISTS = ["p", "s p", "d doc a:doc", "i  q i", "a:p", "nothing"]


@pytest.mark.parametrize("stretch", [1, 7, 256])
def test_nodes_give_the_elements_of_the_parse_job(spark, monkeypatch, stretch):
    monkeypatch.setattr(N, "STRETCH", stretch)
    docs = spark.createDataFrame(DOCS, "doc_id string, xml string")
    nodes = node_table(docs).checkpoint()
    asked = spark.createDataFrame([(k, d, e) for d, _ in DOCS for k, e in enumerate(LISTS)], "request_id int, doc_id string, elements string")
    got = {(r.request_id, r.doc_id, r.semid, r.element, r.text, r.path, tuple(sorted(r.attributes.items())))
           for r in select_elements(nodes, asked).collect()}
    want = set()
    for k, e in enumerate(LISTS):
        for r in extract_elements(docs, e, with_meta=True).collect():
            want.add((k, r.doc_id, r.semid, r.element, r.text, r.xpath, tuple(sorted(r.attributes.items()))))
    assert got == want and len(want) > 100
    bad = {r.doc_id: r.error for r in unreadable(nodes).collect()}
    assert bad == {r.doc_id: r.parse_error for r in parse_documents(docs).where("parse_error IS NOT NULL").collect()}
    assert set(bad) == {"broken", "empty", "none"}


def test_levels_and_intervals(spark):
    rows = {r.path: (r.start, r.end, r.level) for r in node_table(spark.createDataFrame(DOCS[1:2], "doc_id string, xml string")).where(
        "kind = 'element'").collect()}
    assert rows["/d[1]"][0] == 0 and rows["/d[1]"][2] == 1 and rows["/d[1]/s[1]/s[1]/p[1]"][2] == 4
    inner, outer = rows["/d[1]/s[1]/p[1]/i[1]"], rows["/d[1]/s[1]"]
    assert outer[0] < inner[0] < inner[1] <= outer[1]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(9)]
    return [" ".join(rng.choice(words, size=6)) if i % 11 else ["", None, "same text here"][i % 3] for i in range(n)]


def test_batches_give_the_groups_of_all(spark, tmp_path):
    rows = list(enumerate(texts(120, 4)))
    schema = "doc_id bigint, text string"
    whole = {tuple(r) for r in group_items(spark.createDataFrame(rows, schema), [], "doc_id", 0.7).select(
        "leader_doc_id", "doc_id", "is_leader", "similarity").collect()}
    store = GroupStore(spark, f"file://{tmp_path}/groups", 0.7)
    assert store.members("doc_id").collect() == []
    cuts = [0, 31, 90, 120]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df = spark.createDataFrame(rows[a:b], schema).repartition(3)
        first = store.append(df, batch, "doc_id")
        assert store.append(df, batch, "doc_id") == first  # a retry changes nothing
    again = spark.createDataFrame([(200 + i, t) for i, t in rows], schema)
    assert store.append(again, 9, "doc_id")["encoded"] == 0  # every text is stored already
    got = {tuple(r) for r in store.members("doc_id").where("doc_id < 200").collect()}
    real = {i for i, x in rows if x}  # copies of a text without words are alike to nothing
    assert got >= whole and {r[1] for r in got - whole} <= real and all(r[0] == r[1] for r in got - whole)
    empty = GroupStore(spark, f"file://{tmp_path}/none", 0.7)
    empty.append(spark.createDataFrame([], schema), 0, "doc_id")
    assert empty.members("doc_id").collect() == []


def test_stored_edges_serve_higher_thresholds(spark, tmp_path):
    from echoset.operators.pairs import block_pairs

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i % 2, i, rng.normal(size=4).tolist()) for i in range(80)], "g int, pos bigint, vector array<double>")
    store = EdgeStore(spark, f"file://{tmp_path}/edges", ["g"])
    store.write(block_pairs(df, ["g"], 0.2, vector="vector"), parts=4)
    for t in (0.2, 0.5, 0.9):
        want = {(r.g, r.leader_pos, r.pos) for r in group_items(df, ["g"], "pos", t, text=None, vector="vector").where("NOT is_leader").collect()}
        assert {(r.g, r.leader, r.member) for r in store.groups(t).collect()} == want
    plan = store.edges(0.9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sim,0.9)" in plan


def test_nodes_are_handed_on_in_small_parts():
    """Documents that cannot be read, and long texts, attributes and paths, do not pile up."""
    import pyarrow as pa

    from echoset.operators.extract import BATCH_CHARS

    text = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("kind", text), ("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()),
                        ("name", text), ("path", text), ("attributes", pa.map_(text, text)), ("text", text)])
    long, bad = 100_000, N.BATCH_NODES + 10
    xmls = ["<d>"] * bad + [None] + ["<d>" + f"<p a='{'y' * long}'>{'x' * long}</p>" * 30 + "</d>"]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(xmls))), "xml": xmls}, pa.schema([("doc_id", pa.int64()), ("xml", text)]))
    parts = list(N._node_batches(schema)(iter([docs])))
    assert max(p.num_rows for p in parts) <= N.BATCH_NODES
    rows = [[*p.to_pylist()] for p in parts]
    chars = [sum(len(r["text"] or "") + sum(len(v) for _, v in r["attributes"] or []) for r in part) for part in rows]
    assert max(chars) <= BATCH_CHARS + long
    rows = [r for part in rows for r in part]
    assert [r["doc_id"] for r in rows if r["kind"] == "error"] == list(range(bad + 1)) and rows[bad]["text"] == "XML content not provided"
    rows = rows[bad + 1:]
    assert [r["start"] for r in rows] == list(range(len(rows))) and {r["doc_id"] for r in rows} == {bad + 1}
    assert sum(r["kind"] == "element" for r in rows) == 31 and "".join(r["text"] or "" for r in rows) == "x" * (30 * long)
