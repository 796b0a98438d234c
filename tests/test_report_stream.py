"""Validation, outcomes, expiry, result shape, streaming = batch, entry contract."""

import datetime as dt
import os

from pyspark.sql import functions as F

from echoset.operators.report import (MSG_BAD_ELEMENTS, MSG_BAD_THRESHOLD, MSG_EMPTY_XML, MSG_NO_XML,
                                      document_outcomes, live_runs, result_documents, validate_documents)


def test_validate(spark):
    rows = [("a", "<d/>", "p title", None), ("b", "<d/>", "a.b", 0.5), ("c", "<d/>", " p", 0.5),
            ("d", "<d/>", "p\n", 0.5), ("e", "<d/>", "a/b", 0.5), ("f", "<d/>", "p", -0.1),
            ("g", "<d/>", "p", 1.1), ("h", "<d/>", "p", float("nan")), ("i", None, "p", 0.5),
            ("j", "\n\t \x01\n", "p", 0.5), ("k", "<d/>", "p%20title", 1.0), ("l", "<d/>", "p%zz", 0.5),
            ("m", "<d/>", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id string, xml string, elements string, threshold double")
    got = {r.doc_id: r for r in validate_documents(df).collect()}
    assert got["a"].error is None and got["a"].threshold == 0.75
    for k in "bcde":
        assert got[k].error == MSG_BAD_ELEMENTS
    for k in "fgh":
        assert got[k].error == MSG_BAD_THRESHOLD
    assert got["i"].error == MSG_NO_XML and got["j"].error == MSG_EMPTY_XML
    assert got["k"].error is None and got["k"].elements == "p title"
    assert got["l"].error is not None
    assert got["m"].error is None and got["m"].elements == "p"


def test_outcomes(spark):
    docs = spark.createDataFrame([
        ("one", "<doc><paragraph>Many sentences. In one paragraph.</paragraph></doc>"),
        ("none", "<doc><q>x</q></doc>"),
        ("bad", "<doc><p>x</doc>"),
        ("dup", "<doc><p>same text here</p><p>other words entirely</p><p>same text here</p></doc>"),
    ], "doc_id string, xml string")
    out, members = document_outcomes(docs, "p paragraph", 0.75)
    o = {r.doc_id: r for r in out.collect()}
    assert o["one"].status == "COMPLETED" and o["one"].n_groups == 0
    assert o["none"].status == "NO_TEXT_EXTRACTED" and o["none"].error.startswith("No sentences")
    assert o["bad"].status == "ERROR"
    assert (o["dup"].n_texts, o["dup"].n_groups, o["dup"].grouped_texts, o["dup"].removable_texts) == (3, 1, 2, 1)
    res = result_documents(members, ["doc_id"], "semid").collect()
    assert [(r.doc_id, r.similarity_groups) for r in res] == [("dup", [["same text here", "same text here"]])]


def test_expiry_boundary(spark):
    t0 = dt.datetime(2026, 1, 1, 12, 0, 0)
    runs = spark.createDataFrame([("r", t0)], "run_id string, created_at timestamp")
    assert live_runs(runs, t0 + dt.timedelta(minutes=60)).count() == 1
    assert live_runs(runs, t0 + dt.timedelta(minutes=60, microseconds=1)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from echoset.streaming.stream import latest_status, start_document_stream, xml_file_stream

    src = tmp_path / "in"
    src.mkdir()
    docs = {"a.xml": "<doc><p>alpha beta gamma</p><p>alpha beta gamma</p><p>zeta</p></doc>",
            "b.xml": "<doc><p>one</p></doc>", "c.xml": "<doc><p>broken</doc>"}
    for name, body in docs.items():
        (src / name).write_text(body)
    out = str(tmp_path / "out")
    q = start_document_stream(xml_file_stream(spark, str(src)), out, checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    streamed = {os.path.basename(r.doc_id): (r.status, r.n_groups) for r in
                latest_status(spark.read.parquet(f"{out}/runs")).collect()}
    batch_in = spark.createDataFrame([(f"file:{src}/{k}", v) for k, v in docs.items()], "doc_id string, xml string")
    batch, _ = document_outcomes(batch_in)
    assert streamed == {os.path.basename(r.doc_id): (r.status, r.n_groups) for r in batch.collect()}
    assert streamed["a.xml"] == ("COMPLETED", 1) and streamed["c.xml"][0] == "ERROR"


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["doc_id", "leader_semid", "semid", "is_leader", "similarity", "text"]
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_run_requests_per_row_parameters(spark):
    from echoset.operators.report import run_requests

    xml = ("<doc><title>red apple pie</title><p>red apple pie recipe</p>"
           "<p>red apple tart</p><p>other words</p></doc>")
    rows = [("strict", xml, "p title", 0.99), ("loose", xml, "p title", 0.5), ("paras", xml, "p", 0.5),
            ("badel", xml, "p.x", 0.5), ("badt", xml, "p", 2.0)]
    req = spark.createDataFrame(rows, "doc_id string, xml string, elements string, threshold double")
    out, members = run_requests(req)
    o = {r.doc_id: r for r in out.collect()}
    assert o["strict"].n_groups == 0 and o["strict"].n_texts == 4
    assert o["loose"].n_groups == 1 and o["loose"].grouped_texts == 3
    assert o["paras"].n_texts == 3 and o["paras"].n_groups == 1 and o["paras"].grouped_texts == 2
    assert o["badel"].status == "ERROR" and o["badel"].error == MSG_BAD_ELEMENTS
    assert o["badt"].status == "ERROR" and o["badt"].error == MSG_BAD_THRESHOLD


def test_latest_status_stateful(spark, tmp_path):
    import datetime as dt

    from echoset.streaming.stream import latest_status_stateful

    src = tmp_path / "runs"
    schema = "doc_id string, status string, n_groups bigint, created_at timestamp"
    t0 = dt.datetime(2026, 1, 1, 12, 0)
    first = [("a", "PROCESSING", 0, t0), ("b", "PROCESSING", 0, t0), ("a", "COMPLETED", 2, t0 + dt.timedelta(seconds=5))]
    spark.createDataFrame(first, schema).write.parquet(str(src / "batch1"))
    stream = spark.readStream.schema(schema).parquet(str(src / "batch1"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        q = (latest_status_stateful(stream).writeStream.format("memory").queryName("latest_status_t")
             .outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
        assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r.doc_id: (r.status, r.n_groups, r.expired) for r in spark.table("latest_status_t").collect()}
    assert got == {"a": ("COMPLETED", 2, False), "b": ("PROCESSING", 0, False)}


def test_outcomes_observed_metrics(spark):
    from pyspark.sql import Observation

    docs = spark.createDataFrame([("a", "<d><p>x y</p><p>x y</p></d>"), ("b", "<d><p>z</p></d>")],
                                 "doc_id string, xml string")
    obs = Observation("run")
    out, _ = document_outcomes(docs, observation=obs)
    assert out.count() == 2
    assert obs.get == {"texts": 3, "documents": 2}


def test_repeated_documents_are_requests_of_their_own(spark):
    from echoset.operators.report import run_requests

    xml = "<d><p>a b</p><p>b a</p></d>"
    req = spark.createDataFrame([("x", xml, "p", 0.9), ("x", "<d><p>a b</p><p>a c</p></d>", "p", 0.5), ("x", xml, "q", None)],
                                "doc_id string, xml string, elements string, threshold double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out, members = run_requests(req)
    rows = sorted((r.doc_id, r.threshold, r.status, r.n_texts, r.n_groups, r.grouped_texts) for r in out.collect())
    assert rows == [("x", 0.5, "COMPLETED", 2, 1, 2), ("x", 0.75, "NO_TEXT_EXTRACTED", 0, 0, 0), ("x", 0.9, "COMPLETED", 2, 1, 2)]
    assert {r.doc_id for r in members.collect()} == {"x"} and members.select("request_id").distinct().count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_vectors_of_different_length_are_an_error(spark):
    from echoset.operators.report import vector_outcomes

    rows = [("bad", 1, [1.0, 0.0]), ("bad", 2, [1.0]), ("good", 1, [1.0, 0.0]), ("good", 2, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "doc string, pos int, vector array<double>")
    got = {r.doc: (r.status, r.error is None, r.n_texts, r.n_groups) for r in vector_outcomes(df, "doc", "pos", "vector", 0.9).collect()}
    assert got == {"bad": ("ERROR", False, 2, 0), "good": ("COMPLETED", True, 2, 1)}


def test_stream_releases_what_it_keeps(spark, tmp_path):
    from echoset.streaming.stream import start_document_stream

    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.xml").write_text("<doc><p>a b</p><p>a b</p></doc>")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", 1).load(str(src))
    q = start_document_stream(stream.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml")),
                              str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 3
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_status_follows_creation_time(spark, tmp_path):
    """Late news within the time to live counts, later ones do not; time is the watermark."""
    import datetime as dt

    from echoset.streaming.stream import run_states, start_status_stream

    day = dt.datetime(2024, 5, 1)
    at = lambda minutes: day + dt.timedelta(minutes=minutes)
    chunks = [
        [("a", "PROCESSING", 0, 0, 0), ("b", "PROCESSING", 0, 0, 0), ("c", "PROCESSING", 0, 5, 5), ("d", "PROCESSING", 0, 65, 65), ("d", "ERROR", 0, 65, 66)],
        [("a", "COMPLETED", 2, 0, 10), ("x", "PROCESSING", 0, 75, 75)],  # the watermark is 66 - 5: a's end comes late by 1
        [("c", "COMPLETED", 3, 5, 62), ("b", "ERROR", 1, 0, 62), ("y", "PROCESSING", 0, 90, 90)],  # the watermark is 75 - 5 = 5 + 65: not past for c
        [("y", "COMPLETED", 1, 90, 95), ("y", "PROCESSING", 0, 90, 91)],
    ]
    src = str(tmp_path / "in")
    for rows in chunks:
        spark.createDataFrame([(i, s, n, at(c), at(e)) for i, s, n, c, e in rows], "doc_id string, status string, n_groups int, created_at timestamp, at timestamp"
                              ).coalesce(1).write.mode("append").parquet(src)
    events = spark.readStream.schema("doc_id string, status string, n_groups int, created_at timestamp, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    start_status_stream(events, str(tmp_path / "out"), ttl_minutes=65, late="5 minutes").awaitTermination()
    got = {r.doc_id: (r.status, r.n_groups, r.expired) for r in run_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"a": ("COMPLETED", 2, True), "b": ("PROCESSING", 0, True), "c": ("COMPLETED", 3, True), "d": ("ERROR", 0, False),
                   "x": ("PROCESSING", 0, False), "y": ("COMPLETED", 1, False)}


def test_run_states_are_kept_in_few_lists(spark, tmp_path, monkeypatch):
    """State and Python calls do not grow with the runs alive: 300 of them in 7 lists."""
    from echoset.streaming import stream as S

    monkeypatch.setattr(S, "RUN_BUCKETS", 7)
    src = str(tmp_path / "in")
    for late, status in enumerate(("PROCESSING", "COMPLETED")):
        spark.range(300).selectExpr("id AS doc_id", f"'{status}' AS status", "1 AS n_groups", "timestamp_seconds(1700000000 + id) AS created_at",
                                    f"timestamp_seconds(1700000000 + id + {late}) AS at").coalesce(1).write.mode("append").parquet(src)
    events = spark.readStream.schema("doc_id bigint, status string, n_groups int, created_at timestamp, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = S.start_status_stream(events, str(tmp_path / "out"))
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 7
    got = S.run_states(spark.read.parquet(str(tmp_path / "out")))
    assert got.schema["doc_id"].dataType.simpleString() == "bigint" and got.where("status = 'COMPLETED' AND NOT expired").count() == 300


def test_requests_keep_no_document_and_outcomes_alone_leave_nothing(spark, monkeypatch):
    """Texts are kept compressed and only while they are read; documents never; repeated requests count as before."""
    import os

    from echoset.operators.report import run_requests
    from echoset.session import ensure_checkpoint_dir

    kept = []
    cut = type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, eager=True: (kept.append(self.columns), cut(self, eager))[1])
    rows = [(1, 7, "<d><p>a b</p><p>c</p><p>a  b</p></d>", 0.5), (2, 7, "<d><p>a b</p></d>", 2.0), (3, 8, "<d><p>x", None),
            (4, 9, "<d><p>one two</p></d>", 0.9), (4, 9, "<d><p>one two three</p></d>", 0.8), (None, 5, "<d><p>q</p></d>", 0.5)]
    req = spark.createDataFrame(rows, "request_id bigint, doc_id bigint, xml string, threshold double")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("scratch-")}
    out, members = run_requests(req, outcomes_only=True)
    got = sorted((r.request_id, r.status, r.n_texts, r.n_groups, r.grouped_texts, r.threshold) for r in out.collect())
    assert members is None and {f for f in os.listdir(folder) if f.startswith("scratch-")} == before
    assert got == [(1, "COMPLETED", 3, 1, 2, 0.5), (2, "ERROR", 0, 0, 0, 2.0), (3, "ERROR", 0, 0, 0, 0.75),
                   (4, "COMPLETED", 2, 4, 4, 0.8), (4, "COMPLETED", 2, 4, 4, 0.9)]
    assert not any({"xml", "raw_text", "text"} & set(c) for c in kept)
