"""Stores and small report helpers: S4-S6, R11, R12, W2, W4."""

from pyspark.sql import functions as F

from echoset.operators.report import by_score, element_ids, load_run, save_run, write_csv
from echoset.plans.passages import group_items, group_summary, number_groups

ROWS = [("d1", 1, "the quick brown fox jumps"), ("d1", 2, "the quick brown fox jumps"),
        ("d1", 3, "completely unrelated words"), ("d1", 4, "quick brown fox jumps the"),
        ("d2", 1, "alpha beta"), ("d2", 2, "alpha beta"), ("d2", 5, "gamma delta"), ("d2", 7, "gamma delta")]


def members(spark):
    items = spark.createDataFrame(ROWS, "doc_id string, semid int, text string")
    return group_items(items, ["doc_id"], "semid", 0.75)


def test_runs_roundtrip(spark, tmp_path):
    m = members(spark)
    path = str(tmp_path / "groups")
    save_run(m, path, "run-a")
    save_run(m.where(F.col("doc_id") == "d2"), path, "run-b")
    assert load_run(spark, path, "run-a").count() == m.count()
    assert load_run(spark, path, "run-b").count() == 4
    assert load_run(spark, path, "missing").count() == 0


def test_numbering_score_order_ids_csv(spark, tmp_path):
    m = members(spark)
    s = number_groups(group_summary(m, ["doc_id"], "semid"), ["doc_id"], "semid")
    got = {(r.doc_id, r.leader_semid): (r.group_no, r.size) for r in s.collect()}
    assert got == {("d1", 1): (1, 3), ("d2", 1): (1, 2), ("d2", 5): (2, 2)}
    ordered = [r.avg_similarity for r in by_score(s, "semid").collect()]
    assert ordered == sorted(ordered, reverse=True)
    ids = element_ids(m.select("doc_id", "semid")).collect()
    assert len({r.element_id for r in ids}) == len(ids) and all(len(r.element_id) == 64 for r in ids)
    out = str(tmp_path / "csv")
    write_csv(m.select("doc_id", "leader_semid", "semid", "similarity", "text"), out)
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == m.count() and "leader_semid" in back.columns


def test_read_xml_files_then_extract(spark, tmp_path):
    from echoset.operators.extract import extract_elements
    from echoset.sources.documents import read_xml_files

    (tmp_path / "a.xml").write_text("<doc>\n<p>first\nline</p>\n<p>second</p>\n</doc>\n")
    (tmp_path / "b.xml").write_text("<doc><title>only title</title></doc>")
    docs = read_xml_files(spark, str(tmp_path / "*.xml"))
    got = sorted((r.doc_id.rsplit("/", 1)[-1], r.semid, r.text) for r in extract_elements(docs, "p title").collect())
    assert got == [("a.xml", 1, "first line"), ("a.xml", 2, "second"), ("b.xml", 1, "only title")]


def test_saving_a_run_again_keeps_its_rows_once(spark, tmp_path):
    m = members(spark)
    path = str(tmp_path / "groups")
    for _ in range(2):
        save_run(m, path, "run-a")
        save_run(m, path, "run-b")
    assert load_run(spark, path, "run-a").count() == load_run(spark, path, "run-b").count() == m.count()


def test_csv_of_metadata(spark, tmp_path):
    df = spark.createDataFrame([("d", {"id": "a"}, ["x", "y"])], "doc_id string, attributes map<string,string>, words array<string>")
    write_csv(df, str(tmp_path / "csv"))
    row = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "csv")).first()
    assert row.attributes == '{"id":"a"}' and row.words == '["x","y"]'


def test_distinct_texts_and_one_word_groups(spark):
    from echoset.operators.report import distinct_group_texts, drop_one_word_groups

    m = members(spark)
    got = {(r.doc_id, r.leader_semid, r.text): (r.first, r.positions) for r in distinct_group_texts(m, ["doc_id"], "semid").collect()}
    assert got["d1", 1, "the quick brown fox jumps"] == (1, [1, 2]) and got["d1", 1, "quick brown fox jumps the"] == (4, [4])
    items = spark.createDataFrame([("d", 1, "solo"), ("d", 2, "solo"), ("d", 3, "two words"), ("d", 4, "two words")],
                                  "doc_id string, semid int, text string")
    kept = drop_one_word_groups(group_items(items, ["doc_id"], "semid", 0.75), ["doc_id"], "semid")
    assert sorted(r.semid for r in kept.collect()) == [3, 4]


def test_document_files_in_few_folders_and_read_back(spark, tmp_path):
    """A file a document, written by the tasks themselves; few folders to list; rows of a task with one id share a file."""
    from echoset.operators.extract import extract_elements
    from echoset.sources.documents import FILE_FOLDERS, lines_as_xml, read_xml_files, write_document_files

    rows = [(i, f"line {i}\nsecond <é>") for i in range(600)] + [(-3, "one"), (-3, "two"), (7000, None)]
    docs = lines_as_xml(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    folder = str(tmp_path / "files")
    assert write_document_files(docs, folder) == 602
    paths = [p for p in (tmp_path / "files").rglob("*") if p.is_file()]
    assert len(paths) == 602 and len({p.parent for p in paths}) <= FILE_FOLDERS
    files = read_xml_files(spark, f"{folder}/*")
    assert files.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    got = sorted((int(r.doc_id.split("doc_id=")[1].split(".")[0]), r.semid, r.text) for r in extract_elements(files).collect())
    assert got == sorted((i, k + 1, t) for i in range(600) for k, t in enumerate((f"line {i}", "second <é>")))


def test_files_of_folders_are_listed_by_the_tasks(spark, tmp_path, monkeypatch):
    """The driver lists folders, not files; rows are those that Spark's reader gives."""
    from echoset.sources.documents import read_xml_files

    wanted = {"a": ["one.xml", "two words+%é.xml", "_hidden.xml", ".hidden", "_k=1.xml"], "b c": ["empty.xml", "k=1/deep.xml"],
              "none": [], "é": ["x.xml"]}
    for folder, names in wanted.items():
        (tmp_path / "top" / folder).mkdir(parents=True)
        for name in names:
            at = tmp_path / "top" / folder / name
            at.parent.mkdir(exist_ok=True)
            at.write_bytes(b"" if "empty" in name else f"<doc>\r\n{name} &amp; é</doc>\n".encode() + b"\xff")
    reader = type(spark.read)
    by_spark = [(r.doc_id, bytes(r.xml)) for folder in ("a", "b c", "é") for r in spark.read.text(
        str(tmp_path / "top" / folder), wholetext=True).selectExpr("_metadata.file_path AS doc_id", "cast(value AS binary) AS xml").collect()]
    monkeypatch.setattr(reader, "text", lambda *_, **__: (_ for _ in ()).throw(AssertionError("files listed in the driver")))
    got = [(r.doc_id, bytes(r.xml)) for r in read_xml_files(spark, str(tmp_path / "top" / "*")).selectExpr(
        "doc_id", "cast(xml AS binary) AS xml").collect()]
    assert sorted(got) == sorted(by_spark) and len(got) == 5
