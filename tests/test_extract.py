"""Extraction (X1-X7, P4, X6) on hand-written documents, mirroring the
reference's extraction tests plus the added fixtures."""

from pyspark.sql import functions as F

from echoset.operators.extract import annotate_documents, extract_elements, parse_errors


def texts(spark, xml, elements="p"):
    df = spark.createDataFrame([("d", xml)], "doc_id string, xml string")
    return [(r.semid, r.text) for r in extract_elements(df, elements).orderBy("semid").collect()]


def test_title_and_three_paragraphs(spark):
    xml = "<doc><title>T</title><p>One first.</p><p>Two second.</p><p>Three third.</p></doc>"
    assert texts(spark, xml) == [(1, "One first."), (2, "Two second."), (3, "Three third.")]


def test_inline_children_are_flattened(spark):
    xml = "<doc><p>A <b>bold</b> and <i>it<u>al</u>ic</i> word.</p><p>Plain <a href='x'>link</a></p></doc>"
    assert [t for _, t in texts(spark, xml)] == ["A bold and italic word.", "Plain link"]


def test_malformed_and_empty_are_errors(spark):
    df = spark.createDataFrame([("bad", "<doc><p>unclosed</doc>"), ("empty", ""), ("none", None),
                                ("ok", "<doc><p>x</p></doc>")], "doc_id string, xml string")
    errs = {r.doc_id for r in parse_errors(df).collect()}
    assert errs == {"bad", "empty", "none"}
    assert [r.doc_id for r in extract_elements(df).collect()] == ["ok"]


def test_entities_decoded(spark):
    assert texts(spark, "<doc><p>a &amp; b &lt; c &#233; &#x41;</p></doc>") == [(1, "a & b < c é A")]


def test_name_sets(spark):
    xml = ("<doc><title>t</title><h1>h</h1><p>p1</p><div>d<span>s</span></div><section><p>p2</p></section></doc>")
    counts = {names: len(texts(spark, xml, names)) for names in
              ["p", "div", "section", "h1", "title", "p div", "p div h1 title"]}
    assert counts == {"p": 2, "div": 1, "section": 1, "h1": 1, "title": 1, "p div": 3, "p div h1 title": 5}


def test_whitespace_collapsed_nbsp_kept(spark):
    xml = "<doc><p>\n  a\t\tb   c \r\n d  </p><p>x y </p></doc>"
    assert [t for _, t in texts(spark, xml)] == ["a b c d", "x y "]


def test_empty_element_keeps_semid_gap(spark):
    assert texts(spark, "<doc><p>first</p><p>  </p><p>third</p></doc>") == [(1, "first"), (3, "third")]


def test_nested_matches_outer_first(spark):
    xml = "<doc><section>Intro <p>inner one</p> mid <p>inner two</p></section></doc>"
    assert texts(spark, xml, "section p") == [
        (1, "Intro inner one mid inner two"), (2, "inner one"), (3, "inner two")]


def test_comment_dropped_cdata_kept(spark):
    assert texts(spark, "<doc><p>a<!-- hidden -->b<![CDATA[ <c> ]]>d<?pi x?></p></doc>") == [(1, "ab <c> d")]


def test_undeclared_prefix_and_external_entity(spark):
    xml = ('<?xml version="1.0"?><!DOCTYPE doc [<!ENTITY ext SYSTEM "file:///etc/passwd">]>'
           '<doc><x:p>prefixed</x:p><p>before &ext; after</p></doc>')
    got = texts(spark, xml, "p x:p")
    assert got[0] == (1, "prefixed")
    assert "root:" not in got[1][1]


def test_no_matching_elements(spark):
    assert texts(spark, "<doc><para>x</para></doc>") == []


def test_agrees_with_spark_xpath(spark):
    xml = "<doc><p>a <b>b</b></p><q><p>c</p></q><p/></doc>"
    df = spark.createDataFrame([("d", xml)], "doc_id string, xml string")
    n = df.select(F.expr("xpath_int(xml, \"count(//*[name()='p'])\")")).first()[0]
    assert n == 3
    first = df.select(F.expr("xpath_string(xml, \"normalize-space(string((//*[name()='p'])[1]))\")")).first()[0]
    assert texts(spark, xml)[0] == (1, first)


def test_annotate_round_trip(spark):
    xml = '<doc><title>t</title><p cms:semid="9">one</p><p>two <b>b</b></p><section><p>three</p></section></doc>'
    df = spark.createDataFrame([("d", xml)], "doc_id string, xml string")
    ann = annotate_documents(df, "p title").collect()[0]
    assert ann.error is None
    for i in range(1, 5):
        assert f'cms:semid="{i}"' in ann.annotated_xml
    assert 'cms:semid="9"' not in ann.annotated_xml
    again = spark.createDataFrame([("d", ann.annotated_xml)], "doc_id string, xml string")
    assert [r.text for r in extract_elements(again, "p title").orderBy("semid").collect()] == [
        "t", "one", "two b", "three"]


def test_random_lines_round_trip(spark):
    """lines -> escaped <p> document -> extraction == plain split + normalize-space."""
    import random
    import re

    from echoset.sources.documents import lines_as_xml

    rng = random.Random(11)
    alphabet = list("abcxyz éüß&<>\"'\t  ") + ["\u00a0", "\u2028", "ʃ", "😀"]
    docs = []
    for d in range(40):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = sorted((r.doc_id, r.semid, r.text) for r in extract_elements(lines_as_xml(df)).collect())
    exp = []
    for d, text in docs:
        for k, line in enumerate(text.split("\n"), start=1):
            norm = re.sub("[ \t\r\n]+", " ", line).strip(" ")
            if norm:
                exp.append((d, k, norm))
    assert got == sorted(exp)


def test_element_metadata(spark):
    xml = '<doc><p id="a" class="x">one</p><sec><p>two</p><p lang="fr">trois</p></sec></doc>'
    df = spark.createDataFrame([("d", xml)], "doc_id string, xml string")
    rows = extract_elements(df, "p", with_meta=True).orderBy("semid").collect()
    assert [(r.semid, r.xpath, r.attributes) for r in rows] == [
        (1, "/doc[1]/p[1]", {"id": "a", "class": "x"}),
        (2, "/doc[1]/sec[1]/p[1]", {}),
        (3, "/doc[1]/sec[1]/p[2]", {"lang": "fr"}),
    ]
    assert [r.content for r in rows] == ['<p id="a" class="x">one</p>', "<p>two</p>", '<p lang="fr">trois</p>']
    odd = spark.createDataFrame([("d", '<d><p>a<i>b</i><!-- c --> &amp; <p x=">"/>d</p >\n</d>')], "doc_id string, xml string")
    assert [r.content for r in extract_elements(odd, "p i", with_meta=True).orderBy("semid").collect()] == [
        '<p>a<i>b</i><!-- c --> &amp; <p x=">"/>d</p >', "<i>b</i>"]


def test_annotated_copy_is_whole_at_any_depth(spark):
    from echoset.operators.extract import annotate_documents

    deep = "<doc>" + "<s>" * 3000 + "<p>x</p>" + "</s>" * 3000 + "</doc>"
    full = ('<?xml version="1.0"?>\n<!DOCTYPE d [<!ENTITY e "é">]>\n<!-- before --><d><p a="1" cms:semid="9" b=\'>\'>&e;</p>'
            "<q/><p/>\n<pp>no</pp></d><!-- after --><?pi x?>")
    df = spark.createDataFrame([(1, deep), (2, full), (3, "<d><p></d>"), (4, None)], "doc_id int, xml string")
    got = {r.doc_id: (r.annotated_xml, r.error) for r in annotate_documents(df, "p").collect()}
    assert got[1] == (deep.replace("<p>", '<p cms:semid="1">'), None)
    want = full.replace('<p a="1" cms:semid="9"', '<p cms:semid="1" a="1"').replace("<p/>", '<p cms:semid="2"/>')
    assert got[2] == (want, None)
    assert got[3][0] is None and got[3][1].startswith("malformed") and got[4][0] is None


def test_a_batch_of_many_documents_is_handed_on_in_small_parts():
    import pyarrow as pa

    from echoset.operators import extract as X

    n = 3 * X.BATCH_ROWS // 10
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "xml": ["<d>" + "<p>a</p>" * 10 + "</d>"] * n})
    schema = pa.schema([("doc_id", pa.int64()), ("semid", pa.int32()), ("element", pa.string()), ("raw_text", pa.string()),
                        ("parse_error", pa.string())])
    parts = list(X._extract_batches("p", False, schema)(iter([docs])))
    assert max(p.num_rows for p in parts) <= X.BATCH_ROWS and sum(p.num_rows for p in parts) == 10 * n
    assert [d for p in parts for d in p.column("doc_id").to_pylist()] == [d for d in range(n) for _ in range(10)]
    assert max(len(s["doc_id"]) for s in X.slices([docs])) <= X.SLICE_DOCS
    long = pa.RecordBatch.from_pydict({"doc_id": [1], "xml": ["<d>" + f"<p>{'x' * 100_000}</p>" * 50 + "</d>"]})
    assert max(sum(map(len, p.column("raw_text").to_pylist())) for p in X._extract_batches("p", False, schema)(iter([long]))) <= X.BATCH_CHARS + 100_000


def test_texts_are_normalised_once(spark):
    """Runs and lone white space of each kind; a text's white space is looked for once, not again for the filter."""
    docs = [(1, "<d><p> a  b&#9;c </p><p>&#13;&#10; </p><p/><p>a b\u00a0 c</p><p>x&#13;y &#10;</p></d>"), (2, "<d><p>  </p></d>")]
    out = extract_elements(spark.createDataFrame(docs, "doc_id long, xml string"), "p")
    assert [(r.doc_id, r.semid, r.text) for r in out.orderBy("doc_id", "semid").collect()] == [
        (1, 1, "a b c"), (1, 4, "a b\u00a0 c"), (1, 5, "x y")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def _metadata_parts(xmls):
    import pyarrow as pa

    from echoset.operators import extract as X

    schema = pa.schema([("doc_id", pa.int64()), ("semid", pa.int32()), ("element", pa.string()), ("raw_text", pa.string()),
                        ("parse_error", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("xpath", pa.string()),
                        ("content", pa.string())])
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(xmls))), "xml": xmls}, pa.schema([("doc_id", pa.int64()), ("xml", pa.string())]))
    return list(X._extract_batches("p", True, schema)(iter([docs])))


def test_documents_without_matches_are_handed_on_in_small_parts():
    """Marker rows of documents that are malformed, missing or without a match are not kept until a match comes."""
    from echoset.operators import extract as X

    n = X.BATCH_ROWS + 10
    parts = _metadata_parts(["<d><p>", None, "<d><q/></d>"] * n)
    assert max(p.num_rows for p in parts) <= X.BATCH_ROWS
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(3 * n)) and {r["semid"] for r in rows} == {None}
    assert rows[0]["parse_error"].startswith("malformed XML") and rows[1]["parse_error"] == "XML content not provided"
    assert rows[2]["parse_error"] is None and rows[2]["attributes"] is None


def test_long_markup_counts_like_long_text():
    """Elements of little text but long markup or attributes: a part holds about BATCH_CHARS of all of it."""
    from echoset.operators import extract as X

    long = 100_000
    xml = "<d>" + f"<p>a<b x='{'y' * long}'/></p><p z='{'y' * long}'>b</p>" * 50 + "</d>"
    parts = _metadata_parts([xml])
    assert max(sum(map(len, p.column("content").to_pylist())) for p in parts) <= X.BATCH_CHARS + 2 * long
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["semid"] for r in rows] == list(range(1, 101)) and {r["raw_text"] for r in rows} == {"a", "b"}
    assert rows[1]["attributes"] == [("z", "y" * long)] and rows[0]["content"].endswith("/></p>")


def test_long_documents_become_objects_few_at_a_time():
    import pyarrow as pa

    from echoset.operators import extract as X

    sizes = [10, X.SLICE_BYTES + 5, 20, X.SLICE_BYTES // 2, X.SLICE_BYTES // 2, None, 7] + [3] * 100
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes))), "xml": [None if k is None else "x" * k for k in sizes]})
    parts = list(X.slices([docs.slice(0, 0), docs, docs]))
    assert [d for p in parts for d in p["doc_id"]] == [*range(len(sizes))] * 2
    assert max(len(p["doc_id"]) for p in parts) <= X.SLICE_DOCS
    assert max(sum(len(x or "") for x in p["xml"]) for p in parts) <= 2 * X.SLICE_BYTES
    assert [None if x is None else len(x) for p in parts for x in p["xml"]] == sizes * 2
