"""Registered queries (Spark) and their DuckDB oracles.

Each query reads the driver's tables from ``sf_dir`` and runs over them
reference's default threshold 0.75 on lines of ``documents``; 0.3 on the
precomputed ``embeddings`` (0.75 yields no pair there); 0.9 for whole
documents across the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoset.operators.embed import DEFAULT_DIM, explode_sparse, with_hashing_vectors
from echoset.operators.extract import extract_elements
from echoset.operators.pairs import CORNERS, LENGTH_ERROR, POLYTOPES, PROBES, block_pairs, lsh_tables, sparse_pairs
from echoset.plans import oracle as O
from echoset.plans.passages import distinct_vertices, encode_vertices, group_items, group_summary, pair_members
from echoset.session import ensure_checkpoint_dir, ship_package, spread
from echoset.sources.documents import lines_as_xml, read_table

LINE_T = 0.75
EMB_T = 0.3
DOC_T = 0.9
CONV_T = 0.5
DIM = DEFAULT_DIM


def _prep(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` lines wrapped as ``<p>`` elements of one XML document, extracted."""
    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return extract_elements(lines_as_xml(docs))


def _r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# ---------------------------------------------------------------- queries

def q_extract_lines(spark, sf_dir):
    return line_elements(spark, sf_dir).select("doc_id", "semid", "element", "text")


def q_hash_vectors(spark, sf_dir):
    el = line_elements(spark, sf_dir).select("doc_id", "semid", "text")
    v = with_hashing_vectors(el, "text", DIM)
    return explode_sparse(v, ["doc_id", "semid"]).select(
        "doc_id", "semid", "bucket", F.round("weight", 9).alias("weight"))


def _line_vertices(spark, sf_dir):
    el = line_elements(spark, sf_dir)
    # read by the block sizing step and by the pair job: computed once
    return encode_vertices(distinct_vertices(el, ["doc_id"], "semid", "text"), "text", "hashing", DIM).checkpoint(eager=True)


def _line_pairs_out(e):
    return e.select("doc_id", F.col("a").alias("semid_a"), F.col("b").alias("semid_b"), _r6("sim", "similarity"))


def q_line_pairs(spark, sf_dir):
    """Per-document pairs of distinct passages, packed block-matrix job."""
    return _line_pairs_out(block_pairs(_line_vertices(spark, sf_dir), ["doc_id"], LINE_T, vector=None))


def q_line_pairs_prefix(spark, sf_dir):
    """The same pairs from the prefix-filtered inverted index."""
    return _line_pairs_out(sparse_pairs(_line_vertices(spark, sf_dir), ["doc_id"], LINE_T))


def q_line_pair_members(spark, sf_dir):
    """Membership beside ``line_pairs`` and ``line_pairs_prefix``: each position with its first copy, copies and links."""
    verts = _line_vertices(spark, sf_dir)
    pairs = block_pairs(verts, ["doc_id"], LINE_T, vector=None)
    return pair_members(line_elements(spark, sf_dir), verts, pairs, ["doc_id"], "semid", "text", LINE_T)


def line_members(spark, sf_dir, threshold=LINE_T, **kw):
    return group_items(line_elements(spark, sf_dir), ["doc_id"], "semid", threshold, **kw)


def q_line_groups(spark, sf_dir):
    m = line_members(spark, sf_dir)
    return m.select("doc_id", "leader_semid", "semid", "is_leader", _r6("similarity"), "text")


def q_line_groups_exact(spark, sf_dir):
    """Groups at threshold 1.0: passages of equal word counts, copies included."""
    m = line_members(spark, sf_dir, 1.0)
    return m.select("doc_id", "leader_semid", "semid", "is_leader", _r6("similarity"))


def _summary_cols(scope, order):
    return [*scope, f"leader_{order}", "size", _r6("avg_similarity"), _r6("min_similarity"),
            _r6("max_similarity"), _r6("var_similarity"), _r6("iqr_similarity"), _r6("relative_size")]


def q_line_group_summary(spark, sf_dir):
    s = group_summary(line_members(spark, sf_dir), ["doc_id"], "semid")
    return s.select(*_summary_cols(["doc_id"], "semid"))


def _embeddings(spark, sf_dir):
    _prep(spark)
    return spread(read_table(spark, sf_dir, "embeddings"))


def _embedding_vertices(emb):
    return encode_vertices(distinct_vertices(emb, ["label"], "vec_id", "embedding"), "embedding", "precomputed", 0).checkpoint(eager=True)


def q_embedding_pairs(spark, sf_dir):
    e = block_pairs(_embedding_vertices(_embeddings(spark, sf_dir)), ["label"], EMB_T, vector="vector")
    return e.select("label", F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"), _r6("sim", "similarity"))


def q_embedding_pair_members(spark, sf_dir):
    """Membership beside ``embedding_pairs``: each vector with its first copy, copies and links."""
    emb = _embeddings(spark, sf_dir)
    verts = _embedding_vertices(emb)
    pairs = block_pairs(verts, ["label"], EMB_T, vector="vector")
    return pair_members(emb, verts, pairs, ["label"], "vec_id", "embedding", EMB_T)


def q_embedding_groups_label(spark, sf_dir):
    m = group_items(_embeddings(spark, sf_dir), ["label"], "vec_id", EMB_T, text=None, vector="embedding")
    return m.select("label", "leader_vec_id", "vec_id", "is_leader", _r6("similarity"))


def q_embedding_groups_global(spark, sf_dir):
    m = group_items(_embeddings(spark, sf_dir), [], "vec_id", EMB_T, text=None, vector="embedding")
    return m.select("leader_vec_id", "vec_id", "is_leader", _r6("similarity"), "label")


def document_members(spark, sf_dir):
    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return group_items(docs, [], "doc_id", DOC_T, with_text=False)


def q_document_groups_global(spark, sf_dir):
    m = document_members(spark, sf_dir)
    return m.select("leader_doc_id", "doc_id", "is_leader", _r6("similarity"))


def q_conversation_groups(spark, sf_dir):
    _prep(spark)
    conv = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    from echoset.functions.text import normalize_space
    items = conv.select("conv_id", "turn", "role", normalize_space("text").alias("text")).where(F.col("text") != "")
    m = group_items(items, ["conv_id"], "turn", CONV_T)
    return m.select("conv_id", "leader_turn", "turn", "is_leader", _r6("similarity"), "role")


def q_document_outcomes(spark, sf_dir):
    """Status and counts for every document."""
    from echoset.operators.report import document_outcomes

    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    outcomes, _members = document_outcomes(lines_as_xml(docs), "p", LINE_T)
    return outcomes.select("doc_id", "status", "message", "error", "n_texts", "n_groups", "grouped_texts",
                           "removable_texts", "texts_minus_groups", "threshold")


def q_page_outcomes(spark, sf_dir):
    """P4 + O1 on raw web pages read as XML: malformed pages are ERROR rows."""
    from echoset.operators.report import document_outcomes

    _prep(spark)
    pages = spread(read_table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    outcomes, _ = document_outcomes(pages, "p title", LINE_T)
    return outcomes.select("doc_id", "status", "n_texts", "n_groups")


def q_line_max_similarity(spark, sf_dir):
    from echoset.plans.passages import max_similarity_items

    m = max_similarity_items(line_elements(spark, sf_dir), ["doc_id"], "semid")
    return m.select("doc_id", _r6("max_similarity"))


def q_embedding_max_similarity(spark, sf_dir):
    from echoset.plans.passages import max_similarity_items

    m = max_similarity_items(_embeddings(spark, sf_dir), ["label"], "vec_id", text=None, vector="embedding")
    return m.select("label", _r6("max_similarity"))


def q_embedding_pairs_lsh(spark, sf_dir):
    """Approximate pairs (a subset of ``embedding_pairs``)."""
    from echoset.operators.pairs import lsh_pairs

    emb = _embeddings(spark, sf_dir).select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    e = lsh_pairs(emb, ["label"], EMB_T)
    return e.select("label", F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"), _r6("sim", "similarity"))


def q_annotated_lines(spark, sf_dir):
    """Each document with ``cms:semid`` on every ``<p>``."""
    from echoset.operators.extract import annotate_documents

    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return annotate_documents(lines_as_xml(docs), "p").select("doc_id", "annotated_xml", "error")


def q_line_result_documents(spark, sf_dir):
    """S3: the reference's result shape, groups of texts per document."""
    from echoset.operators.report import result_documents

    return result_documents(line_members(spark, sf_dir), ["doc_id"], "semid")


def q_streamed_document_outcomes(spark, sf_dir):
    """O4 + O5: the documents table read as a stream (available-now trigger),
    every micro-batch through the batch plan; returns the latest status per
    document. Must equal ``document_outcomes``.
    """
    import uuid

    from echoset.streaming.stream import latest_status, start_document_stream, text_table_stream

    _prep(spark)
    schema = read_table(spark, sf_dir, "documents").schema
    src = f"{sf_dir}/documents.[p]arquet"  # a glob: the file source watches a folder pattern
    out = f"{ensure_checkpoint_dir(spark)}/stream-out-{uuid.uuid4().hex}"
    q = start_document_stream(text_table_stream(spark, src, schema), out, elements="p", threshold=LINE_T)
    q.awaitTermination()
    runs = spark.read.parquet(f"{out}/runs")
    return latest_status(runs).select("doc_id", "status", "message", "error", "n_texts", "n_groups",
                                      "grouped_texts", "removable_texts", "texts_minus_groups", "threshold")


def q_line_group_report(spark, sf_dir):
    """Per group a 5-text preview, the remaining count and a
    one-word flag, beside the summary scores."""
    from echoset.operators.report import group_previews, multiword_flag

    m = line_members(spark, sf_dir)
    p = group_previews(m, ["doc_id"], "semid")
    f = multiword_flag(m, ["doc_id"], "semid")
    return p.join(f, ["doc_id", "leader_semid"]).select("doc_id", "leader_semid", "size", "preview", "more",
                                                          "all_multiword")


def q_line_group_numbers(spark, sf_dir):
    """Groups numbered in leader order, and their place by score inside the document."""
    from pyspark.sql import Window

    from echoset.plans.passages import number_groups

    s = number_groups(group_summary(line_members(spark, sf_dir), ["doc_id"], "semid"), ["doc_id"], "semid")
    by_score = Window.partitionBy("doc_id").orderBy(F.desc(F.round("avg_similarity", 6)), "leader_semid")
    return s.select("doc_id", "leader_semid", "group_no", F.row_number().over(by_score).alias("score_rank"))


def q_document_group_report_global(spark, sf_dir):
    """W2, W4, R3-R5, R15 for a corpus: scores of each group of whole documents, its number and its place by score."""
    from echoset.plans.passages import number_groups, rank_groups

    s = group_summary(document_members(spark, sf_dir), [], "doc_id")
    s = rank_groups(number_groups(s, [], "doc_id"), [], "doc_id")
    return s.select(*_summary_cols([], "doc_id"), "group_no", "score_rank")


def q_line_group_texts(spark, sf_dir):
    """Distinct texts of each group with all their positions, one-word groups left out."""
    from echoset.functions.text import preview
    from echoset.operators.report import distinct_group_texts, drop_one_word_groups

    m = drop_one_word_groups(line_members(spark, sf_dir), ["doc_id"], "semid")
    return distinct_group_texts(m, ["doc_id"], "semid").withColumn("preview", preview("text"))


def q_request_outcomes(spark, sf_dir):
    """Every document as one request with parameters of its own."""
    from echoset.operators.report import run_requests

    _prep(spark)
    docs = lines_as_xml(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    k = F.col("doc_id") % 10
    requests = docs.select(
        F.col("doc_id").alias("request_id"), (F.col("doc_id") % 100).alias("doc_id"),
        F.when(k == 7, F.lit("\n\t")).when(k == 8, F.lit(None)).otherwise(F.col("xml")).alias("xml"),
        F.when(k == 4, "p.x").when(k == 5, "title%20p").when(k == 6, "title").alias("elements"),
        F.when(k == 9, 1.5).when(k == 1, 0.5).when(k == 2, 1.0).alias("threshold"))
    out, _ = run_requests(requests, outcomes_only=True)
    return out.select("request_id", "doc_id", "status", "message", "error", "n_texts", "n_groups", "grouped_texts",
                      "removable_texts", "texts_minus_groups", "threshold")


def q_embedding_outcomes_by_label(spark, sf_dir):
    """O1 on vectors: labels whose vectors differ in length (a quarter, chosen by a hash) are ERROR, the others complete."""
    from echoset.operators.report import vector_outcomes

    emb = _embeddings(spark, sf_dir)
    mixed = F.conv(F.substring(F.md5(F.col("label").cast("string")), 1, 1), 16, 10).cast("int") < 4
    cut = F.when(mixed & (F.col("vec_id") % 3 == 0), F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vector_outcomes(emb.select("label", "vec_id", cut.alias("embedding")), "label", "vec_id", "embedding", EMB_T)


def q_token_ids(spark, sf_dir):
    """Model inputs of every turn, with the words of ``benchmark`` as vocabulary."""
    from echoset.functions.text import normalize_space
    from echoset.operators.embed import token_ids

    _prep(spark)
    word = F.explode(F.split(F.lower(normalize_space("text")), " ")).alias("token")
    vocab = read_table(spark, sf_dir, "benchmark").select(word).where("token <> ''").distinct().select(
        "token", F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("bigint").alias("id"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize_space("text").alias("text"))
    return token_ids(turns.where("text <> ''"), vocab, key_cols=["conv_id", "turn"]).select(
        "conv_id", "turn", "input_ids", F.size("attention_mask").cast("bigint").alias("n_ids"))


def q_mean_vectors(spark, sf_dir):
    """Each vector's four quarters as token states, averaged and normalised."""
    from echoset.operators.embed import mean_pool

    states = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)]).alias("states")
    pooled = mean_pool(_embeddings(spark, sf_dir).select("vec_id", states), "vec_id")
    return pooled.select("vec_id", F.posexplode("vector").alias("place", "x")).select(
        "vec_id", "place", F.round("x", 6).alias("x"))


def q_element_metadata(spark, sf_dir):
    """Name, position, markup and id of every element of the documents' lines."""
    from echoset.operators.report import element_ids

    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    el = element_ids(extract_elements(lines_as_xml(docs), with_meta=True))
    return el.select("doc_id", "semid", "element", "xpath", "content", "element_id", F.size("attributes").alias("n_attributes"))


def q_document_results(spark, sf_dir):
    """The result document of every document, groups by score."""
    from echoset.operators.report import document_outcomes, full_results

    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    outcomes, members = document_outcomes(lines_as_xml(docs), "p", LINE_T)
    return full_results(outcomes, members, "doc_id", "semid", "run-1")


def q_document_groups_incremental(spark, sf_dir):
    """Corpus groups of ``documents`` that arrive in two halves, the second sent twice."""
    import uuid

    from echoset.plans.store import GroupStore

    _prep(spark)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    store = GroupStore(spark, f"{ensure_checkpoint_dir(spark)}/groups-{uuid.uuid4().hex}", DOC_T)
    middle = docs.approxQuantile("doc_id", [0.5], 0.01)[0]
    store.append(docs.where(F.col("doc_id") <= middle), 0, "doc_id")
    for _ in range(2):
        store.append(docs.where(F.col("doc_id") > middle), 1, "doc_id")
    m = store.members("doc_id")
    return m.select("leader_doc_id", "doc_id", "is_leader", _r6("similarity"))


STORED_T = (0.3, 0.34, 0.4)


def q_embedding_groups_stored(spark, sf_dir):
    """Groups at three thresholds from one pair job, whose edges are kept by similarity."""
    import uuid
    from functools import reduce

    from echoset.plans.store import EdgeStore

    verts = _embedding_vertices(_embeddings(spark, sf_dir))
    store = EdgeStore(spark, f"{ensure_checkpoint_dir(spark)}/edges-{uuid.uuid4().hex}", ["label"])
    store.write(block_pairs(verts, ["label"], min(STORED_T), vector="vector"))
    found = [store.groups(t).withColumn("threshold", F.lit(t)) for t in STORED_T]
    return reduce(DataFrame.unionByName, found).select(
        "threshold", "label", F.col("leader").alias("leader_vec_id"), F.col("member").alias("vec_id"), _r6("sim", "similarity"))


def nested_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, xml``: lines in nested sections with inline children, attributes, comments and a prolog.

    Lines two by two: a section with the first and, nested in it, a section with the
    second. Every tenth document (``doc_id % 10 = 3``) lacks its last end tag.
    """
    from echoset.functions.text import xml_escape

    lines = F.split(xml_escape(F.col("text")), "\n", -1)

    def section(line, i):
        n = i.cast("string")
        even = F.concat(F.lit('<section id="s'), n, F.lit('" kind="even"><p n="'), n, F.lit('">'), line, F.lit(" <b>b"), n,
                        F.lit("</b><!-- a comment --></p>"))
        odd = F.concat(F.lit('<section id="s'), n, F.lit('"><p n="'), n, F.lit('">'), line, F.lit("</p></section></section>"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    xml = F.concat(
        F.lit('<?xml version="1.0"?><doc><title>T <i>'), F.col("doc_id").cast("string"), F.lit("</i></title>"),
        F.array_join(F.transform(lines, section), ""), F.when(F.size(lines) % 2 == 1, F.lit("</section>")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 10 == 3, F.lit("")).otherwise(F.lit("</doc>")))
    return docs.select("doc_id", xml.alias("xml"))


NESTED_LISTS = ("section p", "title  b title")


def q_nested_elements(spark, sf_dir):
    """Two element lists asked of every document, each parsed once into nodes."""
    from echoset.operators.nodes import node_table, select_elements

    _prep(spark)
    docs = nested_documents(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    nodes = node_table(docs).checkpoint(eager=True)
    asked = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, NESTED_LISTS))).alias("k", "elements"))
    found = select_elements(nodes, asked.select((F.col("doc_id") * 2 + F.col("k")).alias("request_id"), "doc_id", "elements"))
    return found.select("request_id", "doc_id", "semid", "element", "text", F.col("path").alias("xpath"), "level",
                        F.size("attributes").alias("n_attributes"), F.col("attributes")["id"].alias("id"))


def q_nested_outcomes(spark, sf_dir):
    """Outcomes of the nested documents; every tenth is malformed and an ERROR row."""
    from echoset.operators.report import run_requests

    _prep(spark)
    docs = nested_documents(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    out, _ = run_requests(docs.select(F.col("doc_id").alias("request_id"), "doc_id", "xml", F.lit("section p").alias("elements")), outcomes_only=True)
    return out.select("doc_id", "status", F.col("error").startswith("malformed XML").alias("malformed"), "n_texts", "n_groups", "grouped_texts")


def q_annotated_nested(spark, sf_dir):
    """X6, R13 on nested documents with attributes, comments and a prolog; none for a malformed one."""
    from echoset.operators.extract import annotate_documents

    _prep(spark)
    docs = nested_documents(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return annotate_documents(docs, "section p").select("doc_id", "annotated_xml", F.col("error").isNotNull().alias("malformed"))


def _scratch(spark, name):
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_file_elements(spark, sf_dir):
    """Every document written as an XML file of its own, the files read whole and extracted."""
    from echoset.sources.documents import read_xml_files, write_document_files

    _prep(spark)
    folder = _scratch(spark, "xml")
    if not write_document_files(lines_as_xml(read_table(spark, sf_dir, "documents").select("doc_id", "text")), folder):
        return extract_elements(spark.createDataFrame([], "doc_id bigint, xml string")).select("doc_id", "semid", "element", "text")
    files = read_xml_files(spark, f"{folder}/*").withColumn(
        "doc_id", F.regexp_extract("doc_id", r"doc_id=(-?\d+)", 1).cast("bigint"))
    return extract_elements(files).select("doc_id", "semid", "element", "text")


def q_vocabulary_token_ids(spark, sf_dir):
    """Model inputs of every document, cut at 510 words, with a vocabulary read from a file."""
    from echoset.functions.text import normalize_space
    from echoset.operators.embed import token_ids
    from echoset.sources.documents import read_vocab

    _prep(spark)
    folder = _scratch(spark, "vocab")
    word = F.explode(F.split(F.lower(normalize_space("text")), " ")).alias("token")
    read_table(spark, sf_dir, "benchmark").select(word).where("token <> ''").distinct().coalesce(1).sortWithinPartitions("token").write.text(folder)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", normalize_space("text").alias("text"))).where("text <> ''")
    return token_ids(docs, read_vocab(spark, f"{folder}/*.txt"), max_words=510, key_cols=["doc_id"]).select(
        "doc_id", "input_ids", F.size("attention_mask").cast("bigint").alias("n_ids"))


def q_line_groups_csv(spark, sf_dir):
    """The grouped passages written as CSV and read back."""
    from echoset.operators.report import read_csv, write_csv

    _prep(spark)
    path = _scratch(spark, "csv")
    write_csv(q_line_groups(spark, sf_dir), path)
    return read_csv(spark, path, "doc_id bigint, leader_semid int, semid int, is_leader boolean, similarity double, text string")


RUN_CREATED = {"en": "10:00:00", "fr": "10:30:00", "de": "11:00:00", "es": "09:59:59.999"}


def q_live_run_groups(spark, sf_dir):
    """One run a language, each saved twice, looked up by run id while it lives (as of 11:00, 60 minutes)."""
    from echoset.operators.report import live_runs, load_run, save_run

    _prep(spark)
    path = _scratch(spark, "runs")
    lang = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    members = line_members(spark, sf_dir).join(lang, "doc_id").select("doc_id", "leader_semid", "semid", "lang").checkpoint(eager=True)
    for run in [*RUN_CREATED, "en"]:  # a run saved again replaces itself
        save_run(members.where(F.col("lang") == run).drop("lang"), path, run)
    runs = spark.createDataFrame(list(RUN_CREATED.items()), "run_id string, clock string").select(
        "run_id", F.to_timestamp(F.concat(F.lit("2024-05-01 "), "clock")).alias("created_at"))
    live = live_runs(runs, "2024-05-01 11:00:00").join(load_run(spark, path, "en").unionByName(load_run(spark, path, "es")).unionByName(
        load_run(spark, path, "fr")).unionByName(load_run(spark, path, "absent")), "run_id")
    return live.select("run_id", "doc_id", "leader_semid", "semid")


STATUS_CHUNKS = 4


def q_streamed_run_states(spark, sf_dir):
    """O1, O3, O5 by creation time: a stream of PROCESSING and final events, some of them a chunk late.

    Documents are created half an hour apart; every seventh document's outcome arrives with the next chunk
    of events, when most such runs have expired.
    """
    from echoset.streaming.stream import run_states, start_status_stream

    _prep(spark)
    folder, out = _scratch(spark, "events"), _scratch(spark, "states")
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    created = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 1800)
    chunk = F.floor((F.col("doc_id") - low) * STATUS_CHUNKS / (high - low + 1)).cast("int")
    begun = docs.select("doc_id", F.lit("PROCESSING").alias("status"), F.lit(0).alias("n_groups"), created.alias("created_at"),
                        created.alias("at"), chunk.alias("chunk"))
    ended = docs.select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "ERROR").otherwise("COMPLETED").alias("status"), (F.col("doc_id") % 3).cast("int").alias("n_groups"),
        created.alias("created_at"), (created + F.expr("INTERVAL 10 MINUTES")).alias("at"),
        (chunk + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("chunk"))
    events = begun.unionByName(ended).checkpoint(eager=True)
    for k in range(STATUS_CHUNKS + 1):  # a file a chunk, in order
        events.where(F.col("chunk") == k).drop("chunk").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("doc_id bigint, status string, n_groups int, created_at timestamp, at timestamp").option(
        "maxFilesPerTrigger", 1).parquet(folder)
    start_status_stream(stream, out).awaitTermination()
    return run_states(spark.read.parquet(out)).select(
        "doc_id", "status", "n_groups", F.unix_seconds("created_at").alias("created"), "expired")


QUERIES = {
    "extract_lines": q_extract_lines,
    "hash_vectors": q_hash_vectors,
    "line_pairs": q_line_pairs,
    "line_pairs_prefix": q_line_pairs_prefix,
    "line_pair_members": q_line_pair_members,
    "line_groups": q_line_groups,
    "line_groups_exact": q_line_groups_exact,
    "line_group_summary": q_line_group_summary,
    "embedding_pairs": q_embedding_pairs,
    "embedding_pair_members": q_embedding_pair_members,
    "embedding_groups_label": q_embedding_groups_label,
    "embedding_groups_global": q_embedding_groups_global,
    "document_groups_global": q_document_groups_global,
    "document_group_report_global": q_document_group_report_global,
    "document_groups_incremental": q_document_groups_incremental,
    "embedding_groups_stored": q_embedding_groups_stored,
    "nested_elements": q_nested_elements,
    "nested_outcomes": q_nested_outcomes,
    "annotated_nested": q_annotated_nested,
    "file_elements": q_file_elements,
    "vocabulary_token_ids": q_vocabulary_token_ids,
    "line_groups_csv": q_line_groups_csv,
    "live_run_groups": q_live_run_groups,
    "streamed_run_states": q_streamed_run_states,
    "conversation_groups": q_conversation_groups,
    "document_outcomes": q_document_outcomes,
    "page_outcomes": q_page_outcomes,
    "line_max_similarity": q_line_max_similarity,
    "embedding_max_similarity": q_embedding_max_similarity,
    "embedding_pairs_lsh": q_embedding_pairs_lsh,
    "annotated_lines": q_annotated_lines,
    "line_result_documents": q_line_result_documents,
    "streamed_document_outcomes": q_streamed_document_outcomes,
    "line_group_report": q_line_group_report,
    "line_group_numbers": q_line_group_numbers,
    "line_group_texts": q_line_group_texts,
    "request_outcomes": q_request_outcomes,
    "embedding_outcomes_by_label": q_embedding_outcomes_by_label,
    "token_ids": q_token_ids,
    "element_metadata": q_element_metadata,
    "document_results": q_document_results,
    "mean_vectors": q_mean_vectors,
}


# ---------------------------------------------------------------- oracles

def _groups_sql(scope, order, threshold, items_ctes, src="items", with_text=True, extra=(), dim=DIM):
    return O.with_clause(*items_ctes, O.hashed(scope, order, dim, src), O.sparse_edges(scope, threshold),
                         O.greedy(scope), O.members_cte(scope, order, with_text, src, extra))


def _summary_sql(scope, order):
    s = ", ".join(scope)
    return f"""
SELECT *, round(size / max(size) OVER (PARTITION BY {s}), 6) AS relative_size FROM (
  SELECT {s}, leader_{order}, count(*) AS size,
         round(avg(sim), 6) AS avg_similarity, round(min(sim), 6) AS min_similarity,
         round(max(sim), 6) AS max_similarity, round(var_pop(sim), 6) AS var_similarity,
         round(quantile_cont(sim, 0.75) - quantile_cont(sim, 0.25), 6) AS iqr_similarity
  FROM members GROUP BY {s}, leader_{order})"""


LINES = O.lines_items()
DEDUP_LINES = "dverts AS (SELECT doc_id, text, min(semid) AS semid FROM items GROUP BY ALL)"
EMB_G = "emb AS (SELECT 1 AS _g, vec_id, label, embedding FROM embeddings)"
DOCS_G = r"""docs AS (SELECT 1 AS _g, doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text
  FROM documents WHERE text IS NOT NULL)"""
CONV = r"""conv AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text
  FROM conversations WHERE trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) <> '')"""


def _emb_groups(scope, src_cte, src, extra):
    return O.with_clause(src_cte, O.dense_edges(scope, "vec_id", "embedding", EMB_T, src), O.greedy(scope),
                         O.members_cte(scope, "vec_id", False, src, extra))


ORACLES = {
    "extract_lines": O.with_clause(LINES) + "\nSELECT doc_id, semid, 'p' AS element, text FROM items",
    "hash_vectors": O.with_clause(LINES, O.hashed(["doc_id"], "semid", DIM))
    + "\nSELECT doc_id, pos AS semid, bucket, round(w, 9) AS weight FROM wf",
    "line_pairs": O.with_clause(LINES, DEDUP_LINES, O.hashed(["doc_id"], "semid", DIM, "dverts"),
                                O.sparse_edges(["doc_id"], LINE_T))
    + "\nSELECT doc_id, a AS semid_a, b AS semid_b, round(sim, 6) AS similarity FROM edges",
    "line_pairs_prefix": O.with_clause(LINES, DEDUP_LINES, O.hashed(["doc_id"], "semid", DIM, "dverts"),
                                       O.sparse_edges(["doc_id"], LINE_T))
    + "\nSELECT doc_id, a AS semid_a, b AS semid_b, round(sim, 6) AS similarity FROM edges",
    "line_groups": _groups_sql(["doc_id"], "semid", LINE_T, [LINES])
    + "\nSELECT doc_id, leader_semid, semid, is_leader, round(sim, 6) AS similarity, text FROM members",
    "line_groups_exact": _groups_sql(["doc_id"], "semid", 1.0, [LINES], with_text=False)
    + "\nSELECT doc_id, leader_semid, semid, is_leader, round(sim, 6) AS similarity FROM members",
    "line_group_summary": _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + _summary_sql(["doc_id"], "semid"),
    "embedding_pairs": O.with_clause(O.dense_edges(["label"], "vec_id", "embedding", EMB_T, "embeddings"))
    + "\nSELECT label, a AS vec_id_a, b AS vec_id_b, round(sim, 6) AS similarity FROM edges",
    "embedding_groups_label": _emb_groups(["label"], "emb AS (SELECT * FROM embeddings)", "emb", ())
    + "\nSELECT label, leader_vec_id, vec_id, is_leader, round(sim, 6) AS similarity FROM members",
    "embedding_groups_global": _emb_groups(["_g"], EMB_G, "emb", ("label",))
    + "\nSELECT leader_vec_id, vec_id, is_leader, round(sim, 6) AS similarity, label FROM members",
    "document_groups_global": _groups_sql(["_g"], "doc_id", DOC_T, [DOCS_G], "docs", False)
    + "\nSELECT leader_doc_id, doc_id, is_leader, round(sim, 6) AS similarity FROM members",
    "conversation_groups": _groups_sql(["conv_id"], "turn", CONV_T, [CONV], "conv", False, ("role",))
    + "\nSELECT conv_id, leader_turn, turn, is_leader, round(sim, 6) AS similarity, role FROM members",
}


def _outcomes_sql() -> str:
    from echoset.operators.report import ERR_NO_TEXT, MSG_GROUPS, MSG_NO_GROUPS, MSG_NO_TEXT

    q = lambda x: "'" + x.replace("'", "''") + "'"
    return _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + f""",
per_doc AS (SELECT d.doc_id, count(i.semid) AS n_texts FROM documents d LEFT JOIN items i USING (doc_id) GROUP BY d.doc_id),
grouped AS (SELECT doc_id, count(*) FILTER (WHERE is_leader) AS n_groups, count(*) AS grouped_texts FROM members GROUP BY doc_id),
o AS (
  SELECT p.doc_id, p.n_texts, coalesce(g.n_groups, 0) AS n_groups, coalesce(g.grouped_texts, 0) AS grouped_texts,
         CASE WHEN p.n_texts = 0 THEN 'NO_TEXT_EXTRACTED' ELSE 'COMPLETED' END AS status
  FROM per_doc p LEFT JOIN grouped g USING (doc_id)
)
SELECT doc_id, status,
       CASE WHEN status = 'NO_TEXT_EXTRACTED' THEN {q(MSG_NO_TEXT)}
            WHEN n_groups > 0 THEN {q(MSG_GROUPS)} ELSE {q(MSG_NO_GROUPS)} END AS message,
       CASE WHEN status = 'NO_TEXT_EXTRACTED' THEN {q(ERR_NO_TEXT)} END AS error,
       n_texts, n_groups, grouped_texts, grouped_texts - n_groups AS removable_texts,
       n_texts - n_groups AS texts_minus_groups, {LINE_T} AS threshold
FROM o"""


ORACLES["document_outcomes"] = _outcomes_sql()
ORACLES["streamed_document_outcomes"] = ORACLES["document_outcomes"]
ORACLES["line_max_similarity"] = O.with_clause(LINES, O.hashed(["doc_id"], "semid", DIM)) + """,
pairmax AS (
  SELECT x.doc_id, x.pos AS a, y.pos AS b, sum(x.c * y.c) / sqrt(any_value(x.sq) * any_value(y.sq)) AS sim
  FROM wf x JOIN wf y ON x.doc_id = y.doc_id AND x.bucket = y.bucket AND x.pos < y.pos GROUP BY ALL
),
multi AS (SELECT doc_id FROM items GROUP BY doc_id HAVING count(*) >= 2)
SELECT m.doc_id, round(coalesce(max(p.sim), 0.0), 6) AS max_similarity
FROM multi m LEFT JOIN pairmax p USING (doc_id) GROUP BY m.doc_id"""
ORACLES["embedding_max_similarity"] = """
WITH vecs AS (SELECT label, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.label, round(max(list_cosine_similarity(x.v, y.v)), 6) AS max_similarity
FROM vecs x JOIN vecs y ON x.label = y.label AND x.pos < y.pos GROUP BY x.label"""
ORACLES["line_result_documents"] = _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + """,
g AS (SELECT doc_id, leader_semid, list(text ORDER BY (NOT is_leader), semid) AS texts FROM members GROUP BY ALL)
SELECT doc_id, list(texts ORDER BY leader_semid) AS similarity_groups FROM g GROUP BY doc_id"""
ORACLES["line_group_report"] = _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + """,
ordered AS (
  SELECT doc_id, leader_semid, count(*) AS size,
         list(CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 20) || '...' END
              ORDER BY (NOT is_leader), semid) AS texts,
         bool_and(len(string_split(text, ' ')) > 1) AS all_multiword
  FROM members GROUP BY ALL
)
SELECT doc_id, leader_semid, size, texts[1:5] AS preview, greatest(size - 5, 0) AS more, all_multiword FROM ordered"""
ORACLES["annotated_lines"] = r"""
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k
  FROM documents
)
SELECT doc_id,
       '<doc>' || string_agg(
         '<p cms:semid="' || k || '">' || replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
           '"', '&quot;'), chr(39), '&apos;') || '</p>', '' ORDER BY k) || '</doc>' AS annotated_xml,
       CAST(NULL AS VARCHAR) AS error
FROM raw_lines GROUP BY doc_id"""
ORACLES["line_group_numbers"] = _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + """
SELECT doc_id, leader_semid, row_number() OVER (PARTITION BY doc_id ORDER BY leader_semid) AS group_no,
       row_number() OVER (PARTITION BY doc_id ORDER BY avg_sim DESC, leader_semid) AS score_rank
FROM (SELECT doc_id, leader_semid, round(avg(sim), 6) AS avg_sim FROM members GROUP BY ALL)"""
ORACLES["document_group_report_global"] = _groups_sql(["_g"], "doc_id", DOC_T, [DOCS_G], "docs", False) + f"""
SELECT * EXCLUDE (_g), row_number() OVER (ORDER BY leader_doc_id) AS group_no,
       row_number() OVER (ORDER BY avg_similarity DESC, leader_doc_id) AS score_rank FROM ({_summary_sql(["_g"], "doc_id")})"""
ORACLES["line_group_texts"] = _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + """,
short AS (SELECT DISTINCT doc_id, leader_semid FROM members WHERE NOT contains(text, ' '))
SELECT doc_id, leader_semid, text, min(semid) AS first, list(semid ORDER BY semid) AS positions, count(*) AS copies,
       substr(text, 1, 20) || '...' AS preview
FROM members m ANTI JOIN short USING (doc_id, leader_semid) GROUP BY doc_id, leader_semid, text"""
_VECTOR_OUTCOMES = _emb_groups(
    ["label"], """cut AS (SELECT label, vec_id, CASE WHEN vec_id % 97 = 0 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings),
bad AS (SELECT label FROM cut GROUP BY label HAVING min(len(embedding)) <> max(len(embedding))),
emb AS (SELECT * FROM cut WHERE label NOT IN (SELECT label FROM bad))""", "emb", ()) + f""",
g AS (SELECT label, count(*) FILTER (WHERE is_leader) AS n_groups, count(*) AS grouped_texts FROM members GROUP BY label)
SELECT c.label, CASE WHEN any_value(b.label) IS NULL THEN 'COMPLETED' ELSE 'ERROR' END AS status,
       CASE WHEN any_value(b.label) IS NOT NULL THEN '{LENGTH_ERROR}' END AS error, count(*) AS n_texts,
       coalesce(any_value(g.n_groups), 0) AS n_groups, coalesce(any_value(g.grouped_texts), 0) AS grouped_texts
FROM cut c LEFT JOIN bad b USING (label) LEFT JOIN g USING (label) GROUP BY c.label"""
ORACLES["embedding_outcomes_by_label"] = _VECTOR_OUTCOMES.replace(
    "vec_id % 97 = 0", "('0x' || substr(md5(label::VARCHAR), 1, 1))::INTEGER < 4 AND vec_id % 3 = 0")
ORACLES["token_ids"] = r"""
WITH vocab AS (SELECT token, ('0x' || substr(md5(token), 1, 7))::BIGINT AS id FROM (
       SELECT DISTINCT unnest(string_split(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), ' ')) AS token FROM benchmark) WHERE token <> ''),
t AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text FROM conversations),
w AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS word, generate_subscripts(string_split_regex(text, '\s+'), 1) AS pos
      FROM t WHERE text <> '')
SELECT conv_id, turn, list_concat(list_concat([101::BIGINT], list(coalesce(id, 100) ORDER BY pos)), [102::BIGINT]) AS input_ids,
       count(*) + 2 AS n_ids
FROM w LEFT JOIN vocab ON lower(word) = token GROUP BY conv_id, turn"""
ORACLES["mean_vectors"] = """
WITH p AS (SELECT vec_id, i AS place, (embedding[i + 1]::DOUBLE + embedding[i + 17]::DOUBLE + embedding[i + 33]::DOUBLE + embedding[i + 49]::DOUBLE) / 4 AS m
           FROM embeddings, range(16) t(i))
SELECT vec_id, CAST(place AS INTEGER) AS place, round(m / sqrt(sum(m * m) OVER (PARTITION BY vec_id)), 6) AS x FROM p"""


def _requests_sql() -> str:
    """Each document as a request: parameters from its id, groups at its own threshold."""
    from echoset.operators.report import (ERR_NO_TEXT, MSG_BAD_ELEMENTS, MSG_BAD_THRESHOLD, MSG_EMPTY_XML, MSG_GROUPS,
                                          MSG_NO_GROUPS, MSG_NO_TEXT, MSG_NO_XML)

    q = lambda x: "'" + x.replace("'", "''") + "'"
    own_t = "CASE doc_id % 10 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.75 END"
    items = LINES + ",\nasked AS (SELECT * FROM items WHERE doc_id % 10 IN (0, 1, 2, 3, 5))"
    pairs = O.sparse_edges(["doc_id"], 0.5).replace("edges AS (", "all_edges AS (")
    kept = f"edges AS (SELECT * FROM all_edges WHERE sim >= {own_t})"
    return O.with_clause(items, O.hashed(["doc_id"], "semid", DIM, "asked"), pairs, kept, O.greedy(["doc_id"]),
                         O.members_cte(["doc_id"], "semid", False, "asked")) + f""",
n AS (SELECT doc_id, count(*) AS n_texts FROM asked GROUP BY doc_id),
g AS (SELECT doc_id, count(*) FILTER (WHERE is_leader) AS n_groups, count(*) AS grouped_texts FROM members GROUP BY doc_id),
c AS (
  SELECT d.doc_id, coalesce(n_texts, 0) AS n_texts, coalesce(n_groups, 0) AS n_groups, coalesce(grouped_texts, 0) AS grouped_texts,
         CASE d.doc_id % 10 WHEN 4 THEN {q(MSG_BAD_ELEMENTS)} WHEN 9 THEN {q(MSG_BAD_THRESHOLD)} WHEN 7 THEN {q(MSG_EMPTY_XML)}
                            WHEN 8 THEN {q(MSG_NO_XML)} END AS bad
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
)
SELECT doc_id AS request_id, doc_id % 100 AS doc_id,
       CASE WHEN bad IS NOT NULL THEN 'ERROR' WHEN n_texts = 0 THEN 'NO_TEXT_EXTRACTED' ELSE 'COMPLETED' END AS status,
       CASE WHEN bad IS NOT NULL THEN bad WHEN n_texts = 0 THEN {q(MSG_NO_TEXT)} WHEN n_groups > 0 THEN {q(MSG_GROUPS)} ELSE {q(MSG_NO_GROUPS)} END AS message,
       CASE WHEN bad IS NOT NULL THEN bad WHEN n_texts = 0 THEN {q(ERR_NO_TEXT)} END AS error,
       n_texts, n_groups, grouped_texts, grouped_texts - n_groups AS removable_texts, n_texts - n_groups AS texts_minus_groups,
       (CASE doc_id % 10 WHEN 9 THEN 1.5 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.75 END)::DOUBLE AS threshold
FROM c"""


ORACLES["request_outcomes"] = _requests_sql()
ORACLES["element_metadata"] = O.with_clause(LINES) + r"""
SELECT i.doc_id, i.semid, 'p' AS element, '/doc[1]/p[' || i.semid || ']' AS xpath,
       '<p>' || replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')
         || '</p>' AS content,
       sha256(i.doc_id || ':' || i.semid) AS element_id, 0 AS n_attributes
FROM items i JOIN raw_lines r ON i.doc_id = r.doc_id AND i.semid = r.semid"""
ORACLES["document_results"] = ORACLES["document_outcomes"].replace("\nSELECT doc_id, status,", """,
gt AS (SELECT doc_id, leader_semid, round(avg(sim), 6) AS score, list(text ORDER BY (NOT is_leader), semid) AS texts FROM members GROUP BY ALL),
gl AS (SELECT doc_id, list(texts ORDER BY score DESC, leader_semid) AS similarity_groups FROM gt GROUP BY doc_id),
whole AS (SELECT doc_id, status,""", 1) + """)
SELECT doc_id, 'run-1' AS run_id, status, message, error, n_groups, removable_texts, coalesce(similarity_groups, []) AS similarity_groups
FROM whole LEFT JOIN gl USING (doc_id)"""
def _pair_members_sql(scope, order, content, src, *ctes):
    """Membership from uncollapsed items and all their edges."""
    return O.with_clause(*ctes) + f""",
ends AS (SELECT {scope}, a AS pos FROM edges UNION ALL SELECT {scope}, b AS pos FROM edges),
linked AS (SELECT {scope}, pos, count(*) AS links FROM ends GROUP BY ALL)
SELECT i.{scope}, i.{order}, min(i.{order}) OVER same AS first_{order}, count(*) OVER same AS copies, coalesce(l.links, 0) AS links
FROM {src} i LEFT JOIN linked l ON i.{scope} = l.{scope} AND i.{order} = l.pos
WINDOW same AS (PARTITION BY i.{scope}, i.{content})"""


ORACLES["line_pair_members"] = _pair_members_sql(
    "doc_id", "semid", "text", "items", LINES, O.hashed(["doc_id"], "semid", DIM), O.sparse_edges(["doc_id"], LINE_T))
ORACLES["embedding_pair_members"] = _pair_members_sql(
    "label", "vec_id", "embedding", "embeddings", O.dense_edges(["label"], "vec_id", "embedding", EMB_T, "embeddings"))
ORACLES["embedding_pairs_lsh"] = f"""
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT t, p, c, list(CASE WHEN ('0x' || substr(md5('7:' || t || ':' || p || ':' || c || ':' || i), 1, 1))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END ORDER BY i) AS sign
      FROM range({lsh_tables(EMB_T)}) q(t), range({POLYTOPES}) r(p), range({CORNERS}) u(c), range(64) w(i) GROUP BY ALL),
y AS (SELECT label, vec_id, t, p, c, list_inner_product(x, sign) AS y FROM v, s),
n AS (SELECT label, vec_id, t, p, 2 * c + (y > 0)::INTEGER AS corner FROM y
      QUALIFY row_number() OVER (PARTITION BY label, vec_id, t, p ORDER BY abs(y) DESC, c) <= {PROBES}),
k AS (SELECT g.label, g.vec_id, g.t, g.corner * 1000 + h.corner AS sides FROM n g JOIN n h
      ON g.label = h.label AND g.vec_id = h.vec_id AND g.t = h.t AND g.p = 0 AND h.p = 1),
met AS (SELECT DISTINCT x.label, x.vec_id AS a, y.vec_id AS b FROM k x JOIN k y
        ON x.label = y.label AND x.t = y.t AND x.sides = y.sides AND x.vec_id < y.vec_id)
SELECT m.label, a AS vec_id_a, b AS vec_id_b, round(list_cosine_similarity(x.x, y.x), 6) AS similarity
FROM met m JOIN v x ON m.label = x.label AND m.a = x.vec_id JOIN v y ON m.label = y.label AND m.b = y.vec_id
WHERE list_cosine_similarity(x.x, y.x) >= {EMB_T}"""


ORACLES["document_groups_incremental"] = ORACLES["document_groups_global"]
ORACLES["embedding_groups_stored"] = "\nUNION ALL\n".join(
    "SELECT * FROM (" + O.with_clause(O.dense_edges(["label"], "vec_id", "embedding", t, "embeddings"), O.greedy(["label"]))
    + f"\nSELECT {t}::DOUBLE AS threshold, label, leader AS leader_vec_id, member AS vec_id, round(sim, 6) AS similarity FROM assign)"
    for t in STORED_T)
_NORM = lambda x: f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"
_NESTED = r"""
nl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
              len(string_split(text, chr(10))) AS n FROM documents),
np AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM nl)"""
_NESTED_MATCHES = f"""{_NESTED},
nm AS (
  SELECT doc_id, i, 2 * i + 1 AS semid, 'section' AS element, 's' || i AS id, i % 2 + 2 AS level, 2 - i % 2 AS n_attributes,
         {_NORM("CASE WHEN i % 2 = 0 THEN line || ' b' || i || coalesce(below, '') ELSE line END")} AS text,
         '/doc[1]/section[' || (i // 2 + 1) || ']' || CASE WHEN i % 2 = 1 THEN '/section[1]' ELSE '' END AS xpath FROM np
  UNION ALL
  SELECT doc_id, i, 2 * i + 2, 'p', NULL, i % 2 + 3, 1, {_NORM("CASE WHEN i % 2 = 0 THEN line || ' b' || i ELSE line END")},
         '/doc[1]/section[' || (i // 2 + 1) || ']' || CASE WHEN i % 2 = 1 THEN '/section[1]' ELSE '' END || '/p[1]' FROM np)"""
ORACLES["nested_elements"] = "WITH " + _NESTED_MATCHES + """,
other AS (
  SELECT doc_id, 1 AS semid, 'title' AS element, 'T ' || doc_id AS text, '/doc[1]/title[1]' AS xpath, 2 AS level FROM documents
  UNION ALL SELECT doc_id, i // 2 + 2, 'b', 'b' || i, '/doc[1]/section[' || (i // 2 + 1) || ']/p[1]/b[1]', 4 FROM nl WHERE i % 2 = 0)
SELECT * FROM (
  SELECT doc_id * 2 AS request_id, doc_id, semid::INTEGER AS semid, element, text, xpath, level::INTEGER AS level, n_attributes::INTEGER AS n_attributes, id FROM nm
  UNION ALL SELECT doc_id * 2 + 1, doc_id, semid::INTEGER, element, text, xpath, level, 0, NULL FROM other)
WHERE text <> '' AND doc_id % 10 <> 3"""
ORACLES["nested_outcomes"] = O.with_clause(
    _NESTED_MATCHES, "items AS (SELECT doc_id, semid::INTEGER AS semid, text FROM nm WHERE text <> '' AND doc_id % 10 <> 3)",
    O.hashed(["doc_id"], "semid", DIM), O.sparse_edges(["doc_id"], LINE_T), O.greedy(["doc_id"]),
    O.members_cte(["doc_id"], "semid", False)) + """,
t AS (SELECT doc_id, count(*) AS n_texts FROM items GROUP BY doc_id),
g AS (SELECT doc_id, count(*) FILTER (WHERE is_leader) AS n_groups, count(*) AS grouped_texts FROM members GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 3 THEN 'ERROR' WHEN n_texts IS NULL THEN 'NO_TEXT_EXTRACTED' ELSE 'COMPLETED' END AS status,
       CASE WHEN d.doc_id % 10 = 3 THEN true WHEN n_texts IS NULL THEN false END AS malformed,
       coalesce(n_texts, 0) AS n_texts, coalesce(n_groups, 0) AS n_groups, coalesce(grouped_texts, 0) AS grouped_texts
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)"""
ORACLES["annotated_nested"] = "WITH " + _NESTED + """,
e AS (SELECT *, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS safe FROM nl),
x AS (SELECT doc_id, any_value(n) AS n, string_agg(
        '<section cms:semid="' || (2 * i + 1) || '" id="s' || i || CASE WHEN i % 2 = 0 THEN '" kind="even' ELSE '' END
        || '"><p cms:semid="' || (2 * i + 2) || '" n="' || i || '">' || safe
        || CASE WHEN i % 2 = 0 THEN ' <b>b' || i || '</b><!-- a comment --></p>' ELSE '</p></section></section>' END, '' ORDER BY i) AS body
      FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN '<?xml version="1.0"?><doc><title>T <i>' || doc_id || '</i></title>' || body
         || CASE WHEN n % 2 = 1 THEN '</section>' ELSE '' END || '</doc>' END AS annotated_xml, doc_id % 10 = 3 AS malformed
FROM x"""
ORACLES["file_elements"] = ORACLES["extract_lines"]
ORACLES["line_groups_csv"] = ORACLES["line_groups"]
ORACLES["vocabulary_token_ids"] = r"""
WITH vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (
       SELECT DISTINCT unnest(string_split(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), ' ')) AS token FROM benchmark) WHERE token <> ''),
t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '\s+')[1:510] AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t WHERE words <> [''])
SELECT doc_id, list_concat(list_concat([101::BIGINT], list(coalesce(id, 100) ORDER BY pos)), [102::BIGINT]) AS input_ids, count(*) + 2 AS n_ids
FROM w LEFT JOIN vocab ON lower(word) = token GROUP BY doc_id"""
ORACLES["live_run_groups"] = _groups_sql(["doc_id"], "semid", LINE_T, [LINES]) + """
SELECT d.lang AS run_id, m.doc_id, leader_semid, semid FROM members m JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'fr')"""
ORACLES["streamed_run_states"] = f"""
WITH d AS (SELECT doc_id, 1704067200 + doc_id * 1800 AS created,
                  ((doc_id - min(doc_id) OVER ()) * {STATUS_CHUNKS} // (max(doc_id) OVER () - min(doc_id) OVER () + 1))::INTEGER AS k FROM documents),
e AS (SELECT k, created AS moment FROM d UNION ALL SELECT k + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END, created + 600 FROM d),
mark AS (SELECT b.k, max(moment) - 10800 AS watermark FROM (SELECT DISTINCT k FROM e) b JOIN e ON e.k <= b.k GROUP BY b.k),
last AS (SELECT max(watermark) AS watermark FROM mark),
s AS (SELECT d.*, doc_id % 7 = 0 AND created + 3600 < m.watermark AS missed, created + 3600 < l.watermark AS expired
      FROM d JOIN mark m ON m.k = d.k, last l)
SELECT doc_id, CASE WHEN missed THEN 'PROCESSING' WHEN doc_id % 5 = 0 THEN 'ERROR' ELSE 'COMPLETED' END AS status,
       CASE WHEN missed THEN 0 ELSE doc_id % 3 END AS n_groups, created, expired FROM s"""
