"""Validation, per-document outcomes, expiry and result shapes.

P1-P3, P6, P7  :func:`validate_documents` — one ``error`` per row instead of
               failing the job.
O1, O2, A1-A4,
R8, R9, R15    :func:`document_outcomes` — status, message and counts for every
               document, from one parse of each document.
O3             :func:`live_runs` — expiry with an explicit ``as_of`` instant.
S3             :func:`result_documents` — the reference's result document
               (``similarity_groups`` as arrays of texts) per scope.
S4-S6          :func:`save_run`, :func:`load_run` — tables partitioned by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoset.functions.text import has_text, normalize_space
from echoset.operators.extract import parse_documents
from echoset.plans.passages import group_items, vector_length_errors
from echoset.session import Scratch, drop_folder, let_go
from echoset.sources.documents import DEFAULT_ELEMENTS, DEFAULT_THRESHOLD

# Fixed values of the reference (request checks and result messages), verbatim.
ELEMENTS_PATTERN = r"\A[a-zA-Z_][a-zA-Z0-9_-]*(\s+[a-zA-Z_][a-zA-Z0-9_-]*)*\z"
MSG_BAD_ELEMENTS = "Elements parameter should be a space separated string of valid XML elements."
MSG_BAD_THRESHOLD = "Threshold must be between 0.0 and 1.0."
MSG_NO_XML = "xmlContent was not provided in request body."
MSG_EMPTY_XML = "XML content is empty or invalid"
MSG_PROCESSING = "Processing in progress. Please try again later."
MSG_ERROR = "An error occurred during processing."
MSG_NO_TEXT = ("No embeddings were generated. This may be because no matching elements were found in your XML. "
               "The default element is 'p'. If your XML uses different elements, please specify them using the "
               "'elements' query parameter, for example: /api/similarity?elements=paragraph")
ERR_NO_TEXT = "No sentences found in XML. Revise elements query parameter or check data."
MSG_GROUPS = "Processing completed. Similarity groups are available."
MSG_NO_GROUPS = "Processing completed but no similarity groups were created for this session."
# Own wording: causes the reference does not name.
MSG_BAD_ENCODING = "Elements parameter is not valid URL encoding."
STATUSES = ("PROCESSING", "COMPLETED", "ERROR", "NO_TEXT_EXTRACTED")
RUN_TTL_MINUTES = 60


def validate_documents(docs: DataFrame, elements_col: str | None = "elements",
                       threshold_col: str | None = "threshold") -> DataFrame:
    """P1-P3, P6, P7 as columns: ``elements``, ``threshold``, ``error`` (null when valid).

    The element list is URL-decoded once (``try_url_decode``: a bad escape is
    an error, not a failed job), defaulted to ``p``, and must fully match the
    element-list pattern (``\\z`` end anchor: ``rlike`` searches, and ``$``
    would let a final newline through). The threshold defaults to 0.75 and
    must lie in [0, 1]; NaN is rejected.
    """
    has_el = elements_col is not None and elements_col in docs.columns
    has_t = threshold_col is not None and threshold_col in docs.columns
    raw_el = F.col(elements_col) if has_el else F.lit(None).cast("string")
    decoded = F.try_url_decode(F.coalesce(raw_el, F.lit(DEFAULT_ELEMENTS)))
    thr = F.col(threshold_col).cast("double") if has_t else F.lit(None).cast("double")
    err = (F.when(decoded.isNull(), F.lit(MSG_BAD_ENCODING))
           .when(~decoded.rlike(ELEMENTS_PATTERN), F.lit(MSG_BAD_ELEMENTS))
           .when(thr.isNotNull() & (F.isnan(thr) | (thr < 0.0) | (thr > 1.0)), F.lit(MSG_BAD_THRESHOLD))
           .when(F.col("xml").isNull(), F.lit(MSG_NO_XML))
           .when(F.col("xml").rlike(r"\A[\x00-\x20]*\z"), F.lit(MSG_EMPTY_XML)))
    keep = [c for c in docs.columns if c not in (elements_col, threshold_col, "elements", "threshold", "error")]
    return docs.select(*keep, decoded.alias("elements"),
                       F.coalesce(thr, F.lit(DEFAULT_THRESHOLD)).alias("threshold"), err.alias("error"))


def outcome_message(status: Column, n_groups: Column) -> Column:
    """Message for a status; COMPLETED splits on whether groups exist."""
    return (F.when(status == "PROCESSING", F.lit(MSG_PROCESSING))
            .when(status == "ERROR", F.lit(MSG_ERROR))
            .when(status == "NO_TEXT_EXTRACTED", F.lit(MSG_NO_TEXT))
            .when(n_groups > 0, F.lit(MSG_GROUPS))
            .otherwise(F.lit(MSG_NO_GROUPS)))


def _count_texts(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.groupBy(key).agg(
        F.count(F.when(F.col("parse_error").isNull() & has_text("raw_text"), 1)).alias("n_texts"),
        F.max("parse_error").alias("parse_error"))


def _count_outcomes(parsed: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Status, message and counts per ``key`` from one parse and its groups."""
    return _outcomes(_count_texts(parsed, key), members, key)


def _outcomes(per_doc: DataFrame, members: DataFrame, key: str) -> DataFrame:
    grouped = members.groupBy(key).agg(
        F.count(F.when(F.col("is_leader"), 1)).alias("n_groups"), F.count(F.lit(1)).alias("grouped_texts"))
    o = per_doc.join(grouped, key, "left").fillna(0, ["n_groups", "grouped_texts"])
    status = (F.when(F.col("parse_error").isNotNull(), F.lit("ERROR"))
              .when(F.col("n_texts") == 0, F.lit("NO_TEXT_EXTRACTED"))
              .otherwise(F.lit("COMPLETED")))
    return o.withColumn("status", status).select(
        key, "status", outcome_message(F.col("status"), F.col("n_groups")).alias("message"),
        F.when(F.col("status") == "NO_TEXT_EXTRACTED", F.lit(ERR_NO_TEXT)).otherwise(F.col("parse_error")).alias("error"),
        "n_texts", "n_groups", "grouped_texts",
        (F.col("grouped_texts") - F.col("n_groups")).alias("removable_texts"),
        (F.col("n_texts") - F.col("n_groups")).alias("texts_minus_groups"))


def _texts(parsed: DataFrame) -> DataFrame:
    return (parsed.where(F.col("parse_error").isNull() & F.col("semid").isNotNull() & has_text("raw_text"))
            .select("doc_id", "semid", normalize_space("raw_text").alias("text")))


def document_outcomes(docs: DataFrame, elements: str = DEFAULT_ELEMENTS, threshold: float = DEFAULT_THRESHOLD,
                      observation=None, **group_kw) -> tuple[DataFrame, DataFrame]:
    """End-to-end run over ``(doc_id, xml)``: ``(outcomes, members)``.

    Each document is parsed once (checkpointed); the element rows feed grouping
    per document, the same parse gives the counts and parse errors. Outcome
    columns: ``doc_id, status, message, error, n_texts, n_groups,
    grouped_texts, removable_texts, texts_minus_groups, threshold``.
    With a ``pyspark.sql.Observation`` the run also reports ``texts`` (A1/A2:
    texts extracted = texts embedded) and ``documents`` as observed metrics,
    collected alongside the job instead of by an extra one.
    """
    parsed = parse_documents(docs, elements)
    if observation is not None:  # one row per document has semid 1, or is a marker / error row
        parsed = parsed.observe(
            observation,
            F.count(F.when(F.col("parse_error").isNull() & has_text("raw_text"), 1)).alias("texts"),
            F.count(F.when(F.col("semid").isNull() | (F.col("semid") == 1), 1)).alias("documents"))
    parsed = parsed.checkpoint(eager=True)
    members = group_items(_texts(parsed), ["doc_id"], "semid", threshold, **group_kw).checkpoint(eager=True)  # counted and returned
    return _count_outcomes(parsed, members, "doc_id").withColumn("threshold", F.lit(float(threshold))), members


def vector_outcomes(items: DataFrame, scope: str, order: str, vector: str, threshold: float, **group_kw) -> DataFrame:
    """One outcome per scope of precomputed vectors: scopes whose vectors differ in length are ERROR rows.

    ``scope, status, error, n_texts, n_groups, grouped_texts``; the other scopes complete.
    """
    errors = vector_length_errors(items, [scope], vector)
    members = group_items(items, [scope], order, threshold, text=None, vector=vector, **group_kw)
    counts = items.groupBy(scope).agg(F.count(F.lit(1)).alias("n_texts"))
    grouped = members.groupBy(scope).agg(
        F.count(F.when(F.col("is_leader"), 1)).alias("n_groups"), F.count(F.lit(1)).alias("grouped_texts"))
    out = counts.join(errors, scope, "left").join(grouped, scope, "left").fillna(0, ["n_groups", "grouped_texts"])
    return out.select(
        scope, F.when(F.col("error").isNotNull(), "ERROR").otherwise("COMPLETED").alias("status"), "error",
        "n_texts", "n_groups", "grouped_texts")


def live_runs(runs: DataFrame, as_of, ttl_minutes: int = RUN_TTL_MINUTES) -> DataFrame:
    """O3: runs not yet expired at ``as_of`` (expired when as_of > created_at + ttl)."""
    limit = F.col("created_at") + F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    return runs.where(F.lit(as_of).cast("timestamp") <= limit)


def result_documents(members: DataFrame, scope: list[str], order: str) -> DataFrame:
    """S3: ``scope..., similarity_groups array<array<string>>`` — groups in leader
    order, each leader first then members by position (G4).

    Built with two aggregations (members into groups, groups into a scope's
    list); meant for display-sized results such as one document's groups.
    """
    lead = f"leader_{order}"
    groups = members.groupBy(*scope, lead).agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("is_leader"), 0).otherwise(1).alias("_r"),
                                             F.col(order).alias("_o"), F.col("text").alias("_t")))).alias("_m"))
    groups = groups.select(*scope, lead, F.transform("_m", lambda x: x["_t"]).alias("texts"))
    return groups.groupBy(*scope).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(lead).alias("_l"), F.col("texts").alias("_x")))),
                    lambda x: x["_x"]).alias("similarity_groups"))


def full_results(outcomes: DataFrame, members: DataFrame, key: str, order: str, run_id: str) -> DataFrame:
    """The whole result document of every outcome row, with or without groups.

    ``key, run_id, status, message, error, n_groups, removable_texts,
    similarity_groups``: groups by average score, highest first (to six
    digits, then by leader), each leader first. For scopes of a document's
    size: a scope's texts are gathered in its row.
    """
    lead = f"leader_{order}"
    groups = members.groupBy(key, lead).agg(
        F.round(F.avg("similarity"), 6).alias("_score"),
        F.array_sort(F.collect_list(F.struct((~F.col("is_leader")).alias("_r"), F.col(order).alias("_o"), F.col("text").alias("_t")))).alias("_m"))
    listed = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("_score")).alias("_s"), F.col(lead).alias("_l"), F.transform("_m", lambda x: x["_t"]).alias("_x")))).alias("_g"))
    return outcomes.join(listed, key, "left").select(
        key, F.lit(run_id).alias("run_id"), "status", "message", "error", "n_groups", "removable_texts",
        F.coalesce(F.transform("_g", lambda g: g["_x"]), F.array().cast("array<array<string>>")).alias("similarity_groups"))


def save_run(df: DataFrame, path: str, run_id: str) -> None:
    """Keep a table (vertices with vectors, or groups) under ``run_id``.

    Only that run's partition is replaced, so a run saved again after a
    failure has its rows once.
    """
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def load_run(spark, path: str, run_id: str) -> DataFrame:
    """One run's rows (partition pruning on ``run_id``); absent -> empty."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


PREVIEW_MEMBERS = 5  # fixed value: members shown before "n more" in the reference's demo


def group_previews(members: DataFrame, scope: list[str], order: str, n: int = PREVIEW_MEMBERS) -> DataFrame:
    """W3 + F1: first ``n`` texts of each group (leader first, each cut to 20
    characters plus '...') and how many more there are.

    The leader has the smallest position in its group, so the preview is the
    ``n`` smallest positions: ``row_number() <= n``, which Spark plans as a
    map-side group limit, so at most ``n`` rows per group and map task reach
    the shuffle however large a group is. Sizes come from a partial count.
    """
    from pyspark.sql import Window

    from echoset.functions.text import truncate_text

    lead = f"leader_{order}"
    rn = F.row_number().over(Window.partitionBy(*scope, lead).orderBy(order))
    top = members.select(*scope, lead, order, "text", rn.alias("_rn")).where(F.col("_rn") <= n)
    first = top.groupBy(*scope, lead).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), truncate_text("text").alias("_t")))).alias("_p"))
    sizes = members.groupBy(*scope, lead).agg(F.count(F.lit(1)).alias("size"))
    return first.join(sizes, [*scope, lead]).select(
        *scope, lead, "size", F.transform("_p", lambda x: x["_t"]).alias("preview"),
        F.greatest(F.col("size") - n, F.lit(0)).alias("more"))


def multiword_flag(members: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Per group, whether every text has more than one word (filter on it
    to drop groups holding a one-word text; off by default)."""
    return members.groupBy(*scope, f"leader_{order}").agg(
        F.bool_and(F.size(F.split(F.col("text"), " ")) > 1).alias("all_multiword"))


def drop_one_word_groups(members: DataFrame, scope: list[str], order: str) -> DataFrame:
    """R10 as a filter: only groups in which every text has more than one word."""
    keep = multiword_flag(members, scope, order).where("all_multiword").select(*scope, f"leader_{order}")
    return members.join(keep, [*scope, f"leader_{order}"], "left_semi")


def distinct_group_texts(members: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Each group's distinct texts with the positions of all their copies.

    ``scope..., leader_<order>, text, first, positions, copies``.
    """
    return members.groupBy(*scope, f"leader_{order}", "text").agg(
        F.min(order).alias("first"), F.array_sort(F.collect_list(order)).alias("positions"),
        F.count(F.lit(1)).alias("copies"))


def by_score(summary: DataFrame, order: str) -> DataFrame:
    """Groups sorted by average similarity, highest first (a range-partitioned global sort)."""
    return summary.orderBy(F.desc("avg_similarity"), f"leader_{order}")


def element_ids(elements: DataFrame) -> DataFrame:
    """A deterministic id per element, sha-256 of ``doc_id:semid``."""
    return elements.withColumn(
        "element_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("semid").cast("string")), 256))


CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> None:
    """Flat member (or text) rows as CSV with a header; metadata (maps, arrays, structs) as JSON text."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("map", "array", "struct")}
    df = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """A file that ``write_csv`` wrote, with its types again; nested columns stay JSON text."""
    return spark.read.options(**CSV, multiLine="true").schema(schema).csv(path)


def run_requests(requests: DataFrame, outcomes_only: bool = False, **group_kw) -> tuple[DataFrame, DataFrame | None]:
    """The reference's request, as a table: ``(request_id?, doc_id, xml, elements?, threshold?)``.

    Every row is one request, keyed by ``request_id`` (given to the rows if the
    table has none), so a document sent twice with other parameters stays two
    requests. Every row is validated (P1-P3, P6, P7); invalid rows become
    ``ERROR`` outcomes whose message names the cause; valid rows are parsed
    with their own element list and grouped at their own threshold, in one
    job. Returns ``(outcomes, members)``, both with ``request_id`` and ``doc_id``.

    Parsed texts and vertices are kept compressed in the checkpoint folder (the members read them there);
    ``outcomes_only``: dropped before the return, and there are no members. The documents themselves are not kept:
    ``requests`` is read once to parse them and once for all else.
    """
    if "request_id" not in requests.columns:  # fixed by the checkpoint before it is read twice
        requests = requests.withColumn("request_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    spark = requests.sparkSession
    v = validate_documents(requests)
    asked = v.select("request_id", "doc_id", "threshold", "error").checkpoint(eager=True)  # without the documents
    own = asked.where(F.col("error").isNull()).select("request_id", F.col("doc_id").alias("_document"), "threshold")
    scratch = Scratch(spark)
    each = F.struct("request_id", F.col("doc_id").alias("_document"), "threshold").alias("doc_id")  # stays with its texts
    parsed = scratch.keep(
        parse_documents(v.where(F.col("error").isNull()).select(each, "xml", "elements"))
        .select("doc_id.*", "semid", "parse_error", normalize_space("raw_text").alias("raw_text")))
    counted = _count_texts(parsed, "request_id").checkpoint(eager=True)
    texts = parsed.where(F.col("parse_error").isNull() & F.col("semid").isNotNull() & has_text("raw_text")
                         & F.col("request_id").isNotNull())
    items = texts.select("request_id", "semid", F.col("raw_text").alias("text"), "_document", "threshold")
    if own.groupBy("request_id").count().where("count > 1 AND request_id IS NOT NULL").take(1):
        # a request sent more than once is one scope, at the least of its thresholds, its texts there for each time
        least = own.groupBy("request_id").agg(F.min("threshold").alias("threshold"))
        items = items.drop("_document", "threshold").join(own.drop("threshold").join(least, "request_id"), "request_id")
    items = scratch.keep(items)
    scratch.forget(1)
    let_go(spark)
    members = group_items(items, ["request_id"], "semid", threshold_col="threshold", scratch=scratch, **group_kw)
    o = _outcomes(counted, members, "request_id").join(own, "request_id")
    o = o.withColumnRenamed("_document", "doc_id")
    if outcomes_only:
        let_go(spark)
        o, members = o.checkpoint(eager=True), None
        drop_folder(spark, scratch.folder)
    else:
        members = members.withColumnRenamed("_document", "doc_id")
    rejected = asked.where(F.col("error").isNotNull()).select(
        "request_id", F.lit("ERROR").alias("status"), F.col("error").alias("message"), "error",
        *[F.lit(0).cast("bigint").alias(c) for c in ("n_texts", "n_groups", "grouped_texts", "removable_texts",
                                                      "texts_minus_groups")], "threshold", "doc_id")
    return o.unionByName(rejected), members
