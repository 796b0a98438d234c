"""End-to-end batch plans: items -> distinct vertices -> vectors -> edges ->
greedy groups -> member rows.

Exact duplicates are collapsed before any comparison (one vertex per distinct
content inside a scope, ordered by its first position). This never changes
the answer: copies share one neighbourhood, so every copy lands in the group
of its first occurrence; copies of a leader join it when the text is similar
to itself (``selfsim >= t``, false for zero and NaN vectors), and otherwise
stay alone. It means a text repeated a billion times costs one vertex — the
collapse is a map-side-combined aggregation and the final expansion a join
that AQE may split when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoset.operators.embed import DEFAULT_DIM, as_double_vector, with_hashing_counts
from echoset.operators.grouping import assign_members, greedy_leaders
from echoset.operators.leaders import group_corpus
from echoset.operators.pairs import DEFAULT_BLOCK_ROWS, LENGTH_ERROR, block_pairs
from echoset.operators.ranks import exact_quantiles, numbered
from echoset.session import Scratch, let_go
from echoset.sources.documents import DEFAULT_THRESHOLD


def vector_length_errors(items: DataFrame, scope: list[str], vector: str) -> DataFrame:
    """``(scope..., error)`` for scopes whose vectors differ in length."""
    by = items.groupBy(*scope).agg(F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"))
    return by.where(F.col("_lo") != F.col("_hi")).select(
        *scope, F.lit(LENGTH_ERROR).alias("error"))


def distinct_vertices(items: DataFrame, scope: list[str], order: str, content: str) -> DataFrame:
    """R1 inside the engine: ``(scope..., content, pos, copies)``."""
    return items.groupBy(*scope, content).agg(F.min(order).alias("pos"), F.count(F.lit(1)).alias("copies"))


def text_key(text: str):
    """A text's SHA-256, which stands for it where rows of equal texts meet."""
    return F.unhex(F.sha2(F.col(text), 256))


def pair_members(items: DataFrame, vertices: DataFrame, pairs: DataFrame, scope: list[str], order: str, content: str,
                 threshold: float) -> DataFrame:
    """Membership beside pairs ``a, b`` of vertices: ``scope..., <order>, first_<order>, copies, links``.

    One row per position: the vertex it belongs to, the positions there, and the
    other positions at ``threshold`` or more, its own copies among them. Counted
    from the pairs of vertices and their sizes; no pair of positions is made.
    """
    sides = pairs.select(*scope, F.col("a").alias("pos"), F.col("b").alias("_other")).unionByName(
        pairs.select(*scope, F.col("b").alias("pos"), F.col("a").alias("_other")))
    sizes = vertices.select(*scope, F.col("pos").alias("_other"), F.col("copies").alias("_n"))
    met = sides.join(sizes, scope + ["_other"]).groupBy(*scope, "pos").agg(F.sum("_n").alias("_met"))
    alike = (F.col("selfsim") >= F.lit(float(threshold))) & ~F.isnan("selfsim")
    links = F.coalesce("_met", F.lit(0)) + F.when(alike, F.col("copies") - 1).otherwise(F.lit(0))
    classes = vertices.join(met, scope + ["pos"], "left").select(
        *scope, content, F.col("pos").alias(f"first_{order}"), "copies", links.cast("bigint").alias("links"))
    return items.select(*scope, order, content).join(classes, scope + [content]).select(
        *scope, order, f"first_{order}", "copies", "links")


def encode_vertices(vertices: DataFrame, content: str, encoder: str, dim: int) -> DataFrame:
    """Adds the vector columns and ``selfsim`` (similarity of a copy with itself)."""
    if encoder == "hashing":
        v = with_hashing_counts(vertices, content, dim)
        return v.withColumn("selfsim", F.when(F.col("sq") > 0, 1.0).otherwise(0.0))
    if encoder == "precomputed":
        v = vertices.withColumn("vector", as_double_vector(F.col(content)))
        # a copy of a vector is exactly similar to it; zero vectors to nothing, NaN never
        sq = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
        return v.withColumn("selfsim", F.when(F.isnan(sq) | (sq == float("inf")), float("nan")).when(sq > 0, 1.0).otherwise(0.0))
    raise ValueError(f"unknown encoder {encoder!r}")


def led_and_edges(vertices: DataFrame, scope: list[str], threshold: float, encoder: str,
                  block_rows: int, threshold_col: str | None) -> DataFrame:
    """``(scope..., a, b, sim, grouped)``: final (leader, member) rows and edges still to group.

    Inside scopes (documents, labels, requests) the packed block job groups
    every scope that fits in a block where its similarities are computed and
    gives edges for larger ones (and for a corpus whose positions are no numbers).
    """
    vector = None if encoder == "hashing" else "vector"
    if scope:
        return block_pairs(vertices, scope, threshold, vector=vector, block_rows=block_rows, mode="groups",
                           threshold_col=threshold_col)
    edges = block_pairs(vertices, scope, threshold, vector=vector, block_rows=block_rows)
    return edges.withColumn("grouped", F.lit(False))


def group_items(items: DataFrame, scope: list[str], order: str, threshold: float = DEFAULT_THRESHOLD,
                text: str | None = "text", vector: str | None = None, dim: int = DEFAULT_DIM,
                block_rows: int = DEFAULT_BLOCK_ROWS, stats: dict | None = None,
                threshold_col: str | None = None, with_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """G1-G5 end to end. Returns one row per grouped item::

        scope..., leader_<order>, <order>, is_leader, similarity[, text]

    ``similarity`` is the member's cosine to its leader (R3), null for the
    leader. Groups of one are never reported (G3); empty input gives an empty
    result (G5). With ``threshold_col`` each scope is compared at its own
    threshold (a per-request parameter). The groups of a corpus (no scope, numeric
    positions) are computed at once and checkpointed, with their texts unless not ``with_text``.
    With ``scratch`` the items are kept there already, with one threshold a scope; vertices are kept there too.
    """
    if threshold is None:
        threshold = DEFAULT_THRESHOLD  # G2
    out_order = order
    if order != "_ord":  # internal name, so user columns may be called pos, leader, ...
        items = items.withColumnRenamed(order, "_ord")
        order = "_ord"
    content = vector if vector is not None else text
    encoder = "precomputed" if vector is not None else "hashing"
    base = items.where(F.col(content).isNotNull())
    for c in scope:
        base = base.where(F.col(c).isNotNull())
    if encoder == "precomputed":
        # vectors of different lengths fail their scope (ERROR), not the job
        base = base.join(vector_length_errors(base, scope, content), scope, "left_anti") if scope else base
    if not scope and isinstance(base.schema[order].dataType, T.NumericType):  # a corpus: compared with leaders only
        with Scratch(items.sparkSession) as scratch:
            # vertices and items meet by the text's SHA-256: no text is copied for that
            key = content if encoder == "precomputed" else "_key"
            keyed = base if key == content else base.withColumn(key, text_key(content))
            base = scratch.keep(keyed)
            verts = encode_vertices(distinct_vertices(base, scope, order, content), content, encoder, dim)
            verts = scratch.keep(verts if key == content else verts.withColumn(key, text_key(content)).drop(content))
            led = group_corpus(verts, threshold, sparse=encoder == "hashing", stats=stats)
            assign = led.select(F.col("a").alias("leader"), F.col("b").alias("member"), "sim")
            let_go(items.sparkSession)
            shown = [content] if vector is None and with_text else []
            others = [c for c in items.columns if c not in (order, content)]
            return _member_rows(base, verts, assign, scope, order, out_order, key, threshold, None, False, [*shown, *others]).checkpoint(eager=True)
    # The items feed both the duplicate collapse and the final expansion, the
    # vertices feed pairs, scoring and roles: each is computed once, into the shared
    # checkpoint folder (nothing stays cached for the session; Spark's cleaner drops the files
    # once the plan that reads them is gone).
    key, columns = content, items.columns
    if scratch is None:
        base = base.checkpoint(eager=True)
        verts = encode_vertices(distinct_vertices(base, scope, order, content), content, encoder, dim).checkpoint(eager=True)
    else:  # by the key, so that texts are shuffled once, for their vertices
        key, columns = "_key", [content, *(c for c in items.columns if c != content)]
        distinct = base.groupBy(*scope, content).agg(
            F.min(order).alias("pos"), F.count(F.lit(1)).alias("copies"),
            *([F.min(threshold_col).cast("double").alias("_t")] if threshold_col is not None else []))
        verts = scratch.keep(encode_vertices(distinct, content, encoder, dim).withColumn(key, text_key(content)).drop(content))
        base = base.withColumn(key, text_key(content))
        let_go(items.sparkSession)
    if scratch is None and threshold_col is not None:
        scope_t = base.groupBy(*scope).agg(F.coalesce(F.min(threshold_col), F.lit(threshold)).cast("double").alias("_t"))
        verts = verts.join(scope_t, scope)
    found = led_and_edges(verts, scope, threshold, encoder, block_rows, "_t" if threshold_col else None)
    found = found.checkpoint(eager=True)  # read by every round and by the assignment
    edges = found.where(~F.col("grouped")).drop("grouped")
    leaders = greedy_leaders(edges, scope, stats=stats, edges_checkpointed=True)
    led = found.where("grouped").select(*scope, F.col("a").alias("leader"), F.col("b").alias("member"), "sim")
    assign = led.unionByName(assign_members(edges, leaders, scope))
    return _member_rows(base, verts, assign, scope, order, out_order, key, threshold, threshold_col, vector is None and key == content, columns)


def _member_rows(base: DataFrame, verts: DataFrame, assign: DataFrame, scope: list[str], order: str, out_order: str, content: str,
                 threshold: float, threshold_col: str | None, with_content: bool, columns: list[str]) -> DataFrame:
    """The items of every vertex that leads, is led, or has copies like itself."""
    roles = (assign.select(*scope, F.col("member").alias("pos"), "leader", "sim")
             .unionByName(assign.select(*scope, F.col("leader").alias("pos"), "leader",
                                        F.lit(None).cast("double").alias("sim")).distinct()))
    thr = F.col("_t") if threshold_col is not None else F.lit(float(threshold))
    self_ok = (F.col("selfsim") >= thr) & ~F.isnan("selfsim")
    vflags = verts.select(*scope, content, "pos", "copies", "selfsim", *(["_t"] if threshold_col else []))
    roles = (vflags.join(roles, scope + ["pos"], "left")
             .where(F.col("leader").isNotNull() | ((F.col("copies") > 1) & self_ok))
             .withColumn("leader", F.coalesce("leader", "pos"))
             .withColumn("_self_ok", self_ok)
             .select(*scope, content, "pos", "leader", "sim", "selfsim", "_self_ok"))
    keep_cols = [c for c in columns if c not in scope and c not in (order, content, threshold_col)]
    joined = base.select(*scope, order, content, *keep_cols).join(roles, scope + [content])
    is_leader = (F.col("leader") == F.col("pos")) & (F.col(order) == F.col("pos"))
    copy_of_leader = (F.col("leader") == F.col("pos")) & (F.col(order) != F.col("pos"))
    kept = joined.where((F.col("leader") != F.col("pos")) | (F.col(order) == F.col("pos")) | F.col("_self_ok"))
    sim = F.when(is_leader, F.lit(None).cast("double")).when(copy_of_leader, F.col("selfsim")).otherwise(F.col("sim"))
    out_cols = [*scope, F.col("leader").alias(f"leader_{out_order}"), F.col(order).alias(out_order),
                is_leader.alias("is_leader"), sim.alias("similarity")]
    if with_content:
        out_cols.append(F.col(content))
    out_cols += [F.col(c) for c in keep_cols]
    return kept.select(*out_cols)


def group_summary(members: DataFrame, scope: list[str], order: str, threshold: float | None = None) -> DataFrame:
    """One row per group.

    ``size``, ``avg/min/max/var_pop_similarity`` and the inter-quartile range
    over the members' scores (the leader's own score excluded), and the size
    relative to the largest group of the scope (an aggregation joined back,
    not a window, so one huge scope is never one task). Groups of a corpus (no scope)
    may hold any number of scores: their quantiles come from ranks in the sorted table.
    """
    lead = f"leader_{order}"
    parts = [
        F.count(F.lit(1)).alias("size"),
        F.avg("similarity").alias("avg_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.var_pop("similarity").alias("var_similarity"),
    ]
    if scope:
        iqr = F.percentile("similarity", 0.75) - F.percentile("similarity", 0.25)
        g = members.groupBy(*scope, lead).agg(*parts, iqr.alias("iqr_similarity"))
    else:
        members = members.select(lead, "similarity").checkpoint(eager=True)  # read twice
        q = exact_quantiles(members, [lead], "similarity", {"_q1": 0.25, "_q3": 0.75})
        g = members.groupBy(lead).agg(*parts).join(q, lead, "left")
        g = g.withColumn("iqr_similarity", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")
    if scope:
        largest = g.groupBy(*scope).agg(F.max("size").alias("_largest"))
        g = g.join(largest, scope)
    else:
        g = g.withColumn("_largest", F.lit(g.agg(F.max("size")).first()[0]))
    g = g.withColumn("relative_size", F.col("size") / F.col("_largest")).drop("_largest")
    if threshold is not None:
        g = g.withColumn("threshold", F.lit(float(threshold)))
    return g


def number_groups(summary: DataFrame, scope: list[str], order: str) -> DataFrame:
    """1-based group number inside each scope, in leader order.

    A window per scope for documents, labels or requests (display numbering); the
    groups of a corpus (no scope) are numbered by ranges of their leaders.
    """
    if not scope:
        return numbered(summary, [F.col(f"leader_{order}")], "group_no")
    w = Window.partitionBy(*scope).orderBy(f"leader_{order}")
    return summary.withColumn("group_no", F.row_number().over(w))


def rank_groups(summary: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``score_rank``, the 1-based place by average similarity (to 6 places), then by leader."""
    by = [F.desc(F.round("avg_similarity", 6)), F.asc(f"leader_{order}")]
    if not scope:
        return numbered(summary, by, "score_rank")
    return summary.withColumn("score_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*by)))


def max_similarity_items(items: DataFrame, scope: list[str], order: str, text: str | None = "text",
                         vector: str | None = None, dim: int = DEFAULT_DIM,
                         block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Highest similarity between two items of each scope (unthresholded).

    Distinct contents are compared block by block (one number leaves each
    task); copies of one content add their self-similarity. Scopes with
    fewer than two items are absent.
    """
    from echoset.operators.pairs import max_similarity

    content = vector if vector is not None else text
    encoder = "precomputed" if vector is not None else "hashing"
    verts = encode_vertices(distinct_vertices(items.where(F.col(content).isNotNull()), scope, order, content),
                            content, encoder, dim).checkpoint(eager=True)
    if encoder == "hashing":
        between = max_similarity(verts, scope, vector=None, block_rows=block_rows)
    else:
        between = max_similarity(verts, scope, vector="vector", block_rows=block_rows)
    copies = (verts.where(F.col("copies") > 1).groupBy(*scope).agg(F.max("selfsim").alias("copy_sim")))
    if not scope:
        m = between.unionByName(copies.withColumnRenamed("copy_sim", "max_sim"))
        return m.agg(F.max("max_sim").alias("max_similarity"))
    both = between.join(copies, scope, "full")
    return both.select(*scope, F.greatest("max_sim", "copy_sim").alias("max_similarity"))
