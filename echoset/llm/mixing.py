"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Documents fall in cells (source, language, topic). The cells' token counts are
raked: each margin in turn is scaled to its targets, again and again until all
margins agree. A cell's weight over its tokens is the rate at which its documents
should be drawn; scaled to a token budget and bounded by 1 it is each
document's probability, and a hash of the document's id decides.

Only cells are ever raked, one row per cell; the documents are aggregated once and met with their cell's probability once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, picked

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
SMALL_CELLS = 100_000  # up to so many cells are raked in one task and broadcast; more are shuffled (tested to give the same)
ROUNDS_AT_ONCE = 4  # raking rounds of few cells between checkpoints
DIGITS = 13  # hexadecimal digits of the deciding hash


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_topic(text: str) -> Column:
    """A coarse topic from the text's form (fixed rules over its UTF-8 bytes, first that holds)."""
    t = F.col(text)
    size = F.octet_length(t)
    count = lambda chars: size - F.octet_length(_without(t, chars))
    return (
        F.when(t.isNull() | (size == 0), "empty")
        .when(t.contains("License") | t.contains("Copyright"), "legal")
        .when(count("|") * 40 >= size, "table")
        .when(count("%*&$#!") * 20 >= size, "noisy")
        .when(size < 500, "short")
        .otherwise("prose"))


def token_count(text: str) -> Column:
    """Token weight of a text: its spaces and line feeds and one more (0 for a null or empty text)."""
    t = F.col(text)
    words = F.octet_length(t) - F.octet_length(_without(t, " \n")) + 1
    return F.coalesce(F.when(F.octet_length(t) > 0, words), F.lit(0)).cast("bigint")


def cell_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """``id``, the margins (nulls are a value of their own) and ``n_tokens`` of each document."""
    src = picked(docs, id=id_col, text=text_col, source=source_col, lang=lang_col)
    topic = text_topic("text") if topic is None else topic
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return src.select(
        "id", named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(topic).alias("topic"),
        token_count("text").alias("n_tokens"))


def tempered_targets(cells: DataFrame, temper: dict[str, float]) -> DataFrame:
    """``margin, value, share``: each value's token share to the power ``temper``, made to sum to 1."""
    tables = []
    for m in MARGINS:
        by = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        raised = by.select(F.lit(m).alias("margin"), "value", F.pow(F.col("tokens").cast("double"), F.lit(temper[m])).alias("t"))
        total = raised.agg(F.sum("t")).first()[0] or 1.0
        tables.append(raised.select("margin", "value", (F.col("t") / total).alias("share")))
    return tables[0].union(tables[1]).union(tables[2])


def rake(cells: DataFrame, targets: DataFrame, tol: float = 1e-12, max_rounds: int = 40) -> DataFrame:
    """``cells`` (margins, ``tokens``) with ``weight`` and ``margin_error``; weights are shares of all tokens.

    Up to ``SMALL_CELLS`` cells are scaled in one task, whose rounds need no exchange; more are
    scaled by factors per margin value that aggregations renew. The weights are the same.

    Values without a target get none; targets of values without tokens are left
    out and the rest made to sum to 1 again. Targets that contradict each other
    (no weights can meet them) settle as far as ``max_rounds`` takes them:
    ``margin_error``, the same in every row, is the largest relative distance of a margin
    from its target that is left.
    """
    w = cells.where("tokens > 0")
    for m in MARGINS:
        share = targets.where(F.col("margin") == m).select(F.col("value").alias(m), F.col("share").alias(f"{m}_share"))
        w = w.join(share.where(F.col(f"{m}_share") > 0), m)
    w = cut(w)
    for m in MARGINS:  # a few rows of sums: targets of the values that are left sum to 1
        total = w.groupBy(m).agg(F.first(f"{m}_share").alias("share")).agg(F.sum("share")).first()[0] or 1.0
        w = w.withColumn(f"{m}_share", F.col(f"{m}_share") / total)
    few = w.count() <= SMALL_CELLS
    w = (_scale_cells if few else _renew_factors)(w, tol, max_rounds)
    error = _distances(w, MARGINS).agg(F.max("off")).first()[0]
    return w.select(*MARGINS, "tokens", "weight", F.lit(error).cast("double").alias("margin_error"))


def _distances(w: DataFrame, margins: tuple[str, ...]) -> DataFrame:
    """``off``: each margin value's relative distance from its target."""
    tables = [
        w.groupBy(m).agg(F.sum("weight").alias("now"), F.first(f"{m}_share").alias("want"))
        .select(F.abs(F.col("now") / F.col("want") - 1).alias("off")) for m in margins]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _scale_cells(w: DataFrame, tol: float, max_rounds: int) -> DataFrame:
    """Few cells: one task scales them margin by margin."""
    w = w.withColumn("weight", F.col("tokens").cast("double")).coalesce(1)
    for _ in range(0, max_rounds, ROUNDS_AT_ONCE):
        for m in MARGINS * ROUNDS_AT_ONCE:
            now = F.sum("weight").over(Window.partitionBy(m))
            w = w.withColumn("weight", F.col("weight") * F.col(f"{m}_share") / now)
        w = cut(w)
        worst = _distances(w, MARGINS[:-1]).agg(F.max("off")).first()[0]  # the last margin was just met
        if worst is None or worst <= tol:
            break
    return w


def _renew_factors(w: DataFrame, tol: float, max_rounds: int) -> DataFrame:
    """Many cells: a weight is the tokens times one factor per margin value.

    A step renews one margin's factors: target share over the sum, by value, of tokens
    times the other factors. Sums are combined before the shuffle, so a value that most
    cells share burdens no task. Ends when no factor moves by more than ``tol``.
    """
    factors, small = {}, {}
    for m in MARGINS:
        factors[m] = cut(w.groupBy(m).agg(F.first(f"{m}_share").alias("share")).withColumn(f"{m}_factor", F.lit(1.0)))
        small[m] = factors[m].count() <= SMALL_CELLS
    base = cut(w)

    def weighed(x: DataFrame, margins: list[str]) -> tuple[DataFrame, Column]:
        weight = F.col("tokens").cast("double")
        for m in margins:
            x = x.join(_sized(factors[m].select(m, f"{m}_factor"), small[m]), m)
            weight = weight * F.col(f"{m}_factor")
        return x, weight

    for _ in range(max_rounds):
        moves = []
        for m in MARGINS:
            x, weight = weighed(base, [o for o in MARGINS if o != m])
            sums = x.groupBy(m).agg(F.sum(weight).alias("now"))
            renewed = cut(sums.join(factors[m].withColumnRenamed(f"{m}_factor", "was"), m).select(
                m, "share", (F.col("share") / F.col("now")).alias(f"{m}_factor"),
                F.abs(F.col("was") * F.col("now") / F.col("share") - 1).alias("move")))
            factors[m] = renewed.drop("move")
            moves.append(renewed.select("move"))
        if moves[0].union(moves[1]).union(moves[2]).agg(F.max("move")).first()[0] <= tol:
            break
    x, weight = weighed(base, list(MARGINS))
    return cut(x.select(*base.columns, weight.alias("weight")))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    """A table whose rows were counted: broadcast if few."""
    return F.broadcast(df) if small else df


def probabilities(raked: DataFrame, keep: float) -> DataFrame:
    """``margins, weight, probability`` and further columns but the tokens: weight over tokens, scaled so that ``keep`` of all tokens is expected.

    Cells whose rate would pass 1 are taken whole and the others scaled up
    for it: each step bounds more cells and is one small aggregation.
    """
    rate = F.col("weight") / F.col("tokens")
    rated = raked.withColumn("rate", rate)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    scale, bounded = 0.0, -1
    while True:
        full = F.lit(scale) * F.col("rate") >= 1
        row = rated.agg(
            F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("whole"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("rest")).first()
        if row["n"] == bounded or not row["rest"]:
            break
        bounded, scale = row["n"], (keep * total - row["whole"]) / row["rest"]
    kept = [c for c in raked.columns if c != "tokens"]
    return rated.select(*kept, F.least(F.lit(1.0), F.lit(float(scale)) * F.col("rate")).alias("probability"))


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone: the same every time, everywhere."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def cell_probabilities(rows: DataFrame, temper: dict[str, float], keep: float, targets: DataFrame | None) -> DataFrame:
    """The cells' probabilities; small ones marked for broadcast after counting them."""
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    targets = tempered_targets(cells, temper) if targets is None else targets
    out = cut(probabilities(rake(cells, targets), keep))
    return _sized(out, out.count() <= SMALL_CELLS)


TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | None = None, targets: DataFrame | None = None, temper: dict[str, float] | None = None,
    keep: float = 0.7, seed: int = 42,
) -> DataFrame:
    """Every document's cell, probability and whether it is drawn.

    ``<id_col>, source, lang, topic, n_tokens, weight, probability, kept, margin_error``, one
    row per row of ``docs``. Targets (``margin, value, share``) default to the observed
    shares tempered per margin. Documents of cells without tokens or without a target
    have weight and probability 0; empty documents in a cell with tokens are drawn like
    any other of it. Rows with the same id are drawn alike. ``margin_error`` says how far
    the raked margins still are from their targets (see ``rake``; null without a raked cell).
    """
    rows = cell_rows(docs, id_col, text_col, source_col, lang_col, topic)
    cells = cell_probabilities(rows, temper or TEMPER, keep, targets)
    out = rows.join(cells, list(MARGINS), "left")
    p = F.coalesce("probability", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        p.alias("probability"), (draw(F.col("id"), seed) < p).alias("kept"), "margin_error")


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                     temper: dict[str, float] | None = None, keep: float = 0.7, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns (no shuffle of texts)."""
    rows = cell_rows(docs, id_col, text_col, source_col, lang_col, None)
    cells = cell_probabilities(rows, temper or TEMPER, keep, None)
    name = {m: f"_echoset_{m}" for m in MARGINS}
    cells = cells.select(*[F.col(m).alias(name[m]) for m in MARGINS], F.col("probability").alias("_echoset_p"))
    cells = _sized(cells, cells.count() <= SMALL_CELLS)
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    marked = docs.withColumns({
        name["source"]: named(F.col(f"`{source_col}`")), name["lang"]: named(F.col(f"`{lang_col}`")), name["topic"]: text_topic(text_col)})
    return marked.join(cells, list(name.values())).where(draw(F.col(f"`{id_col}`"), seed) < F.col("_echoset_p")).drop(*name.values(), "_echoset_p")


def oracle_sql(rounds: int = 40, keep: float = 0.7, seed: int = 42) -> str:
    """The same in DuckDB: a chain of raking rounds, the bound found by sorting the rates."""
    def count(chars: str) -> str:
        inner = "text"
        for c in chars:
            inner = f"replace({inner}, {'chr(10)' if c == chr(10) else repr(c)}, '')"
        return f"(strlen(text) - strlen({inner}))"

    topic = f"""CASE WHEN text IS NULL OR text = '' THEN 'empty'
      WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'legal'
      WHEN {count('|')} * 40 >= strlen(text) THEN 'table'
      WHEN {count('%*&$#!')} * 20 >= strlen(text) THEN 'noisy'
      WHEN strlen(text) < 500 THEN 'short' ELSE 'prose' END"""
    steps = [f"""r AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic,
      CASE WHEN strlen(text) > 0 THEN {count(' ' + chr(10))} + 1 ELSE 0 END::BIGINT AS n_tokens FROM documents)""",
             "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in MARGINS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens), {TEMPER[m]}) / sum(pow(sum(tokens), {TEMPER[m]})) OVER () AS share FROM c GROUP BY {m})")
    steps.append("w0 AS MATERIALIZED (SELECT c.*, t_source.share AS source_share, t_lang.share AS lang_share, t_topic.share AS topic_share, tokens AS w "
                 "FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * {m}_share / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{k})")
            k += 1
    steps.append(f"s AS (SELECT *, w / tokens AS rate, {keep} * sum(tokens) OVER () AS budget, "
                 f"sum(tokens) OVER (ORDER BY w / tokens DESC, source, lang, topic) AS upto, "
                 f"sum(w) OVER () - sum(w) OVER (ORDER BY w / tokens DESC, source, lang, topic) AS rest FROM w{k})")
    # expected tokens are the least, over the cells taken whole, of theirs plus the scaled rest: so the largest scale holds
    steps.append("z AS (SELECT max(scale) AS scale FROM (SELECT max(budget) / sum(w) AS scale FROM s "
                 "UNION ALL SELECT (budget - upto) / rest FROM s WHERE rest > 1e-12 AND budget > upto))")
    off = " UNION ALL ".join(f"SELECT abs(sum(w) / max({m}_share) - 1) AS off FROM w{k} GROUP BY {m}" for m in MARGINS)
    steps.append(f"e AS (SELECT max(off) AS margin_error FROM ({off}))")
    steps.append("p AS (SELECT source, lang, topic, w AS weight, least(1.0, z.scale * rate) AS probability, margin_error FROM s, z, e)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(probability, 0), 6) AS probability,
       ('0x' || substr(md5('{seed}:' || r.doc_id), 1, {DIGITS}))::BIGINT::DOUBLE / {16 ** DIGITS}.0 < coalesce(probability, 0) AS kept, round(margin_error, 6) AS margin_error
FROM r LEFT JOIN p USING (source, lang, topic)"""
