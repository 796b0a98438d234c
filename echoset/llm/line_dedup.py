"""Line dedup by distinct-site spread (DataFrame operations only).

A line that stands on many sites is boilerplate, however often each site repeats it.

1. Every text is cut in lines; a line's key is two 64-bit hashes of its trimmed
   text. Blank lines have no key and always stay. ``min_chars`` above 1 leaves
   shorter lines out too; it is off unless asked for.
2. A HyperLogLog sketch of the sites of each line is built where the
   lines lie and merged by aggregation: one small sketch a line and task,
   however many rows a hot line has.
3. Estimates far from the threshold decide; lines near it (within ``band``,
   many standard errors wide) get exact distinct counts.
4. The places of boilerplate lines are gathered for each text that has any, and the texts
   are put together again without them.

The lines of 3 and 4 are met with keys that are few: up to ``broadcast_keys`` (counted) are
broadcast, so that all other lines stay where they are; more are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

SKETCH_BITS = 12  # standard error 1.04 / sqrt(2**12) = 1.6 %


def _lines(text: str):
    return F.split(text, "\n", -1)


def _keyed(rows: DataFrame, min_chars: int) -> DataFrame:
    """``id, mark, site, pos, k1, k2`` of the lines that have a key."""
    line = F.btrim("line", F.lit(" \t\r"))
    return (
        rows.select("id", "mark", "site", F.posexplode("lines").alias("pos", "line"))
        .select("id", "mark", "site", "pos", line.alias("line")).where(F.char_length("line") >= min_chars)
        .select("id", "mark", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.reverse("line")).alias("k2"))
    )


BROADCAST_KEYS = 200_000  # two longs each


def _met(lines: DataFrame, keys: DataFrame, broadcast_keys: int) -> DataFrame:
    """The lines whose key is among the (checkpointed) keys."""
    few = keys.count() <= broadcast_keys
    return lines.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "left_semi")


def spread_lines(keyed: DataFrame, min_sites: int, band: float, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Keys ``k1, k2`` of the lines on ``min_sites`` sites or more; rows without site count nowhere."""
    sketches = keyed.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = cut(
        sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - band)))
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("k1", "k2")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("k1", "k2")
    exact = (
        _met(keyed.where("site IS NOT NULL").select("k1", "k2", "site"), near, broadcast_keys)
        .distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites).select("k1", "k2"))
    return sure.union(exact)


def remove_spread_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8,
    min_chars: int = 1, band: float = 0.25, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Every text without cross-site boilerplate: ``<id_col>``, ``text``, ``n_lines``, ``n_removed``.

    One row per input row. Lines are what line feeds part; their trimmed text is
    compared, the untrimmed is kept. A null text stays null with 0 lines; an
    empty one has one empty line. Rows without site never make a line
    boilerplate but lose the lines that are. Rows that share id and text are treated alike.
    """
    src = picked(docs, id=id_col, text=text_col, site=site_col).withColumn("site", F.col("site").cast("string"))
    rows = src.select("id", F.xxhash64("text").alias("mark"), "site", _lines("text").alias("lines"))
    keyed = _keyed(rows, min_chars)
    spread = cut(spread_lines(keyed, min_sites, band, broadcast_keys))
    gone = (
        _met(keyed.select("id", "mark", "pos", "k1", "k2"), spread, broadcast_keys)
        .groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("pos").alias("gone")))
    met = rows.select("id", "mark", "lines").join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    # hashed set difference of places, then one look-up a kept line: linear in the text
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return met.select(
        F.col("id").alias(id_col), F.when(F.col("lines").isNotNull(), text).alias("text"),
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("bigint").alias("n_removed"))


def oracle_sql(min_sites: int = 8, min_chars: int = 1) -> str:
    """The same by exact distinct counts (DuckDB)."""
    return f"""
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM t WHERE length(bare) >= {min_chars} GROUP BY bare HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT t.*, b.bare IS NOT NULL AS gone FROM t LEFT JOIN b ON t.bare = b.bare),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) AS n_lines,
             count(*) FILTER (gone) AS n_removed FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.kept, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
