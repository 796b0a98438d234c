"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item (the whole item if it has
fewer). Of every ``window``-word run the minimum hash of its k-word runs is its
fingerprint, on both sides, so equal runs always have equal fingerprints: every
shared span of ``window`` words or more is found. Short items are
fingerprinted whole, by runs of their own length.

1. Items give their windows and fingerprints.
2. The fingerprints become a bitmap of fixed size (``filter_bits``, whatever the
   benchmark's size), sent to all tasks. More fingerprints mean more chance
   hits, never misses.
3. Documents are winnowed where they lie; only windows whose fingerprint
   passes the bitmap leave the task, with their words.
4. They are joined with the items' windows on fingerprint and words, so every
   hit is exact, and neighbouring windows extend it to the whole shared span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, picked
from .words import Words, slices, word_table

# Words: runs of characters other than these ASCII ones (fixed by the contract).
TABLE = word_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def window_prints(words: Words, length: int, window: int, k: int) -> np.ndarray:
    """Fingerprint of each run of ``length`` words: the least hash of its k-word runs."""
    if length < window:
        return words.grams(length)
    g = words.grams(k)
    span = window - k + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, span):
        np.minimum(least, g[j:j + n], out=least)
    return least


def _passes(prints: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = prints >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def winnow(df: DataFrame, id_col: str, text_col: str, window: int, k: int, lengths=None, bitmap=None, bits: int = 0) -> DataFrame:
    """``id``, ``n_words`` and arrays ``start``, ``len``, ``print``, ``words`` of windows.

    Without a bitmap (items): all windows, of ``window`` words or the whole text
    if it has fewer. With one (documents): the windows of each of ``lengths`` whose
    fingerprint passes.
    """
    src = picked(df, id=id_col, text=text_col)
    id_type = src.schema["id"].dataType.simpleString()

    def one(texts: pa.Array):
        words = Words(texts, TABLE)
        counts = np.diff(words.first)
        found = []
        for length in lengths or range(1, window + 1):
            prints = window_prints(words, length, window, k)
            good = words.whole(length)[:len(prints)]
            if bitmap is not None:
                good &= _passes(prints, bitmap.value, bits)
            at = np.flatnonzero(good)
            row = np.searchsorted(words.first, at, "right") - 1
            if lengths is None and length < window:
                at, row = at[counts[row] == length], row[counts[row] == length]
            found.append((row, at - words.first[row], np.full(len(at), length), prints[at], at))
        row, start, length, prints, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        texts = [words.text(int(i), int(n)) for i, n in zip(at[order], length[order])]
        per = np.bincount(row, minlength=len(counts))
        return [
            pa.array(counts, pa.int64()),
            _lists(per, pa.array(start[order], pa.int32())),
            _lists(per, pa.array(length[order], pa.int32())),
            _lists(per, pa.array(prints[order].view(np.int64), pa.int64())),
            _lists(per, pa.array(texts, pa.binary()).cast(pa.string())),
        ]

    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                cols = [ids.slice(lo, hi - lo), *one(texts.slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "start", "len", "print", "words"])

    return src.mapInArrow(
        run, f"id {id_type}, n_words bigint, start array<int>, len array<int>, print array<bigint>, words array<string>")


def _windows(winnowed: DataFrame, *keep: str) -> DataFrame:
    zipped = F.arrays_zip("start", "len", "print", "words")
    return winnowed.select(*keep, F.inline(zipped))


def print_bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as 64-bit words: set where a fingerprint's leading bits point.

    Aggregated by word in Spark; what reaches the driver is bounded by
    2**bits / 64 rows, whatever the number of fingerprints.
    """
    place = prints.select(F.shiftrightunsigned("print", 64 - bits).alias("at"))
    rows = place.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, k: int = 5, filter_bits: int = 24,
) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    One row per row of ``docs``: ``<id_col>``, ``n_words``, ``n_hit``, ``n_items``
    (items with a window in it), ``items_sha256`` (of their ids as text, sorted,
    comma-joined; of the empty text if there are none), ``contaminated``. Null and
    blank texts have no words; items without words have no window; rows with a
    null or repeated id are rows like any other, repeated item ids count once
    and a null one counts as the empty text. Empty tables give no hits.
    """
    sc = docs.sparkSession.sparkContext
    listed = cut(_windows(winnow(items, item_id_col, item_text_col, window, k), "id").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), "len", "print", "words").distinct())
    lengths = sorted(r["len"] for r in listed.select("len").distinct().collect())  # window values at most
    bitmap = sc.broadcast(print_bitmap(listed.select("print"), filter_bits))
    rows = cut(
        winnow(docs, id_col, text_col, window, k, lengths or [window], bitmap, filter_bits)
        .withColumn("row", F.monotonically_increasing_id())
    )
    hits = cut(
        _windows(rows, "row").join(listed.select("len", "print", "words").distinct(), ["print", "len", "words"], "left_semi")
    )
    covered = (
        hits.select("row", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
        .withColumn("done", F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)))
        .select("row", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("done", F.lit(0)))).alias("new"))
        .groupBy("row").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("row", "print", "len", "words").distinct()
        .join(listed, ["print", "len", "words"]).select("row", "item").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("found"))
    )
    out = rows.select("row", "id", "n_words").join(covered, "row", "left").join(named, "row", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, with all their columns.

    A row goes if a row with its id and text is contaminated (the text
    decides, so this is exact for null and repeated ids too).
    """
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"))
    marked = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    bad = contamination(marked, items, "key", "text", **kw).where("contaminated").select(
        F.col("key.id").alias("_echoset_id"), F.col("key.hash").alias("_echoset_hash")).distinct()
    same = key["id"].eqNullSafe(F.col("_echoset_id")) & (key["hash"] == F.col("_echoset_hash"))
    return docs.join(bad, same, "left_anti")


def oracle_sql(window: int = 10) -> str:
    """The same by comparing all windows' words (DuckDB)."""
    words = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
s AS (SELECT item_id, w, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s, unnest(generate_series(1, len(w) - n + 1)) t(i)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(generate_series(1, len(w) - n + 1)) t(i) WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM h), unnest(generate_series(i, i + n - 1)) u(p) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list_distinct(list(coalesce(item_id::VARCHAR, '')))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""
