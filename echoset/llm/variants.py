"""Spelling variant grouping: reduced-alphabet generation (DataFrame operations only).

1. Words of all texts are counted: runs of letters, with one letter lost where
   a hash of the document and the run says so (``noise``; planted typing errors).
2. Every letter is hashed to one of a few symbols. Two words at one edit have
   reduced words at one edit or none, so the full one-edit neighbourhood of each
   distinct reduced word, joined with the reduced vocabulary, loses no pair. The number
   of symbols follows the size of the vocabulary, so that few words share a reduced word.
3. Pairs of words whose reduced words met are verified on the original words.
   Words longer than ``LONG`` would have large neighbourhoods: one edit leaves the
   first or the last half of a word as it is, so those meet on their halves and are
   verified alike.
4. A word's form is its commonest near word, if that is much commoner; forms are
   followed to their roots by doubling steps, each a join.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER.lower() + "".join(map(chr, range(0xC0, 0x100)))  # of words, lower-cased
LONG = 48  # letters
FEW = 4  # symbols at least


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, noise: int | None = 199) -> DataFrame:
    """``word, n``: words of ``min_length`` letters or more that occur ``min_count`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. With
    ``noise``, a run loses its letter h % length where noise divides h, the crc32 of
    ``<id>:<run>`` (a null id counts as an empty one).
    """
    src = picked(docs, id=id_col, text=text_col).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    low = F.translate("text", UPPER, UPPER.lower())
    runs = src.select("id", F.explode(F.regexp_extract_all(low, F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("word"))
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        runs = runs.withColumn("at", F.expr("CAST(h % char_length(word) AS INT)")).select(
            F.when(F.col("h") % noise != 0, F.col("word")).otherwise(
                F.expr("concat(substring(word, 1, at), substring(word, at + 2))")).alias("word"))
        runs = runs.where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def symbols_for(vocabulary: int, min_length: int = 6) -> int:
    """The fewest symbols whose reduced words of the least length are as many as the words."""
    few = FEW
    while few ** min_length < vocabulary and few < len(LETTERS):
        few += 1
    return few


def _reduced(word, few: int):
    return F.translate(word, LETTERS, "".join(chr(97 + zlib.crc32(c.encode()) % few) for c in LETTERS))


def _neighbourhood(few: int):
    """All strings at one edit or none from the reduced word ``r``."""
    signs = "array(" + ", ".join(f"'{chr(97 + i)}'" for i in range(few)) + ")"
    lost = "transform(sequence(1, char_length(r)), i -> concat(substring(r, 1, i - 1), substring(r, i + 1)))"
    changed = f"flatten(transform(sequence(1, char_length(r)), i -> transform({signs}, c -> concat(substring(r, 1, i - 1), c, substring(r, i + 1)))))"
    added = f"flatten(transform(sequence(0, char_length(r)), i -> transform({signs}, c -> concat(substring(r, 1, i), c, substring(r, i + 1)))))"
    return F.expr(f"explode(array_distinct(concat({lost}, {changed}, {added})))")


def near_words(words: DataFrame, few: int, long: int = LONG) -> DataFrame:
    """``word, near``: all ordered pairs of distinct words that one edit of a letter makes equal, each once."""
    one_edit = F.expr("word <> near AND levenshtein(word, near, 1) = 1")
    short = words.where(F.char_length("word") <= long).select("word", _reduced("word", few).alias("r"))
    meet = short.select("r").distinct().select("r", _neighbourhood(few).alias("q"))
    meet = meet.join(short.select(F.col("r").alias("q"), F.col("word").alias("near")), "q").select("r", "near")
    pairs = short.join(meet, "r").where(one_edit).select("word", "near")

    tail = words.where(F.char_length("word") >= long)
    halves = F.expr("""explode(flatten(transform(array_distinct(array(char_length(word) div 2, (char_length(word) - 1) div 2)),
        h -> array(struct(h AS h, true AS head, left(word, CAST(h AS INT)) AS half), struct(h AS h, false AS head, right(word, CAST(h AS INT)) AS half)))))""")
    keyed = tail.select("word", halves.alias("k")).select("word", F.xxhash64("k.h", "k.head", "k.half").alias("key"))
    far = keyed.join(keyed.select("key", F.col("word").alias("near")), "key").select("word", "near").distinct()
    return pairs.unionByName(
        far.where(F.greatest(F.char_length("word"), F.char_length("near")) > long).where(one_edit).select("word", "near"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
    noise: int | None = 199, ratio: int = 5, symbols: int | None = None, long: int = LONG,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: one row per counted word.

    ``form``: the near word of largest n (ties: the first in code-point order), if it
    has at least ``ratio`` times the word's n, else null like ``form_n``; ``root``: where forms lead, the word
    itself without one. Null, empty and letterless texts have no words; an
    empty table gives an empty result; repeated rows count as often as they stand; other columns are ignored.
    """
    words = cut(count_words(docs, id_col, text_col, min_length, min_count, noise))
    pairs = near_words(words.select("word"), symbols or symbols_for(words.count(), min_length), long)
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.near").alias("near"), (-F.col("b.m")).alias("m"))
    common = F.col("m") >= ratio * F.col("n")
    named = cut(named.select("word", "n", "n_near", F.when(common, F.col("near")).alias("form"), F.when(common, F.col("m")).alias("form_n")))
    return named.join(_roots(named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(step: DataFrame) -> DataFrame:
    """``word, root``: each word's last, from ``word, root`` with one step each; n grows along forms, so they end."""
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = longer.select("word", "root")
        if not longer.where("moved").take(1):
            return step


def oracle_sql(min_length: int = 6, min_count: int = 5, noise: int = 199, ratio: int = 5) -> str:
    """The same from words with one letter left out, crc32 by its table (DuckDB)."""
    return f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)),
       lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
       '[a-z\\x{{C0}}-\\x{{FF}}]{{{min_length},}}')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM d GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM g, crc),
l AS (SELECT CASE WHEN h % {noise} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM k a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM k a JOIN w b ON a.rest = b.word),
q AS (SELECT word, count(*) AS n_near, min_by(near, (-m, near)) AS near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * w.n THEN near END AS form,
             CASE WHEN m >= {ratio} * w.n THEN m END AS form_n FROM w LEFT JOIN q ON w.word = q.word),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.form = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM f JOIN r ON f.word = r.word WHERE r.form IS NULL"""
