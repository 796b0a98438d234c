"""Phrase collocation mining with an external stream estimation layout.

1. Windows. Every word occurrence opens a window: itself and the up to three words that
   follow it in its piece of text. The windows of a few megabytes of text are sorted
   and counted where they lie, word by word as numbers in the words' order.
2. Count streams in prefix order. Sorted runs of windows are cut at bounds (quantiles of
   a sample, which decide balance and nothing else) and shuffled as blocks, one range of
   windows a task. A task merges its runs; in the merged stream all windows
   that begin with a phrase stand together, so the counts of all phrases of one to four words are
   sums over runs of rows. A phrase at the edge of a range may go on in the next one, so
   its part is passed on however small; all others below ``min_count`` end here.
3. Lockstep merge joins. The counts of common phrases, sorted by phrase, meet the candidates'
   first parts (prefix order: left counts) and rests (suffix order: right counts), and the
   phrases without their last and first word (right and left extensions) in sort-merge
   joins: two sorted streams read side by side, no hash table.
4. The best phrases of each language by their lowest-scoring cut.

A longer candidate that holds a phrase holds one of its extensions by one word, which is
a candidate at least as frequent, so extensions by one word decide what is dropped.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, picked

WORDS = 4  # words of a window
TEXT_BYTES = 1 << 22  # bytes of text sorted at once; longer texts are taken in parts
RANGE_BYTES = 1 << 24  # bytes of text whose windows one range holds, about
SAMPLE_DOCS = 4000  # documents read for the bounds, at least; and for each range
SAMPLE_RANGE = 20
SAMPLE_STEP = 64  # every so manieth window of those
SALTS = 64  # parts of a language ranked on their own first

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _parts(data: np.ndarray, limit: int):
    """(from, to, end) of runs of about ``limit`` bytes that cut no word; up to ``end`` stand three words more."""
    n, lo = len(data), 0

    def seek(at: int, word: bool) -> int:
        """The first byte from ``at`` on that is (not) of a word."""
        while at < n:
            hit = np.flatnonzero(_WORD[data[at:at + 4096]] == word)
            if len(hit):
                return at + int(hit[0])
            at += 4096
        return n

    while lo < n:
        hi = seek(min(n, lo + limit), False)
        end = hi
        for _ in range(WORDS - 1):
            end = seek(seek(end, True), False)
        yield lo, hi, end
        lo = hi


def _dictionary(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's rank from 1 in byte order, and the distinct words in that order."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.uint64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.uint64)
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _binary(sizes: np.ndarray, data) -> pa.Array:
    """A binary array of values that lie one after another in ``data``."""
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])


def windows_of(data: np.ndarray, count_to: int) -> tuple[np.ndarray, pa.Array]:
    """Windows that start before byte ``count_to``: ranks (n, 4), 0 for none; and the words."""
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    piece = breaks[start]
    rank, words = _dictionary(_binary(end - start, _LOW[data[inside]].tobytes()))
    n = len(start)
    out = np.zeros((n, WORDS), np.uint64)
    out[:, 0] = rank
    for j in range(1, WORDS):
        same = piece[j:] == piece[:n - j] if n > j else np.empty(0, bool)
        out[:n - j, j][same] = rank[j:][same]
    return out[:np.searchsorted(start, count_to)], words


def _sorted_counts(windows: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order, and how often each stands (the sums of ``counts``)."""
    bits = np.uint64(int(windows.max(initial=1)).bit_length())
    packed = bits * WORDS <= 64
    if packed:
        key = ((windows[:, 0] << bits | windows[:, 1]) << bits | windows[:, 2]) << bits | windows[:, 3]
        order = np.argsort(key) if counts is not None else None
        key = key[order] if counts is not None else np.sort(key)
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
    else:
        hi, lo = windows[:, 0] << np.uint64(32) | windows[:, 1], windows[:, 2] << np.uint64(32) | windows[:, 3]
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))[:len(hi)]
    at = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(at, append=len(new))
    else:
        sums = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    if packed:
        mask = (np.uint64(1) << bits) - np.uint64(1)
        key = key[at]
        return np.stack([key >> (bits * np.uint64(WORDS - 1 - j)) & mask for j in range(WORDS)], axis=1), sums
    return windows[order[at]], sums


def _bound_places(windows: np.ndarray, words: pa.Array, bounds: list[tuple]) -> list[int]:
    """For each bound (a window of words) the first of the sorted windows that is not before it."""
    hi, lo = windows[:, 0] << np.uint64(32) | windows[:, 1], windows[:, 2] << np.uint64(32) | windows[:, 3]
    held = words.to_pylist()
    places = []
    for bound in bounds:
        key = []
        for word in bound:
            if word == b"":
                break
            r = bisect_left(held, word)
            key.append(r + 1)
            if r == len(held) or held[r] != word:
                break
        key = [*key, 0, 0, 0, 0][:WORDS]
        k = [np.uint64(key[0] << 32 | key[1]), np.uint64(key[2] << 32 | key[3])]
        a, b = np.searchsorted(hi, k[0]), np.searchsorted(hi, k[0], "right")
        places.append(int(a + np.searchsorted(lo[a:b], k[1])))
    return places


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _block(windows: np.ndarray, counts: np.ndarray, words: pa.Array) -> dict:
    """A run of windows with the words that it uses, as bytes; columns apart, since they pack well so."""
    used = np.unique(windows.ravel())
    used = used[used > 0]
    own = words.take(pa.array(used - np.uint64(1)))
    ranks = _small(np.searchsorted(used, windows) + (windows > 0))
    sizes = pc.binary_length(own).to_numpy()
    return {
        "n": len(counts), "sizes": sizes.astype("<u4").tobytes(), "words": b"".join(own.to_pylist()),
        "ranks": ranks.T.tobytes(), "counts": _small(counts).tobytes()}


def _loaded(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.empty(0, np.uint64)


def _texts(it):
    """(language, bytes) of a few megabytes of text at a time: texts of one language, a line feed after each."""
    for batch in it:
        langs = batch.column(1)
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(0).filter(pc.equal(langs, lang))
            held, size = [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1])
                if size >= TEXT_BYTES:
                    yield lang, np.frombuffer("\n".join(held).encode("utf-8", "surrogatepass"), np.uint8)
                    held, size = [], 0
            if held:
                yield lang, np.frombuffer("\n".join(held).encode("utf-8", "surrogatepass"), np.uint8)


def _sampled_bounds(src: DataFrame, parts: int | None) -> list[tuple]:
    """Bounds (language, four words) of the ranges, from every 64th window of some documents."""
    spark = src.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    n_docs = src.count()
    share = min(1.0, max(SAMPLE_DOCS, SAMPLE_RANGE * least) / max(1, n_docs))

    def run(it):
        for lang, data in _texts(it):
            for lo, hi, end in _parts(data, TEXT_BYTES):
                windows, words = windows_of(data[lo:end], hi - lo)
                some = windows[SAMPLE_STEP // 2::SAMPLE_STEP]
                held = words.take(pa.array(np.maximum(some, 1).ravel() - np.uint64(1))).to_pylist() if len(some) else []
                held = [w if r else b"" for w, r in zip(held, some.ravel().tolist())]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(some), pa.string()), "window": pa.array([held[i:i + WORDS] for i in range(0, len(held), WORDS)], pa.list_(pa.binary())),
                    "size": pa.array([hi - lo if i == 0 else 0 for i in range(len(some))], pa.int64())})

    rows = (src if share == 1.0 else src.sample(share, seed=7)).mapInArrow(run, "lang string, window array<binary>, size bigint").collect()
    if parts is None:
        parts = max(least, int(sum(r["size"] for r in rows) / share / RANGE_BYTES))
    held = sorted({(r["lang"].encode(), *map(bytes, r["window"])) for r in rows})
    return sorted({held[i * len(held) // parts] for i in range(1, parts)}) if held else []


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, parts: int | None = None) -> DataFrame:
    """``lang, size, phrase, f``: phrases of one to four words that stand ``min_count`` times or more.

    ``phrase`` is space-joined; size 0 (an empty phrase) has all word occurrences of its language.
    """
    src = picked(docs, text=text_col, lang=lang_col).select("text", F.coalesce("lang", F.lit("und")).alias("lang")).where("text IS NOT NULL")
    bounds = _sampled_bounds(src, parts)

    def runs(it):
        for lang, data in _texts(it):
            first = sum(1 for b in bounds if b[0] < lang.encode())
            own = [b[1:] for b in bounds if b[0] == lang.encode()]
            for lo, hi, end in _parts(data, TEXT_BYTES):
                windows, words = windows_of(data[lo:end], hi - lo)
                if not len(windows):
                    continue
                windows, counts = _sorted_counts(windows, None)
                at = [0, *_bound_places(windows, words, own), len(windows)]
                blocks = [(first + k, _block(windows[a:b], counts[a:b], words)) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b]
                yield pa.RecordBatch.from_pylist([{"part": k, "lang": lang, **b} for k, b in blocks], schema=schema)

    schema = pa.schema([
        ("part", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()),
        ("ranks", pa.binary()), ("counts", pa.binary())])
    blocks = src.mapInArrow(runs, "part int, lang string, n bigint, sizes binary, words binary, ranks binary, counts binary")
    dealt = blocks.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "lang")

    def merged(it):
        key, held = None, []
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if key not in (None, (row["part"], row["lang"])):
                    yield _phrases(key[1], held, min_count)
                    held = []
                key = row["part"], row["lang"]
                held.append(row)
        if held:
            yield _phrases(key[1], held, min_count)

    found = dealt.mapInArrow(lambda it: (pa.RecordBatch.from_pandas(x, preserve_index=False) for x in merged(it)), "lang string, size int, phrase string, f bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("size") == 0))


def _phrases(lang: str, held: list[dict], min_count: int) -> pd.DataFrame:
    """Counts of the phrases of a range's merged runs; below ``min_count`` only those at its edges."""
    sizes = [np.frombuffer(r["sizes"], "<u4") for r in held]
    rank, words = _dictionary(_binary(np.concatenate(sizes), b"".join(r["words"] for r in held)))
    rank = np.append(np.uint64(0), rank)
    windows, counts, base = [], [], 0
    for r, size in zip(held, sizes):
        own = _loaded(r["ranks"], WORDS * r["n"]).reshape(WORDS, -1).T.astype(np.int64)
        windows.append(rank[np.where(own > 0, own + base, 0)])
        counts.append(_loaded(r["counts"], r["n"]).astype(np.int64))
        base += len(size)
    held.clear()
    windows, counts = _sorted_counts(np.concatenate(windows), np.concatenate(counts))
    out = [pd.DataFrame({"lang": [lang], "size": np.array([0], np.int32), "phrase": [""], "f": [int(counts.sum())]})]
    new = np.zeros(len(windows), bool)
    new[0] = True
    for k in range(WORDS):
        new[1:] |= windows[1:, k] != windows[:-1, k]
        at = np.flatnonzero(new)
        f = np.add.reduceat(counts, at)
        keep = f >= min_count
        keep[[0, -1]] = True
        keep &= windows[at, k] > 0
        some = windows[at[keep], :k + 1]
        text = words.take(pa.array(some.ravel() - np.uint64(1))).to_pylist()
        out.append(pd.DataFrame({
            "lang": [lang] * len(some), "size": np.full(len(some), k + 1, np.int32),
            "phrase": [b" ".join(text[i:i + k + 1]).decode("utf-8", "surrogatepass") for i in range(0, len(text), k + 1)], "f": f[keep]}))
    return pd.concat(out, ignore_index=True)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, cover: int = 80, top: int | None = 2000,
    scale: int = 2_000_000, parts: int | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to four words of each language.

    Words stand between spaces and tabs inside pieces between ``.,;:!?`` and line ends; only
    A-Z are lower-cased. ``a``: occurrences, ``min_count`` at least; ``l``, ``r``: those of the two parts of the
    cut with the lowest ``score`` = floor(scale * a / (l + r)), the earliest of such cuts; ``n``: word
    occurrences of the language. A phrase inside a longer one that has ``cover`` percent of its
    occurrences is dropped. ``top``: as many phrases a language (None: all, ranked in one task a language).
    Null texts have no words, a null language is ``und``; an empty table gives an empty
    result; repeated rows count as often as they stand; other columns are ignored.
    """
    counts = cut(phrase_counts(docs, text_col, lang_col, min_count, parts))
    phrases = counts.where("size > 0").select("lang", "size", "phrase", "f")
    long = phrases.where("size > 1")
    cuts = long.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {scale}) div (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    longer = phrases.where("size > 2")
    without = lambda which: longer.select("lang", F.expr(f"substring_index(phrase, ' ', {which})").alias("phrase"), "f")
    wider = without("size - 1").unionByName(without("1 - size")).groupBy("lang", "phrase").agg(F.max("f").alias("wide"))
    kept = lowest.join(wider.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"wide IS NULL OR 100 * wide < {cover} * a"))

    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language's parts first: at most SALTS * top rows meet in a task
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def oracle_sql(min_count: int = 30, cover: int = 80, top: int = 2000, scale: int = 2_000_000) -> str:
    """The same from all phrases' occurrences (DuckDB)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, w, row_number() OVER () AS id FROM (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM d) WHERE len(w) > 0),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {min_count}),
x AS (SELECT *, unnest(range(1, k)) AS split FROM c),
s AS (SELECT x.lang, x.k, x.phrase, x.a, x.w, split, l.f AS l, r.f AS r, (x.a::HUGEINT * {scale}) // (l.f::HUGEINT + r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:split], ' ')
             JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[split + 1:], ' ')),
b AS (SELECT lang, k, phrase, a, w, min_by(struct_pack(l := l, r := r, score := score), (score, split)) AS m FROM s GROUP BY lang, k, phrase, a, w),
part AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
         FROM (SELECT lang, a AS f, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) s(m) WHERE m < k)),
wide AS (SELECT lang, phrase, max(f) AS wide FROM part GROUP BY ALL),
t AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY m.score DESC, a DESC, b.phrase) AS rank, b.phrase, a, m.l AS l, m.r AS r, n, m.score::BIGINT AS score
      FROM b JOIN n ON n.lang = b.lang LEFT JOIN wide ON wide.lang = b.lang AND wide.phrase = b.phrase WHERE wide IS NULL OR 100 * wide < {cover} * a)
SELECT * FROM t WHERE rank <= {top}"""
