"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

1. Every text becomes a 64-bit fingerprint (majority of the bits of its
   shingles' XXH64), row by row in Arrow batches.
2. Equal fingerprints collapse to one, so a text copied a billion times is one
   row of the comparison.
3. Fingerprints are laid in tiles. A tile holds fingerprints whose population
   counts agree in each of ``segments`` parts of the word; two words that differ in r
   bits differ by at most r in the sum of those counts' differences, so tile
   pairs further apart than the radius are never formed. No candidate is
   lost. A crowded tile is split in parts of about ``tile_rows`` rows.
4. Each tile meets the tiles within the radius once: numpy exclusive-or and
   bit counts over blocks, the tile in memory, its guests streamed.
5. Linked fingerprints become components (star contraction, distributed).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, picked, stream_tiles

BITS = 64
FLUSH = 100_000  # shingle hashes whose bits are unpacked at once (memory of a task)
PIECE = 1 << 20  # code points of a text cut in words at once; longer texts are folded piece by piece
BLOCK = 1 << 20  # pairs compared at once


def _hashed(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    return np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included.

    Words are the runs between ASCII white space, A-Z lower-cased. A text of
    fewer words gives its whole sequence, a text without words nothing.
    """
    return _hashed(_bytes(text or "").split(), shingle, seed)


def _word_runs(text: str):
    """The words of a long text, a piece at a time; a word that a piece cuts comes with the piece where it ends."""
    cut: list[bytes] = []
    for lo in range(0, len(text), PIECE):
        piece = _bytes(text[lo:lo + PIECE])
        words = piece.split()
        if cut and (not words or piece[:1].isspace()):
            words.insert(0, b"".join(cut))
            cut = []
        elif cut:
            cut.append(words[0])
            if len(words) > 1 or piece[-1:].isspace():
                words[0] = b"".join(cut)
                cut = []
            else:
                words = []
        if words and not cut and not piece[-1:].isspace():
            cut = [words.pop()]
        yield words
    if cut:
        yield [b"".join(cut)]


def _long_fingerprint(text: str, shingle: int, seed: int) -> int:
    """Fingerprint of a long text: bit counts are summed over its pieces, whose last words go on into the next."""
    counts, total = np.zeros(BITS, np.int64), 0
    held: list[bytes] = []
    for words in _word_runs(text):
        held += words
        if len(held) < shingle + 1:
            continue
        hashes = _hashed(held, shingle, seed)
        held = held[len(held) - shingle + 1:] if shingle > 1 else []
        total += len(hashes)
        for lo in range(0, len(hashes), FLUSH):
            counts += _bits(hashes[lo:lo + FLUSH]).sum(axis=0, dtype=np.int64)
    if not total or len(held) == shingle:  # what was held back makes the only shingle, or the last one
        hashes = _hashed(held, shingle, seed)
        total += len(hashes)
        counts += _bits(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each non-empty array: bit set in over half of its hashes."""
    sizes = np.array([len(h) for h in hashes])
    bits = _bits(np.concatenate(hashes))
    counts = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64)
    over = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_texts(texts, shingle: int, seed: int) -> np.ndarray:
    """Fingerprints (uint64) of a sequence of texts; zero for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    waiting: list[np.ndarray] = []
    rows: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if text and len(text) > PIECE:
            out[i] = _long_fingerprint(text, shingle, seed)
            continue
        h = shingle_hashes(text, shingle, seed)
        if not len(h):
            continue
        waiting.append(h)
        rows.append(i)
        held += len(h)
        if held >= FLUSH:
            out[rows] = _majority(waiting)
            waiting, rows, held = [], [], 0
    if rows:
        out[rows] = _majority(waiting)
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, marks: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``id``, ``fp`` (the 64 bits as a signed long) and the long columns ``marks``.

    Null and blank texts have fingerprint zero; whole texts are used.
    """
    src = picked(docs, id=id_col, text=text_col, **{m: m for m in marks})
    id_type = src.schema["id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            fp = fingerprint_texts(pdf["text"].tolist(), shingle, seed)
            yield pd.DataFrame({"id": pdf["id"], "fp": fp.view(np.int64), **{m: pdf[m] for m in marks}})

    return src.mapInPandas(run, ", ".join([f"id {id_type}, fp bigint", *[f"{m} bigint" for m in marks]]))


def _offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Count differences within the radius, one of each opposite pair (and not zero)."""
    ball = [
        d for d in itertools.product(range(-radius, radius + 1), repeat=segments)
        if 0 < sum(map(abs, d)) <= radius
    ]
    return [d for d in ball if d > tuple(-x for x in d)]


def near_pairs(fps: DataFrame, radius: int, segments: int = 4, tile_rows: int = 4096) -> DataFrame:
    """All pairs ``(a, b)`` of the distinct long column ``fp`` at ``radius`` or fewer bits."""
    width = BITS // segments
    counts = [
        F.expr(f"CAST(bit_count(shiftrightunsigned(fp, {i * width}) & {(1 << width) - 1}L) AS BIGINT)")
        for i in range(segments)
    ]
    pack = lambda cs: sum((F.shiftleft(c, 8 * i) for i, c in enumerate(cs)), F.lit(0).cast("bigint"))
    placed = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    placed = placed.select("*", pack([F.col(f"c{i}") for i in range(segments)]).alias("cls"))
    parts = placed.groupBy("cls").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    part = lambda n: F.pmod(F.xxhash64(F.lit(1), "fp"), n).cast("int")

    own = placed.join(parts, "cls").select("fp", "cls", part(F.col("parts")).alias("own"))
    at_home = own.select(
        "fp", "cls", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("part"), "own",
    ).select("fp", "cls", "part", (F.col("part") < F.col("own")).cast("int").alias("guest"))
    laid = at_home
    shifts = _offsets(segments, radius)
    if shifts:  # guests of the tiles within the radius
        offsets = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(f"d{i}") for i, x in enumerate(d)]) for d in shifts])
        moved = [F.col(f"c{i}") + F.col(f"o.d{i}") for i in range(segments)]
        laid = laid.union(
            placed.select("*", F.explode(offsets).alias("o"))
            .where(" AND ".join(f"c{i} + o.d{i} BETWEEN 0 AND {width}" for i in range(segments)))
            .select("fp", pack(moved).alias("cls")).join(parts, "cls")
            .select("fp", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("guest")))
    dealt = laid.repartition("cls", "part").sortWithinPartitions("cls", "part", "guest")

    def load(pdf):
        return [pdf["fp"].to_numpy().view(np.uint64)]

    def meet(x, y, inner):
        return _compare(x[0], y[0], radius, inner)

    def run(it):
        for found in stream_tiles(it, ["cls", "part"], load, meet, tile_rows):
            if found:
                a = np.concatenate([x for x, _ in found]).view(np.int64)
                b = np.concatenate([y for _, y in found]).view(np.int64)
                yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(run, "a bigint, b bigint")


def _compare(x: np.ndarray, y: np.ndarray, radius: int, inner: bool = False) -> list:
    """Pairs of x with y (inner: each unordered pair once) within the radius, block by block."""
    out = []
    if not len(x) or not len(y):
        return out
    step = max(1, BLOCK // len(y))
    for lo in range(0, len(x), step):
        near = np.bitwise_count(x[lo:lo + step, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        if inner:
            i, j = i[(keep := i + lo < j)], j[keep]
        if len(i):
            out.append((x[lo + i], y[j]))
    return out


def _rooted(first: DataFrame, radius: int, segments: int, tile_rows: int) -> DataFrame:
    """``fp, least`` of the distinct fingerprints, with the ``root`` of each one's component."""
    roots = components(near_pairs(first.select("fp"), radius, segments, tile_rows))
    return first.join(roots, first["fp"] == roots["id"], "left").select(
        first["fp"], "least", F.coalesce("root", first["fp"]).alias("root")
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    radius: int = 2, seed: int = 42, segments: int = 4, tile_rows: int = 4096,
) -> DataFrame:
    """Near-duplicate groups: ``<id_col>``, ``fingerprint`` (16 hex digits), ``component_id``.

    One row per input row. ``component_id`` is the smallest id reachable over
    links (fingerprints at ``radius`` or fewer differing bits), itself
    included. Null and blank texts share fingerprint zero, linked like any
    other. A row with a null id is grouped and never names a group unless the
    group has no other id. An empty table gives an empty result; extra columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    named = _rooted(marked.groupBy("fp").agg(F.min("id").alias("least")), radius, segments, tile_rows)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.join(names, "root").select(F.col("fp"), "component_id")
    return marked.join(table, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the first by id, text hash and hash of the whole row.

    All columns are kept. Rows that share an id are rows of their own: one whose
    text is in another group counts there. Rows with a null id stay only where no
    row of their group has an id, one for each distinct text.
    """
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    rows = docs.withColumns({
        "_echoset_t": F.xxhash64(f"`{text_col}`"), "_echoset_r": F.xxhash64(*whole, *[c.isNull() for c in whole])})
    marks = ("_echoset_t", "_echoset_r")
    marked = cut(fingerprints(rows, id_col, text_col, kw.get("shingle", 3), kw.get("seed", 42), marks))
    first = marked.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", *marks))).alias("least"))
    named = _rooted(first, kw.get("radius", 2), kw.get("segments", 4), kw.get("tile_rows", 4096))
    picks = named.groupBy("root").agg(F.min("least").alias("least")).where("least IS NOT NULL").select(
        F.col("least.id").alias("_echoset_id"), *[F.col(f"least.{m}").alias(f"{m}_") for m in marks])
    same = (F.col(f"`{id_col}`") == F.col("_echoset_id")) & (F.col("_echoset_t") == F.col("_echoset_t_")) & (
        F.col("_echoset_r") == F.col("_echoset_r_"))
    kept = rows.join(picks, same, "left_semi").dropDuplicates([id_col, *marks]).drop(*marks)  # those left are equal
    if not docs.where(F.col(f"`{id_col}`").isNull()).take(1):
        return kept
    nameless = docs.where(F.col(f"`{id_col}`").isNull())
    src = picked(docs, id=id_col, text=text_col)
    marks = simhash_groups(src, "id", "text", **kw)
    lone = marks.where("id IS NULL AND component_id IS NULL").select("fingerprint").distinct()
    prints = fingerprints(src.where("id IS NULL").select(F.xxhash64("text").alias("id"), "text"), "id", "text",
                          kw.get("shingle", 3), kw.get("seed", 42))
    stay = prints.select(F.col("id").alias("_echoset_hash"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")).join(
        lone, "fingerprint", "left_semi").select("_echoset_hash").distinct()
    nameless = nameless.join(stay, F.xxhash64(f"`{text_col}`") == F.col("_echoset_hash"), "left_semi")
    return kept.unionByName(nameless.dropDuplicates([text_col]))
