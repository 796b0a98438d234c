"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases' names are parsed again, and so on
until one name is left. On every level

1. runs of equal symbols become one symbol;
2. deterministic coin tossing gives each symbol a label from itself and the
   one before (the lowest bit in which they differ, and its value); four
   rounds leave six labels, one more pass three, and neighbours always differ;
3. a phrase starts at each local maximum of the labels and has two to five symbols;
   its name is a hash of its symbols.

Where a phrase starts depends on a few symbols to either side and never on its place, so
equal substrings have equal phrases inside, whatever stands around them. A
fingerprint holds the least names (of a text's set of names: a uniform sample) of the
phrases of level ``MAIN`` and above, about 15 characters and longer; a text with
few of these adds the least names of its shorter phrases.

Texts flow through the levels in blocks of symbols, many short texts or a part of a
long one at a time; each level holds back the few symbols that are not decided, so
the memory does not grow with the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked
from .words import mix

MAIN = 2  # level from which names count as main ones (levels from 0)
NAMES = (64, 16)  # main and shorter names kept
ENOUGH = 32  # main names from which the shorter ones are not needed
BLOCK = 1 << 18  # symbols parsed at once
BATCH = 1 << 22  # code points of whole texts held at once; a longer text is alone
SHORT = 12  # code points below which single symbols count as shorter names too
LEFT, RIGHT = 12, 8  # symbols that decide where a phrase starts, and more
SHIFT = np.uint64(16)  # names are sampled by their upper 48 bits; the lower 16 carry the text's number
_Q = np.uint64(0xD6E8FEB86659FD93)


def _toss_table() -> np.ndarray:
    """Label of (symbol before, symbol), both below 128."""
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    low = np.where(a == b, 1, (a ^ b) & -(a ^ b))
    at = np.log2(low).astype(np.int64)
    return (2 * at + ((b >> at) & 1)).astype(np.uint8).ravel()


def _free_table() -> np.ndarray:
    """The least of 0, 1, 2 that neither neighbour has (7: no neighbour)."""
    return np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)


_TOSS, _FREE = _toss_table(), _free_table()


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0, 1, 2 of symbols of which neighbours differ; ``first``: places where texts start."""
    before = np.empty_like(sym)
    before[1:] = sym[:-1]
    before[first] = ~sym[first]
    x = sym ^ before
    at = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    at = np.minimum(at, 63)
    label = (2 * at + ((sym >> at.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint16)
    for _ in range(3):
        place = np.empty_like(label)
        place[1:] = label[:-1]
        place[first] = label[first] ^ 1
        label = _TOSS[(place << 7) | label].astype(np.uint16)
    label = label.astype(np.uint8)
    lone = np.zeros(len(sym) + 1, bool)
    lone[first] = lone[-1] = True
    for high in (5, 4, 3):
        i = np.flatnonzero(label == high)
        left = np.where(lone[i], 7, label[i - 1])
        right = np.where(lone[i + 1], 7, label[np.minimum(i + 1, len(label) - 1)])
        label[i] = _FREE[8 * np.minimum(left, 7) + np.minimum(right, 7)]
    return label


class _Level:
    """One level: takes symbols and the number of the text each belongs to, gives phrases' names."""

    def __init__(self):
        self.run = None  # the open run: symbol, text, length
        self.sym, self.doc, self.done = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def _runs(self, sym: np.ndarray, doc: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        size = 0
        if self.run is not None:
            sym, doc, size = np.append(self.run[0], sym), np.append(self.run[1], doc), self.run[2] - 1
        if not len(sym):
            return sym, doc
        starts = np.flatnonzero(np.append(True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])))
        count = np.diff(starts, append=len(sym))
        count[0] += size
        sym, doc = sym[starts], doc[starts]
        self.run = None
        if not last:
            self.run = (sym[-1:], doc[-1:], int(count[-1]))
            sym, doc, count = sym[:-1], doc[:-1], count[:-1]
        many = np.flatnonzero(count > 1)
        if len(many):
            sym = sym.copy()
            sym[many] = mix(sym[many] * _Q + count[many].astype(np.uint64))
        return sym, doc

    def feed(self, sym: np.ndarray, doc: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, texts and lengths (in symbols) of the phrases that are decided."""
        sym, doc = self._runs(sym, doc, last)
        sym, doc = np.concatenate([self.sym, sym]), np.concatenate([self.doc, doc])
        n = len(sym)
        known = n if last else n - RIGHT
        if known <= self.done:
            self.sym, self.doc = sym, doc
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        begins = np.append(True, doc[1:] != doc[:-1])
        label = _labels(sym, np.flatnonzero(begins))
        start = begins.copy()
        start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begins[1:-1] & ~begins[2:]
        start[1:] &= ~begins[:-1] | begins[1:]  # no phrase of one symbol at the start of a text
        at = np.flatnonzero(start[:known])
        at = at[np.searchsorted(at, self.done):]
        if not last:  # the last start is known, its end is not
            ends, at, keep = at[1:], at[:-1], int(at[-1]) if len(at) else self.done
        else:
            ends, keep = np.append(at[1:], n), n
        length = ends - at
        name = np.zeros(len(at), np.uint64)
        for j in range(int(length.max(initial=0))):
            held = j < length
            name = np.where(held, name * _Q + sym[np.minimum(at + j, n - 1)], name)
        out = mix(name * _Q + length.astype(np.uint64)), doc[at], length
        low = max(0, keep - LEFT)
        self.sym, self.doc, self.done = sym[low:], doc[low:], keep - low
        return out


class Least:
    """The least distinct names of each text: main ones and shorter ones."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = [[], []]
        self.size = [0, 0]

    def add(self, kind: int, names: np.ndarray, docs: np.ndarray) -> None:
        low = np.uint64((1 << 16) - 1)
        self.held[kind].append((docs.astype(np.uint64) << np.uint64(48)) | ((names >> SHIFT) & ~(low << np.uint64(48))))
        self.size[kind] += len(names)
        if self.size[kind] > BATCH:
            self._settle(kind)

    def _settle(self, kind: int) -> np.ndarray:
        keys = np.sort(np.concatenate([np.empty(0, np.uint64), *self.held[kind]]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[:len(keys)]]
        doc = keys >> np.uint64(48)
        rank = np.arange(len(keys)) - np.searchsorted(doc, doc)
        keys = keys[rank < NAMES[kind]]
        self.held[kind], self.size[kind] = [keys], len(keys)
        return keys

    def result(self, n: int) -> list[list[np.ndarray]]:
        """For each kind the names (48 bits, ascending) of texts 0 to n - 1."""
        out = []
        for kind in (0, 1):
            keys = self._settle(kind)
            cuts = np.searchsorted(keys >> np.uint64(48), np.arange(n + 1, dtype=np.uint64))
            names = keys & np.uint64((1 << 48) - 1)
            out.append([names[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        return out


def parse(blocks: Iterator[tuple[np.ndarray, np.ndarray]], found: Callable) -> None:
    """Parse texts that come as blocks of (symbols, texts' numbers); ``found(level, names, docs)`` gets the phrases."""
    levels: list[_Level] = []

    def feed(k: int, sym, doc, last: bool) -> None:
        while True:
            if k == len(levels):
                if not len(sym):
                    return
                levels.append(_Level())
            sym, doc, length = levels[k].feed(sym, doc, last)
            if k:  # a text of one symbol ended a level ago
                more = length > 1
                sym, doc = sym[more], doc[more]
            if len(sym):
                found(k, sym, doc)
            k += 1

    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    for sym, doc in blocks:
        feed(0, sym, doc, False)
    if levels:
        feed(0, *empty, True)


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts one after another, at most ``BLOCK`` at once."""
    held, docs, size = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), BLOCK):
            piece = text[lo:lo + BLOCK]
            held.append(piece)
            docs.append((i, len(piece)))
            size += len(piece)
            if size >= BLOCK:
                yield _codes(held, docs)
                held, docs, size = [], [], 0
    if size:
        yield _codes(held, docs)


def _codes(held: list[str], docs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    raw = "".join(held).encode("utf-32-le", "surrogatepass")
    number, size = np.array(docs, np.int64).T
    return np.frombuffer(raw, "<u4").astype(np.uint64), np.repeat(number, size)


def sketch_texts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(main names, shorter names) of each text; shorter ones only where main ones are few."""
    out = []
    for lo in range(0, len(texts), 1 << 16):
        some, least = texts[lo:lo + (1 << 16)], Least()
        parse(_blocks(some), lambda k, names, docs: least.add(int(k < MAIN), names, docs))
        tiny = [(i, ord(c)) for i, t in enumerate(some) if len(t) < SHORT for c in t]
        if tiny:
            number, code = np.array(tiny, np.int64).T
            least.add(1, mix(code.astype(np.uint64)), number)
        main, short = least.result(len(some))
        out += [(m, s if len(m) < ENOUGH else s[:0]) for m, s in zip(main, short)]
    return out


def fingerprint_string(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """Names as eight hex digits each (their upper 32 bits), main ones, a dot, shorter ones."""
    return ".".join((names >> np.uint64(16)).astype(">u4").tobytes().hex() for names in sketch)


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    main, short = text.split(".")
    return tuple(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (main, short))


def _share(a: list, b: list, most: int) -> float:
    """Names in common of two samples, as 2 |A and B| / (|A| + |B|) of the sets they come from."""
    x, y = set(a), set(b)
    least = sorted(x | y)[:most]
    common = sum(1 for v in least if v in x and v in y)
    ratio = common / len(least) if least else 1.0
    return 2 * ratio / (1 + ratio)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: the share of phrases in common.

    Main names decide; the fewer of them (of ``ENOUGH``) the one with fewer has, the more
    the shorter phrases' names say, if both have them. Two texts without
    phrases are alike, one without is unlike any other.
    """
    if a == b:
        return 1.0
    if a == "." or b == ".":
        return 0.0
    (ma, sa), (mb, sb) = (tuple(x.tolist() for x in read_fingerprint(f)) for f in (a, b))
    if not sa or not sb:
        return _share(ma, mb, NAMES[0]) if ma and mb else 0.0
    weight = min(1.0, min(len(ma), len(mb)) / ENOUGH)
    main = _share(ma, mb, NAMES[0]) if ma and mb else 0.0
    return weight * main + (1 - weight) * _share(sa, sb, NAMES[1])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>``, ``fingerprint``: one row per input row, where it lies. Null texts count as empty."""
    src = picked(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            texts = [t or "" for t in pdf["text"]]
            for lo, hi in _runs_of(texts):
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi], "fingerprint": [fingerprint_string(s) for s in sketch_texts(texts[lo:hi])]})

    return src.mapInPandas(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _runs_of(texts: list[str], limit: int = BATCH):
    """(from, to) of runs of about ``limit`` code points."""
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > limit:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def in_ranges(src: DataFrame, parts: int) -> DataFrame:
    """Rows ``id, text`` in ``parts`` partitions by descending id, each followed by the next one's first rows.

    ``guest``: 1 for the rows that come from the next partition (after the last: from the first);
    they are sorted behind the others. The bounds are quantiles of the ids alone; only
    the first id of each partition (``parts`` numbers) comes to the driver. Null ids come
    last. Rows that share the id of a partition's first row are all its guests before.
    """
    spark = src.sparkSession
    ids = src.select(F.col("id").cast("double").alias("x")).where("x IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="x", outputCol="b", handleInvalid="keep") if cuts else None
    placed = src.withColumn("x", F.col("id").cast("double"))
    place = split.transform(placed).withColumn("b", F.col("b").cast("int")) if split else placed.withColumn("b", F.lit(0))
    top = len(cuts)
    place = place.withColumn("part", F.when(F.col("id").isNull(), top + 1).otherwise(top - F.col("b"))).drop("x", "b")
    firsts = sorted((r["part"], r["first"]) for r in place.select("id", "part").groupBy("part").agg(F.max("id").alias("first")).collect())
    if not firsts:
        return src.sparkSession.createDataFrame([], "id bigint, text string, part int, guest int")
    owner = [(firsts[k - 1][0], first) for k, (_, first) in enumerate(firsts)]  # the one before; of the first: the last
    seats = spark.createDataFrame(owner, "seat int, first bigint")
    both = place.join(F.broadcast(seats), F.col("id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("seat").alias("part"), F.lit(1).alias("guest"))
    both = both.select("id", "text", F.explode(F.when(F.col("seat").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("p"))
    return (
        both.select("id", "text", F.col("p.part").alias("part"), F.col("p.guest").alias("guest"))
        .repartitionById(top + 2, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), F.xxhash64("text"), "text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every text's fingerprint and that of its edited text, whose second half comes from the next document.

    Per row: ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Documents stand in descending id order, the first after the last; the last
    n_chars // 2 code points of a text are replaced by as many of the next one's first (or all of it).
    Null texts count as empty, which have the fingerprint ``.``; ids are integers, null ids come last,
    rows that share an id stand in the order of their texts' hash and text; a single row is its own
    next. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    src = picked(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(it):
        late = None  # the row whose next is not known
        for pdf in it:
            part, guest = pdf["part"].tolist(), pdf["guest"].tolist()
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for lo, hi in _runs_of(texts):
                prints = [fingerprint_string(s) for s in sketch_texts(texts[lo:hi])]
                rows = list(zip(part[lo:hi], guest[lo:hi], ids[lo:hi], texts[lo:hi], prints))
                line = rows if late is None else [late, *rows]
                late = line[-1]
                pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1] and a[0] == b[0]]
                edited = [a[3][:len(a[3]) - len(a[3]) // 2] + b[3][:len(a[3]) // 2] for a, b in pairs]
                changed = [fingerprint_string(s) for s in sketch_texts(edited)]
                yield pd.DataFrame({
                    "id": pd.Series([a[2] for a, _ in pairs], dtype="Int64"),
                    "n_chars": np.array([len(a[3]) for a, _ in pairs], np.int64),
                    "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                    "fingerprint": [a[4] for a, _ in pairs], "edited_fingerprint": changed,
                    "near_edited": np.array([likeness(a[4], e) for (a, _), e in zip(pairs, changed)], np.float64),
                    "near_next": np.array([likeness(a[4], b[4]) for a, b in pairs], np.float64),
                })

    out = in_ranges(src, parts).mapInPandas(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
