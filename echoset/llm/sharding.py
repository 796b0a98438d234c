"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in id order (a range exchange, counts of its
partitions, prefix sums). A keyed Feistel network permutes the smallest
even-bit domain that holds n; numbers that fall outside 0..n-1 are sent
through again until they fall inside (cycle walking), which leaves a
permutation of exactly 0..n-1. The shuffled place p goes to shard p mod shards,
slot p div shards: shard sizes differ by one row at most, slots have no gaps, and both
directions are computed from (n, shards, key) alone, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

ROUNDS = 6


def _round_keys(key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, np.uint64)


def _half_bits(n: int) -> int:
    """Bits of one half of the smallest even-bit domain of n numbers or more."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_scramble(left, k) & mask), left
        else:
            left, right = right, left ^ (_scramble(right, k) & mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where the keyed permutation of 0..n-1 sends each number (back: which number is sent there)."""
    half, keys = _half_bits(n), _round_keys(key)
    out = np.asarray(x, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _network(out[walking], half, keys, back)
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def place_of(rows: np.ndarray, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(rows, n, key)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: int) -> np.ndarray:
    """The global row number that stands at (shard, slot)."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, back=True)


def number_rows(df: DataFrame, order: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """Adds ``row``, the rank of each row in ``order`` (0, 1, ...); and the number of rows.

    A range exchange by ``order``, then each partition's rows are counted on
    from the sum of the counts before it: no window over one partition. Rows equal in ``order`` may
    share a partition only with their like, so give enough columns.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | place
    part = F.shiftright("_at", 33)
    counts = sorted(numbered.groupBy(part.alias("part")).count().collect())  # one row a partition
    base, n, bases = {}, 0, []
    for p, c in counts:
        base[p], n = n, n + c
    bases = [(int(p), int(b)) for p, b in base.items()]
    table = df.sparkSession.createDataFrame(bases, "part bigint, base bigint")
    row = F.col("base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("part", part).join(F.broadcast(table), "part")
        .withColumn("row", row).drop("part", "base", "_at"), n
    )


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, key: int = 20240229,
) -> DataFrame:
    """A shard and slot for every row: ``<id_col>``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 16 (null text: none), ``law`` is
    ``rows`` (shard counts at most one apart), ``grown_shard`` is null: that law
    moves rows between shards when there are more of them. Rows are numbered
    by (id, crc32, size), nulls first, so the result depends on the rows alone; equal
    rows are interchangeable. An empty table gives an empty result.
    """
    src = picked(docs, id=id_col, text=text_col).select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(src, ["id", "text_crc32", "size"])
    id_type = src.schema["id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            shard, slot = place_of(pdf.pop("row").to_numpy(), n, shards, key)
            yield pdf.assign(shard=shard, slot=slot)

    placed = numbered.mapInPandas(run, f"id {id_type}, size bigint, text_crc32 bigint, shard int, slot bigint")
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
