"""Helpers shared by the training-data operators: tables, checkpoints, components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoset.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark (any file system Spark knows)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package for the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def picked(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns, under internal names: other columns cannot clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: rows ``(id, root)``.

    ``root`` is the smallest id of the component; only ids with an edge appear.
    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step is an aggregation by vertex and a join back, so no component and no
    neighbourhood is ever gathered in one task. Each round is checkpointed in
    the shared folder; the loop ends when the edges no longer change.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct()
    )
    mark = _fingerprint(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        e = cut(_small_star(_large_star(e)))
        new = _fingerprint(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def _fingerprint(e: DataFrame) -> tuple:
    """Count and an order-free hash of an edge table (scalars)."""
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(e: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of its neighbourhood."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours, and itself, to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stream_tiles(it, keys: list[str], load: Callable, meet: Callable, tile_rows: int):
    """Run over batches sorted by ``keys`` and ``guest``: each tile meets its guests.

    ``load(pdf)`` gives arrays with one entry per row; the rows with guest = 0
    of one key are its tile and stay in memory, the guests are streamed past it.
    ``meet(x, y, inner)`` compares two lists of arrays (inner: x with itself)
    and returns a list of findings; the findings of each batch are yielded.
    """
    key, home = None, []
    for pdf in it:
        k = pdf[keys].to_numpy()
        guest, cols = pdf["guest"].to_numpy(), load(pdf)
        edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *edges.tolist(), len(k)]
        found: list = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            if s == e:
                continue
            if key is None or (k[s] != key).any():
                key, home = k[s], [c[:0] for c in cols]
            mid = s + int(np.searchsorted(guest[s:e], 1))
            for lo in range(s, mid, tile_rows):
                new = [c[lo:min(mid, lo + tile_rows)] for c in cols]
                found += meet(new, home, False)
                found += meet(new, new, True)
                home = [np.concatenate(x) for x in zip(home, new)]
            found += meet([c[mid:e] for c in cols], home, False)
        yield found
