"""Positions in a total order over a whole table, and exact quantiles from them.

Rows are dealt to ranges of the order and sorted there; the driver sees one total per
range, whose prefix sums are the ranges' first positions. No task holds more than its
range, however large one group is, and no window runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE, ROW = "_echoset_range", "_echoset_row"


def running_total(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum (bigint) of ``weight`` over the row and all rows before it.

    ``order`` should tell all rows apart: rows that tie are put in any order, and all of them in one range.
    Checkpointed, so a range that is computed again after a lost executor cannot differ.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn(ROW, F.monotonically_increasing_id()).withColumn(RANGE, F.shiftright(ROW, 33)).checkpoint(eager=True)
    sums = dealt.groupBy(RANGE).agg(F.sum(weight).cast("bigint").alias("w")).collect()  # one row per range
    before, rows = 0, []
    for r in sorted(sums):
        rows.append((r[RANGE], before))
        before += r["w"]
    bases = df.sparkSession.createDataFrame(rows, f"{RANGE} bigint, _echoset_before bigint")
    inside = F.sum(weight).over(Window.partitionBy(RANGE).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_echoset_inside", inside).join(F.broadcast(bases), RANGE)
    return out.withColumn(name, (F.col("_echoset_before") + F.col("_echoset_inside")).cast("bigint")).drop(
        RANGE, ROW, "_echoset_before", "_echoset_inside")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1-based position of each row in ``order`` (integer-valued bigint)."""
    return running_total(df, order, F.lit(1), name)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``keys..., <name>...``: exact continuous quantiles (linear between neighbours) of each group's values.

    Equal values are counted first (combined before the shuffle), so neither a group of
    any size nor a value repeated without end is held by a task. Nulls do not count;
    groups without values are absent; null keys are a group of their own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k) for k in keys], F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, [*[F.col(k) for k in keys], F.col("_v")], F.col("_n"), "_upto").checkpoint(eager=True)
    groups = placed.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_size"))
    groups = groups.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_start", "_size")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    met = placed.join(groups, same)  # a hot group's side may be split by skew-join handling
    first = F.col("_upto") - F.col("_n") - F.col("_start")
    picks = []
    for name, p in quantiles.items():
        place = F.lit(float(p)) * (F.col("_size") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((first <= rank) & (rank < first + F.col("_n")), F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    found = met.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_part")).alias(q) for q in quantiles])
