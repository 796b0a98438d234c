"""Groups kept up to date while documents arrive (S4-S6), vectors and edges that are used again.

:class:`GroupStore` is a folder of Parquet tables, each with one partition a batch:

* ``contents`` — one row per distinct text: a 128-bit key, its first position, its vector, and the
  leader it belongs to (itself, if it leads), with the similarity;
* ``items`` — one row per item: its position and the position of its text's first occurrence.

Later items never change an earlier leader, so a batch is compared with the stored leaders and with
itself only, and a text that is stored already is not encoded again. A batch that is
appended twice (a retry) replaces its own partitions and gives the same rows.

:class:`EdgeStore` keeps the pairs of one pair job at the lowest threshold, range-partitioned by
similarity and sorted; groups at any higher threshold read only the files that hold such pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoset.operators.embed import DEFAULT_DIM, with_hashing_counts
from echoset.operators.grouping import assign_members, greedy_leaders
from echoset.operators.leaders import group_onto
from echoset.session import Scratch, let_go

KEYS = ["k1", "k2"]
SCHEMAS = {
    "contents": "k1 bigint, k2 bigint, pos bigint, idx array<int>, cnt array<bigint>, sq bigint, leader bigint, similarity double, batch int",
    "items": "pos bigint, first bigint, batch int",
}


def _keyed(items: DataFrame, order: str, text: str) -> DataFrame:
    return items.where(F.col(text).isNotNull()).select(
        F.col(order).cast("bigint").alias("pos"), F.col(text).alias("text"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.reverse(F.col(text))).alias("k2"))


class GroupStore:
    """Corpus-wide groups of texts in ``path``, at one threshold; appended to batch by batch in position order."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, dim: int = DEFAULT_DIM):
        self.spark, self.path, self.threshold, self.dim = spark, path, float(threshold), dim

    def _read(self, table: str, before: int | None = None) -> DataFrame:
        """A table's rows, of earlier batches only if ``before`` is given; none if nothing is stored."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")
        return df if before is None else df.where(F.col("batch") < before)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(f"{self.path}/{table}"))

    def append(self, items: DataFrame, batch: int, order: str, text: str = "text") -> dict:
        """Add a batch (numbers ascend; its positions lie after those of earlier batches); returns counts."""
        with Scratch(self.spark) as scratch:
            rows = scratch.keep(_keyed(items, order, text))
            first = rows.groupBy(*KEYS).agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
            stored = self._read("contents", batch)
            fresh = first.join(stored.select(*KEYS), KEYS, "left_anti")
            new = scratch.keep(with_hashing_counts(fresh, "text", self.dim).drop("text"))
            let_go(self.spark)
            leaders = stored.where("leader = pos").select("pos", "idx", "cnt", "sq")
            led = group_onto(new, leaders, self.threshold).select(
                F.col("b").alias("pos"), F.col("a").alias("leader"), F.col("sim").alias("similarity")).checkpoint(eager=True)
            contents = new.join(led, "pos", "left").withColumn("leader", F.coalesce("leader", "pos"))
            places = new.select(*KEYS, F.col("pos").alias("first")).unionByName(stored.select(*KEYS, F.col("pos").alias("first")))
            self._write(contents, "contents", batch)
            self._write(rows.select(*KEYS, "pos").join(places, KEYS).select("pos", "first"), "items", batch)
            return {"items": rows.count(), "encoded": new.count(), "led": led.count()}

    def members(self, order: str) -> DataFrame:
        """All groups so far: ``leader_<order>, <order>, is_leader, similarity``; groups of one are left out."""
        items, contents = self._read("items"), self._read("contents")
        own = contents.select(F.col("pos").alias("first"), "leader", "similarity", (F.col("sq") > 0).alias("real"))
        # a copy of a leader is like it unless the text has no words
        rows = items.select("pos", "first").join(own, "first").where("leader <> first OR pos = first OR real")
        sizes = rows.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
        is_leader = F.col("pos") == F.col("leader")
        return rows.join(sizes, "leader", "left_semi").select(
            F.col("leader").alias(f"leader_{order}"), F.col("pos").alias(order), is_leader.alias("is_leader"),
            F.when(is_leader, None).when(F.col("first") == F.col("leader"), 1.0).otherwise(F.col("similarity")).alias("similarity"))


class EdgeStore:
    """Edges ``scope..., a, b, sim`` in ``path``, written once, read at any threshold from the lowest up."""

    def __init__(self, spark: SparkSession, path: str, scope: list[str]):
        self.spark, self.path, self.scope = spark, path, scope

    def write(self, edges: DataFrame, parts: int | None = None) -> None:
        """``edges`` hold pairs of distinct vertices; ``parts`` defaults to ``spark.sql.shuffle.partitions``."""
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        edges.select(*self.scope, "a", "b", "sim").repartitionByRange(n, "sim").sortWithinPartitions("sim").write.mode("overwrite").parquet(self.path)

    def edges(self, threshold: float) -> DataFrame:
        """A scan with the similarity pushed down: files and row groups below the threshold are skipped."""
        return self.spark.read.parquet(self.path).where(F.col("sim") >= F.lit(float(threshold)))

    def groups(self, threshold: float) -> DataFrame:
        """``scope..., leader, member, sim`` at ``threshold``: no text is encoded and no pair compared again."""
        edges = self.edges(threshold)
        return assign_members(edges, greedy_leaders(edges, self.scope), self.scope)
