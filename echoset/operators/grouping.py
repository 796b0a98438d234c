"""Greedy leader grouping (G1-G5) over an edge table.

The reference walks texts in order: the first ungrouped text leads a group and
takes every later ungrouped text with similarity >= t to the leader. Members
are compared with the leader only, so this is *not* connected components.

Set form used here (exactly equal to the walk, because only j > i is ever
compared and cosine is symmetric): on the graph of edges ``a < b``,

* ``v`` is a leader  <=>  no earlier *leader* is adjacent to ``v``;
* a non-leader's group is its smallest adjacent leader.

That is the lexicographically-first maximal independent set, computed in
parallel rounds (Blelloch, Fineman, Shun, SPAA 2012). A round resolves more than the vertices
without an undecided earlier neighbour: the edges are dealt in ranges of their later end's
position, about ``RANGE_EDGES`` each, and a task walks its range in order and decides every vertex whose
earlier neighbours it can tell, so a chain of dependent vertices costs a round for each range that it
crosses and not one for every two links. Decided vertices leave the active edge table. Rounds are
checkpointed to ``spark.checkpoint.dir``, so lineage stays short and lost executors only cost the
current round. A task streams its sorted edges and holds the states of its range's vertices.

Scopes that fit in one block never get here: their groups come straight from
the pair job (``block_groups``).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoset.session import ensure_checkpoint_dir

RANGE_EDGES = 500_000  # edges walked in one task


def _resolved(active: DataFrame, scope: list[str], ranges: int) -> DataFrame:
    """``(scope..., v, leads)``: later ends of edges that a walk of their own range decides."""
    keys = [*scope, "b"]
    if ranges > 1:  # an earlier end that is no edge's later end leads; ends in other ranges are unknown
        later = active.select(*scope, F.col("b").alias("a")).distinct().withColumn("known", F.lit(False))
        marked = active.join(later, [*scope, "a"], "left").withColumn("known", F.coalesce("known", F.lit(True)))
        dealt = marked.repartitionByRange(ranges, *keys)
    else:
        dealt = active.withColumn("known", F.lit(True)).coalesce(1)
    fields = [active.schema[c] for c in scope]
    schema = T.StructType([*fields, T.StructField("v", active.schema["b"].dataType), T.StructField("leads", T.BooleanType())])

    def walk(it):
        states: dict = {}
        key, led, unknown = None, False, False
        done: list = []

        def settle():
            if key is not None:
                states[key] = False if led else None if unknown else True
                if states[key] is not None:
                    done.append((*key, states[key]))

        for pdf in it:
            cols = [pdf[c].tolist() for c in (*keys, "a", "known")]
            for *k, a, known in zip(*cols):
                k = tuple(k)
                if k != key:
                    settle()
                    if key is not None and k[:-1] != key[:-1]:
                        states.clear()
                    key, led, unknown = k, False, False
                leads = states.get((*k[:-1], a), known or None)
                led |= leads is True
                unknown |= leads is None
            if done:
                yield pd.DataFrame(done, columns=[*scope, "v", "leads"])
                done = []
        settle()
        if done:
            yield pd.DataFrame(done, columns=[*scope, "v", "leads"])

    return dealt.sortWithinPartitions(*keys, "a").mapInPandas(walk, schema)


def greedy_leaders(edges: DataFrame, scope: list[str], max_rounds: int | None = None, stats: dict | None = None,
                   edges_checkpointed: bool = False, range_edges: int | None = None) -> DataFrame:
    """Leaders ``(scope..., v)`` among vertices that have at least one edge.

    Rounds record *members*; every vertex of the graph is either a member or
    a leader, so leaders are the vertices that never became members. (A
    vertex can turn leader by isolation — all its remaining edges vanish when
    its later neighbours join other leaders — and must still count, since it
    may be the smallest leader adjacent to one of them.) Vertices without
    edges lead groups of one, which are never reported.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    active = edges.select(*scope, "a", "b")
    if not edges_checkpointed:  # every round re-reads it: cut its lineage first
        active = active.checkpoint(eager=True)
    vertices = (active.select(*scope, F.col("a").alias("v"))
                .unionByName(active.select(*scope, F.col("b").alias("v"))).distinct())
    members: list[DataFrame] = []
    rounds = 0
    while True:
        n = active.count()
        if n == 0:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"greedy grouping: {n} active edges left after {rounds} rounds")
        rounds += 1
        ranges = math.ceil(n / (range_edges or RANGE_EDGES))
        decided = _resolved(active, scope, ranges).checkpoint(eager=True)
        led = decided.where(~F.col("leads")).drop("leads")
        if ranges == 1:  # the walk saw every edge and decided every vertex
            members.append(led)
            break
        leaders = decided.where("leads").select(*scope, F.col("v").alias("a"))
        led = led.unionByName(
            active.join(leaders, [*scope, "a"], "left_semi").select(*scope, F.col("b").alias("v"))).distinct().checkpoint(eager=True)
        gone = led.unionByName(leaders.withColumnRenamed("a", "v"))
        active = (active.join(gone.withColumnRenamed("v", "a"), scope + ["a"], "left_anti")
                  .join(gone.withColumnRenamed("v", "b"), scope + ["b"], "left_anti")
                  .checkpoint(eager=True))
        members.append(led)
    if stats is not None:
        stats["rounds"] = rounds
    if not members:
        return vertices
    taken = members[0]
    for m in members[1:]:
        taken = taken.unionByName(m)
    return vertices.join(taken, scope + ["v"], "left_anti")


def assign_members(edges: DataFrame, leaders: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope..., leader, member, sim)``: every member joins its smallest adjacent leader."""
    led = edges.join(leaders.withColumnRenamed("v", "a"), scope + ["a"], "left_semi")
    best = led.groupBy(*scope, "b").agg(F.min(F.struct("a", "sim")).alias("_m"))
    return best.select(*scope, F.col("_m.a").alias("leader"), F.col("b").alias("member"), F.col("_m.sim").alias("sim"))
