import duckdb
import numpy as np
from pyspark.sql import functions as F

from echoset.operators.ranks import exact_quantiles, numbered, running_total
from echoset.plans.passages import group_summary, number_groups, rank_groups

Q = {"low": 0.25, "mid": 0.5, "high": 0.9}


def test_quantiles_equal_those_of_a_database(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(round(rng.random(), 2))) for g in "abc" for _ in range(int(rng.integers(1, 400)))]
    rows += [("a", None), ("only null", None), (None, 0.5), (None, -1.0), ("one", 0.25)] + [("same", 1.0)] * 50
    got = {r["g"]: tuple(r[q] for q in Q) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", Q).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    picks = ", ".join(f"quantile_cont(v, {p})" for p in Q.values())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT g, {picks} FROM t WHERE v IS NOT NULL GROUP BY g").fetchall()}
    assert got.keys() == want.keys()
    for g, w in want.items():
        assert np.allclose(got[g], w, atol=1e-12)


def test_a_hot_group_is_spread_over_ranges(spark):
    """A million scores of one group: no range holds more than a part, and the quantiles are exact."""
    n = 1_000_000
    scores = spark.range(0, n, 1, 8).select(F.lit("hot").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("v"))
    got = exact_quantiles(scores, ["g"], "v", Q).collect()
    assert [r["g"] for r in got] == ["hot"]
    for q, p in Q.items():
        assert abs(got[0][q] - p * (n - 1) / n) < 1e-9
    dealt = scores.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < n / 4


def test_numbers_are_gapless_over_the_whole_table(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 3).alias("leader_x"), F.lit("kept").alias("other"))
    got = numbered(df, [F.desc("leader_x")], "n").collect()
    assert sorted((-r["leader_x"], r["n"]) for r in got) == [(-3 * i, 5000 - i) for i in range(4999, -1, -1)]
    plan = numbered(df, [F.col("leader_x")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert numbered(df.where("false"), [F.col("leader_x")], "n").collect() == []
    sums = running_total(spark.createDataFrame([(1, 5), (2, 0), (3, 7)], "k int, w bigint"), [F.col("k")], F.col("w"), "upto")
    assert sorted((r["k"], r["upto"]) for r in sums.collect()) == [(1, 5), (2, 5), (3, 12)]


def test_corpus_summary_equals_that_of_one_scope(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lead in range(0, 300, 10):
        rows.append((1, lead, None))
        rows += [(1, lead, float(round(s, 2))) for s in rng.random(int(rng.integers(1, 9)))]
    m = spark.createDataFrame(rows, "s int, leader_p bigint, similarity double")
    scoped = rank_groups(number_groups(group_summary(m, ["s"], "p"), ["s"], "p"), ["s"], "p").drop("s")
    corpus = rank_groups(number_groups(group_summary(m.drop("s"), [], "p"), [], "p"), [], "p")
    assert sorted(corpus.columns) == sorted(scoped.columns)
    a, b = ({r["leader_p"]: r.asDict() for r in d.collect()} for d in (scoped, corpus))
    assert a.keys() == b.keys() and len(a) == 30
    for lead in a:
        for c, v in a[lead].items():
            assert abs(v - b[lead][c]) < 1e-9, c
    assert rank_groups(number_groups(group_summary(m.where("false").drop("s"), [], "p"), [], "p"), [], "p").collect() == []
