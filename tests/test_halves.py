"""Edges counted once for both ways, and fill rates without a table of live simulations."""

import re

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import prep, sampling
from spreadlab.plans import driver_queries


@pytest.mark.parametrize("parts", [None, 3])
def test_unordered_counts_are_those_of_both_ways(spark, parts):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 5), (5, None), (None, None), (4, 1)], "s long, t long")
    half = prep.unordered(pairs, parts)
    want = prep.multiplicity(prep.undirected(pairs))
    assert half.count() == 5 and half.where("s > t").count() == 0
    key = lambda r: str(tuple(r))
    assert sorted(prep.both_ways(half).collect(), key=key) == sorted(want.collect(), key=key)
    if parts:
        assert half.rdd.getNumPartitions() == parts


def test_fill_rates_need_no_groups_of_edges(spark):
    rows = [(u, v, [0.01, 0.3, 1.0][(u + v) % 3]) for u in range(20) for v in range(20)]
    edges, sims = sampling.graph(spark.createDataFrame(rows, "s long, t long, w double")), sampling.seeds(spark, 64)
    groups = sampling.filled_groups(edges, sims.withColumn("g", F.floor(F.col("r") / 32)), "g")
    assert sampling.fill_rates(groups).collect() == sampling.fill_rate(sampling.live_edges(edges, sims)).collect()
    assert "Aggregate" not in groups.select("u", "c")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # edges alone are not grouped
    none = sampling.filled_groups(edges.where("thr < 0"), sims.withColumn("g", F.lit(0)), "g")
    assert [tuple(r) for r in sampling.fill_rates(none).collect()] == [(0, 0, None)]


@pytest.mark.parametrize("p", [0.0, 0.002, 0.01, 0.05, 1 / 3, 0.99996, 1.0])
def test_weight_of_a_pair_that_comes_once_is_a_constant(spark, p):
    counts = spark.createDataFrame([(1, 2, c) for c in [None, *range(1, 40)]], "s long, t long, c long")
    own = prep.weigh_constant(counts, p)
    want = counts.select("c", prep.noisy_or(F.lit(p), F.col("c")).alias("w"))
    assert {r.c: r.w for r in own.collect()} == {r.c: r.w for r in want.collect()}
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    once = own.where("c = 1").first().w
    assert f"= 1) THEN {once}" in plan.replace(") then", ") THEN")  # known before any row is read


def test_edges_meet_their_suppliers_without_a_sort(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many suppliers
    try:
        plan = driver_queries._fill_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "ShuffledHashJoin" in line or "SortMergeJoin" in line]
    assert len(joins) == 2 and "ShuffledHashJoin [u#" in joins[0], joins  # the other is of orders and line items


def test_larger_tables_have_more_tasks_of_fill_rates_not_larger_ones(spark, monkeypatch):
    d, query = "/root/testdata/sf0.001", driver_queries.QUERIES["fill_rate_sorted"]
    want, lines = query(spark, d).collect(), spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(driver_queries, "ROWS", 500)
    parts = -(-lines // 500)
    own = query(spark, d)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", own._jdf.queryExecution().executedPlan().toString())
    assert parts >= 10 and [int(n) for _, n in dealt] == [parts] * 3, dealt  # orders, line items, pairs; whatever spark.sql.shuffle.partitions is
    task = F.spark_partition_id().alias("task")
    for rows in (driver_queries.pairs(spark, d, parts).groupBy(task).agg(F.count("*").alias("n")), driver_queries.half(spark, d).groupBy(task).agg(F.sum("c").alias("n"))):
        sizes = [r.n for r in rows.collect()]
        assert sum(sizes) == lines and len(sizes) == parts and max(sizes) < 2 * 500, sizes
    assert own.collect() == want


@pytest.mark.parametrize("name, steps", [("edge_multiplicity", 3), ("relabelled_edges", 3), ("registers_init", 2)])
def test_larger_tables_have_more_tasks_of_pairs(spark, monkeypatch, name, steps):
    d, query = "/root/testdata/sf0.001", driver_queries.QUERIES[name]
    want, lines = query(spark, d).collect(), spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(driver_queries, "ROWS", 500)
    parts = -(-lines // 500)
    plans, write = [], driver_queries.spool
    monkeypatch.setattr(driver_queries, "spool", lambda df, *rest: plans.append(df) or write(df, *rest))
    own = query(spark, d)
    dealt = [re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()) for df in [*plans, own]]
    assert max(n.count(str(parts)) for n in dealt) == steps, dealt  # orders, line items, and pairs where they are counted
    assert sorted(own.collect()) == sorted(want)
