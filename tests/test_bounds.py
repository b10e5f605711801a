"""Bounds of gains and estimates whose plan stays small."""

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import sampling, select, sketch
from spreadlab.session import spool


def graph(spark, edges):
    return spool(sampling.graph(spark.createDataFrame(edges, "s long, t long, w double")))


@pytest.mark.parametrize("local", [True, False])
def test_mix_greedy_tries_few_where_components_say_little(spark, local):
    e, ids, sims = graph(spark, [(u, 300, 1.0) for u in range(300)]), spark.range(301).toDF("id"), sampling.seeds(spark, 2)
    got = select.mix_greedy(e, ids, sims, 2, batch=8, local=local).orderBy("step").collect()
    assert [(r.seed, r.score) for r in got] == [(0, 2.0), (1, 3.0)]
    assert got[0].diag <= 8  # 301 by sizes of components, as all have one of 301


@pytest.mark.parametrize("local", [True, False])
def test_bounds_are_never_below_what_is_reached(spark, local):
    live = spool(spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 0, 0), (3, 0, 0), (4, 5, 1), (4, 6, 1), (5, 7, 1), (6, 7, 1)], "u long, v long, r int"))
    got = {r.v: r.gain * 2 for r in select.reach_bounds(live, spark.range(9).toDF("id"), 2, local).collect()}
    reached = {0: 4, 1: 4, 2: 4, 3: 5, 4: 5, 5: 3, 6: 3, 7: 2, 8: 2}  # with one for the simulation that has no edge there
    assert all(got[v] >= n for v, n in reached.items()) and {v: got[v] for v in (5, 6, 7, 8)} == {5: 3, 6: 3, 7: 2, 8: 2}


def test_harmonic_estimates_write_the_hashes_out_once(spark):
    reg = sketch.registers_harmonic(spark.range(3).toDF("id"), sampling.seeds(spark, 4), 4)
    out = sketch.estimates_harmonic(reg)
    rows = {r.x: [] for r in reg.collect()}
    for r in reg.collect():
        rows[r.x].append(r.val)
    want = {x: round(0.0 if min(v) == 0 else len(v) / sum(1 / y for y in v), 9) for x, v in rows.items()}
    assert {r.u: round(r.estimate, 9) for r in out.collect()} == want
    low = spark.createDataFrame([(1, 0, -1.0), (2, 0, -1.0), (2, 1, 4.0), (3, 0, None)], "x long, r int, val double")
    assert {r.u: r.estimate for r in sketch.estimates_harmonic(low.select("x", "r", F.col("val"))).collect()} == {2: 4.0}
