"""Directed labels of all simulations at once by contraction of chains, for graphs of long paths.

A vertex with one live arc into it is reached by what reaches that arc's source, and by itself.  Such vertices form chains (and
cycles); pointers along them double their length each round, so that after a number of rounds that grows with the logarithm of the
longest chain every one of them knows the vertex that its chain comes from, its root, and the least value between.  Arcs out of a chain then become arcs out of
its root, the values go along, and what is left has only roots.  This is done again while it takes away more than one of SHARE vertices;
the small rest goes by ordinary rounds, and labels come back down the chains.  The labels are those of ``spread.min_labels``.

A cycle that nothing else leads to has no root.  Each round closes some vertices of every chain that has a root and is still open, so one that
closes none leaves only cycles and what hangs on them; one that lowers no value there either leaves each with the least of all that lead to it: the
pointers' equal spans, laid end to end, go all the way round.
Simulations are part of every key.  Arcs are grouped by (simulation, vertex) with partial sums; many arcs or chains at one vertex join a single row of
it, which Spark's skew join deals out.  Repeated arcs and loops change nothing; no live arcs give no labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spreadlab.operators.spread import propagate
from spreadlab.session import spool

#: A contraction goes on while it takes away more than one of so many vertices.
SHARE = 10


def follow(links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(r, v, root, low) of n links (r, v, p, low) from v to p, and the rounds it took: the first vertex up the links that has none, and the least on the way to it.

    A vertex that only a cycle leads to has a null root, and the least of all that lead to it.
    """
    state, done, left = spool(links.select("r", "v", "p", "low", F.lit(True).alias("is_open")), "links"), 0, n
    while left and done <= n.bit_length():
        ahead = state.select("r", F.col("v").alias("p"), F.col("p").alias("q"), F.col("low").alias("lower"), F.col("is_open").alias("goes_on"))
        went = state.where("is_open").join(ahead, ["r", "p"], "left").select("r", "v", F.coalesce("q", "p").alias("p"), F.least("low", "lower").alias("low"), F.coalesce("goes_on", F.lit(False)).alias("is_open"), (F.col("lower") < F.col("low")).alias("fell"))
        seen = Observation(f"open-{uuid.uuid4().hex}")
        went = went.observe(seen, F.count_if("is_open").alias("n"), F.expr("count_if(is_open and fell) as fell")).drop("fell")
        state, done = spool(state.where("not is_open").unionByName(went), "links"), done + 1
        before, left, fell = left, seen.get["n"], seen.get["fell"]
        if left == before and not fell:
            break
    return state.select("r", "v", F.when(~F.col("is_open"), F.col("p")).alias("root"), "low"), done


def contract(arcs: DataFrame, values: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, values) without the vertices of ``ends``: their arcs start at their roots, and their least values are those of the vertices they lead to."""
    own = ends.select("r", "v")
    out = ends.select("r", F.col("v").alias("u"), "root", "low")
    moved = spool(arcs.join(own, ["r", "v"], "left_anti").join(out, ["r", "u"], "left"), "moved")
    got = moved.where("low is not null").groupBy("r", "v").agg(F.min("low").alias("got"))
    fewer = moved.select("r", F.when(F.col("low").isNull(), F.col("u")).otherwise(F.col("root")).alias("u"), "v").where("u is not null and u != v").distinct()
    kept = values.join(own, ["r", "v"], "left_anti").join(got, ["r", "v"], "left").select("r", "v", F.least("val", "got").alias("val"))
    return spool(fewer, "arcs"), spool(kept, "values")


def directed_labels(live: DataFrame, report: list[int] | None = None) -> DataFrame:
    """(v, r, label) of the vertices of live edges (u, v, r): the least vertex that reaches each; ``report`` gets each contraction's rounds."""
    live = live.select("r", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    arcs = spool(live.distinct(), "arcs")
    values = spool(arcs.select("r", F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("val", F.col("v")), "values")
    arcs, levels = arcs.where("u != v"), []
    while True:
        single = arcs.groupBy("r", "v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("p")).where("n = 1")
        links = spool(single.join(values, ["r", "v"]).select("r", "v", "p", F.col("val").alias("low")), "single")
        n = links.count()
        if n * SHARE <= values.count():
            break
        ends, rounds = follow(links, n)
        if report is not None:
            report.append(rounds)
        arcs, values = contract(arcs, values, ends)
        levels.append(ends)
    labels = propagate(values.select(F.col("v").alias("x"), "r", "val"), arcs, "u", "v", "min").select("r", F.col("x").alias("v"), "val")
    for ends in reversed(levels):
        above = labels.select("r", F.col("v").alias("root"), F.col("val").alias("above"))
        down = ends.join(above, ["r", "root"], "left").select("r", "v", F.least("low", "above").alias("val"))
        labels = spool(labels.unionByName(down), "labels")
    return labels.select("v", "r", F.col("val").alias("label"))
