"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a distributed aggregation and is written to the shared folder, so no step depends on
the ones before it and nothing is collected.  A hub of any degree is only ever aggregated by min.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm._session import spool


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node that edges (a, b) lead to; nodes are longs.

    Nodes without an edge have no row.  Nulls and loops are no edges; repeated edges count once.
    """
    e = spool(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: each node's larger neighbours are tied to the smallest node that it sees
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node's smaller neighbours, and itself, are tied to the smallest of them
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        e = spool(small, "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.count_distinct("u")).first()
        if now == before or now[0] == now[2] and _is_star(e):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _is_star(e: DataFrame) -> bool:
    """No centre is tied to another node: then one row for each node is left, and it is final."""
    return e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi").isEmpty()
