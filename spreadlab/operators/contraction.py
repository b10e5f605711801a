"""Weak components of all simulations at once by star contraction, for graphs of long paths.

Label propagation takes a round for each step of the longest shortest path; here edges are replaced by ever shorter ones.  A large star
ties each vertex's larger neighbours to the least of its neighbourhood, a small star its smaller ones; both keep components, and
alternating them ends, after a number of rounds that grows with the logarithm of the longest path, when each component is
one star around its least vertex.  Simulations are part of the key.  Minima are taken within tasks before they shuffle; the edges of a hub
join a single row, which Spark's skew join deals out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.session import spool


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("r", "u").agg(F.min("v").alias("m"))


def contract(edges: DataFrame) -> DataFrame:
    """One large star and one small star of edges (r, u, v) with u > v."""
    both = edges.unionByName(edges.select("r", F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), ["r", "u"]).where("v > u").select("r", F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    least = _least(large)
    far = large.join(least, ["r", "u"]).where("v != m").select("r", F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("r", "u", F.col("m").alias("v")).unionByName(far).distinct()


def stars(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """(r, u, v): each vertex u of a component that is not its least one, with the least v; and the rounds it took."""
    edges = spool(edges.where("u != v").select("r", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("r", "u", "v").cast("decimal(38,0)")))
    before, done = edges.agg(mark).first()[0], 0
    while max_rounds is None or done < max_rounds:
        edges, done = spool(contract(edges), "edges"), done + 1
        now = edges.agg(mark).first()[0]
        if now == before:
            break
        before = now
    return edges, done


def weak_labels(live: DataFrame) -> DataFrame:
    """(v, r, label) of the vertices of live edges (u, v, r): the least vertex of their weak component."""
    live = live.select("r", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    found, _ = stars(live)
    ends = live.select("r", F.explode(F.array("u", "v")).alias("u")).distinct()
    return ends.join(found, ["r", "u"], "left").select(F.col("u").alias("v"), "r", F.coalesce("v", "u").alias("label"))
