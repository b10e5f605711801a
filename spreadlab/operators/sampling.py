"""Fused sampling: which edges are live in which simulation, from a hash and never from stored graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.functions import hashing as H

HASHES = {"directed": H.with_edge_hash, "undirected": H.with_edge_hash_undirected, "crc32c": H.with_edge_hash_crc32c}


def threshold(p: Column) -> Column:
    """A probability as a 31-bit threshold: its 32-bit float times 2**31, cut; 1 and more is always live."""
    return F.least(F.floor(p.cast("float").cast("double") * 2147483648.0), F.lit(2147483648)).cast("long")


def graph(edges: DataFrame, p: str = "w", hash_mode: str = "directed") -> DataFrame:
    """(u, v, thr, h) of (s, t, w): what sampling needs of an edge."""
    arcs = edges.select(F.col("s").cast("long").alias("u"), F.col("t").cast("long").alias("v"), threshold(F.col(p)).alias("thr"))
    return HASHES[hash_mode](arcs, "h", F.col("u"), F.col("v"))


def seeds(spark: SparkSession, n_sims: int, offset: int = 0, in_order: bool = False) -> DataFrame:
    """(r, x): one 31-bit number for each simulation, as many as the caller asks for; in_order: r follows x."""
    x = [H.py_fmix64(offset + r + 1) & H.MASK31 for r in range(n_sims)]
    return spark.createDataFrame(list(enumerate(sorted(x) if in_order else x)), "r int, x long").coalesce(1)


def seeds_from(values: list[int], spark: SparkSession, in_order: bool = False) -> DataFrame:
    """(r, x) of the caller's own numbers."""
    return spark.createDataFrame(list(enumerate(sorted(values) if in_order else values)), "r int, x long").coalesce(1)


#: Bits of a simulation's number.
BITS = 31
#: Where (k, prefix) of an edge's hash and of a simulation's number stand in one BIGINT.
_KEY = "shiftleft(cast(k as bigint), 32) | shiftright({0}, k)"


def _bits() -> Column:
    """The least k, or one more, with thr <= 2**k: a number whose xor with h is below thr has all bits of h from the k-th on.

    The logarithm of a threshold is off by less than its distance to the next whole number, but for powers of two, which may get one
    more; what is met is tested.
    """
    return F.when(F.col("thr") <= 1, 0).otherwise(F.least(F.ceil(F.log2(F.col("thr").cast("double"))), F.lit(BITS))).cast("int")


def _keyed(edges: DataFrame) -> DataFrame:
    """edges with _key.  What could be null becomes never live, as from columns that can be null Spark infers filters, for which hashes would be made twice."""
    edges = edges.withColumns({"h": F.coalesce("h", F.lit(1 << BITS)), "thr": F.coalesce("thr", F.lit(0).cast("long"))})
    return edges.withColumn("k", _bits()).withColumn("_key", F.coalesce(F.expr(_KEY.format("h")), F.lit(-1).cast("long"))).drop("k")


def _prefixes(sims: DataFrame) -> DataFrame:
    """sims, once for each k, with _key: what its number has in common with all hashes that agree from the k-th bit on."""
    return sims.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BITS)))).withColumn("_key", F.expr(_KEY.format("x"))).drop("k")


def live_edges(edges: DataFrame, sims: DataFrame) -> DataFrame:
    """(u, v, r): each edge in each simulation that has it.

    (x xor h) < thr holds only where x and h agree in the bits that thr leaves zero, so that each edge looks up one prefix among those of the
    simulations' numbers, and at most every other number it meets fails: work grows with edges and live edges, not with edges
    times simulations.  sims has a row for each simulation, which the caller's parameter bounds, so its prefixes are broadcast; edges
    stay where they are.
    """
    met = _keyed(edges).join(F.broadcast(_prefixes(sims.select("r", "x"))), "_key")
    return met.where(F.col("x").bitwiseXOR(F.col("h")) < F.col("thr")).select("u", "v", "r")


def live_groups(edges: DataFrame, sims: DataFrame, group: Column, mark: Column) -> DataFrame:
    """(edges' columns, grp, word): for each group of simulations in which an edge is live, the ``mark``s of those, or-ed.

    group and mark are expressions of sims' columns r and x.  Simulations of one prefix travel as one array, so an edge meets them in one row, and
    nothing is shuffled.
    """
    own = _prefixes(sims.select("r", "x")).groupBy("_key").agg(F.collect_list(F.struct(F.col("x"), group.cast("int").alias("grp"), mark.cast("long").alias("mark"))).alias("_sims"))
    met = _keyed(edges).join(F.broadcast(own), "_key").drop("_key")
    met = met.withColumn("_live", F.filter("_sims", lambda s: s["x"].bitwiseXOR(F.col("h")) < F.col("thr"))).drop("_sims")
    groups = F.array_distinct(F.transform("_live", lambda s: s["grp"]))
    words = F.transform(groups, lambda g: F.struct(g.alias("grp"), F.aggregate(F.filter("_live", lambda s: s["grp"] == g), F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(s["mark"])).alias("word")))
    return met.withColumn("_word", F.explode_outer(words)).where("_word is not null").select(*edges.columns, "_word.grp", "_word.word")


def prune(edges: DataFrame, sims: DataFrame, parts: int) -> DataFrame:
    """(part, u, v, thr, h): edges live in at least one simulation of each part; part = r div (sims / parts).

    Edges are read once and stay where they are: each meets the simulations of its prefix.
    """
    size = max(1, sims.count() // parts)
    part = F.least(F.floor(F.col("r") / size), F.lit(parts - 1))
    return live_groups(edges, sims, part, F.lit(1)).select(F.col("grp").alias("part"), *edges.columns)


def sampled_ratio(pruned: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ratio): share of all edges that each part keeps."""
    total = edges.agg(F.count("*").alias("m"))
    return pruned.groupBy("part").agg(F.count("*").alias("kept")).crossJoin(F.broadcast(total)).select("part", (F.col("kept") / F.col("m")).alias("ratio"))


def fill_rate(live: DataFrame, lanes: int = 32) -> DataFrame:
    """One row (filled, taken, fill_rate): live simulations among the lanes of the groups that have any."""
    groups = live.groupBy("u", "v", F.floor(F.col("r") / lanes).alias("g")).agg(F.count("*").alias("c"))
    return groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("filled"), (F.count("*") * lanes).alias("taken")).select("filled", "taken", (F.col("filled") / F.when(F.col("taken") > 0, F.col("taken"))).alias("fill_rate"))


def filled_groups(edges: DataFrame, sims: DataFrame, *group: str) -> DataFrame:
    """(edges' columns, group, c): how many simulations of each group have an edge, where the group is among those the edge looks up; c may be 0.

    sims (x, group): a group's simulations of one prefix come as one array, so an edge meets a group in one row, and nothing is grouped by edges.
    """
    own = _prefixes(sims.select("x", *group)).groupBy("_key", *group).agg(F.collect_list("x").alias("_xs"))
    met = _keyed(edges).join(F.broadcast(own), "_key")
    return met.select(*edges.columns, *group, F.size(F.filter("_xs", lambda x: x.bitwiseXOR(F.col("h")) < F.col("thr"))).alias("c"))


def fill_rates(groups: DataFrame, *by: str, lanes: int = 32) -> DataFrame:
    """(by, filled, taken, fill_rate) of rows (c): as ``fill_rate``, over the groups of ``lanes`` simulations of which some have an edge."""
    out = groups.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("filled"), (F.count_if(F.col("c") > 0) * lanes).alias("taken"))
    return out.select(*by, "filled", "taken", (F.col("filled") / F.when(F.col("taken") > 0, F.col("taken"))).alias("fill_rate"))


def fill_rate_of_rounds(start: DataFrame, live: DataFrame, max_rounds: int = 20, lanes: int = 32, active_rate: float = 0.0) -> DataFrame:
    """One row (filled, taken, fill_rate) over the rounds of register propagation: in each, the live edges to vertices of which a register has
    changed in the round before (all vertices in the first).

    start (x, r, val) are registers; rounds end as ``propagate``'s do, active_rate being a share of the vertices.
    """
    from spreadlab.operators.spread import propagate
    from spreadlab.session import spool

    live = spool(live.select("u", "v", "r"))
    now, active = spool(start.select("x", "r", "val")), None
    vertices = now.select("x").distinct().count()
    filled = taken = 0
    for _ in range(max_rounds):
        visited = live if active is None else live.join(active, "v", "left_semi")
        row = fill_rate(visited, lanes).first()
        filled, taken = filled + row.filled, taken + row.taken
        after = propagate(now, live, "v", "u", "max", max_rounds=1)
        active = spool(after.join(now.withColumnRenamed("val", "old"), ["x", "r"], "left").where("old is null or old != val").select(F.col("x").alias("v")).distinct())
        now = after
        if active.count() <= active_rate * vertices:
            break
    return live.sparkSession.createDataFrame([(filled, taken, filled / taken if taken else None)], "filled long, taken long, fill_rate double").coalesce(1)


def variant_seeds(spark: SparkSession, n_sims: int, variant: str, size: int = 0, in_order: bool = False) -> DataFrame:
    """(r, x) by hash: "above" takes the numbers after ``size`` (of vertices), "below" the negative ones from -size downwards."""
    first = {"above": lambda r: size + r, "below": lambda r: -(size + r)}[variant]
    return seeds_from([H.py_fmix64(first(r)) & H.MASK31 for r in range(n_sims)], spark, in_order)
