"""Edge preparation: clean, relabel, make undirected, count and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.hashing import joined, with_fmix31
from spreadlab.session import spool

#: A 31-bit hash as a share of one.
UNIT = 2147483648.0


def clean(lines: DataFrame, skip: int = 0) -> DataFrame:
    """(line, s, t) from (line, value): no line with # or %, exactly two tokens, after the first ``skip`` data lines.

    A null or odd line is left out.
    """
    rows = lines.where(~F.col("value").rlike("[#%]"))
    if skip:
        first = rows.orderBy("line").limit(skip).select("line")  # as many lines as the caller asks to skip
        rows = rows.join(F.broadcast(first), "line", "left_anti")
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return rows.select("line", tokens.alias("x")).where(F.size("x") == 2).select("line", F.col("x")[0].alias("s"), F.col("x")[1].alias("t"))


def dense_ids(pairs: DataFrame) -> DataFrame:
    """(key, id): ids from 0 by first appearance, in the order of line, s before t.

    A range sort deals the keys out, and each partition counts on from those before it, so no task sees all keys.
    """
    seen = pairs.select(F.explode(F.array(F.struct((2 * F.col("line")).alias("pos"), F.col("s").alias("key")), F.struct((2 * F.col("line") + 1).alias("pos"), F.col("t").alias("key")))).alias("x")).groupBy("x.key").agg(F.min("x.pos").alias("pos"))
    parts = spool(seen.orderBy("pos", "key").select("key", "pos", F.spark_partition_id().alias("part")))
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("base"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("part").orderBy("pos", "key")) - 1
    return parts.withColumn("local", local).join(F.broadcast(before), "part").select("key", (F.col("base") + F.col("local")).cast("long").alias("id"))


def relabel(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(line, s, t) with dense ids for keys."""
    out = pairs.join(ids.select(F.col("key").alias("s"), F.col("id").alias("s_id")), "s").join(ids.select(F.col("key").alias("t"), F.col("id").alias("t_id")), "t")
    return out.select("line", F.col("s_id").alias("s"), F.col("t_id").alias("t"))


def undirected(pairs: DataFrame) -> DataFrame:
    """(s, t) and (t, s) for each pair; a loop comes twice."""
    return pairs.select("s", "t").unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t")))


def unordered(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """(s, t, c): each pair once whichever way it goes, the lesser end first (null last), with how often it comes; parts as in ``multiplicity``."""
    back = F.coalesce(F.col("s") > F.col("t"), F.col("s").isNull())
    rows = pairs.select(F.when(back, F.col("t")).otherwise(F.col("s")).alias("s"), F.when(back, F.col("s")).otherwise(F.col("t")).alias("t"))
    return multiplicity(rows, parts)


def both_ways(counts: DataFrame) -> DataFrame:
    """(s, t, c) and (t, s, c) of counts by ``unordered``; a loop is one row, and counts twice: multiplicity(undirected(pairs)), of which half has been moved."""
    loop = F.col("s").eqNullSafe(F.col("t"))
    ways = F.when(loop, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    rows = counts.select("s", "t", F.when(loop, 2 * F.col("c")).otherwise(F.col("c")).alias("c"), F.explode(ways).alias("back"))
    return rows.select(F.when(F.col("back"), F.col("t")).otherwise(F.col("s")).alias("s"), F.when(F.col("back"), F.col("s")).otherwise(F.col("t")).alias("t"), "c")


def multiplicity(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """(s, t, c): each pair once, with how often it comes.

    parts: so many tasks share the pairs, which then move as they are; without it Spark counts in each task first and deals out what that leaves.
    """
    rows = pairs if parts is None else pairs.repartition(parts, "s", "t")
    return rows.groupBy("s", "t").agg(F.count("*").alias("c"))


def summary(edges: DataFrame) -> DataFrame:
    """One row (n, m): one more than the largest vertex, and edges."""
    return edges.agg((F.greatest(F.max("s"), F.max("t")) + 1).alias("n"), F.count("*").alias("m"))


def noisy_or(p: Column, c: Column) -> Column:
    """Probability that one of c tries of probability p succeeds, to four places."""
    return F.round(1.0 - F.pow(1.0 - p.cast("double"), c.cast("double")), 4)


def with_unit_hash(edges: DataFrame, name: str, seed: int) -> DataFrame:
    """edges with a repeatable number in [0, 1) for each (s, t)."""
    own = with_fmix31(edges, name, joined(F.col("s"), F.col("t")).bitwiseXOR(F.lit(seed).cast("long")))
    return own.withColumn(name, F.col(name) / F.lit(UNIT))


def weigh_constant(edges: DataFrame, p: float) -> DataFrame:
    """(s, t, c, w) with one probability for each try.

    Most pairs come once, and their weight is a constant of the plan, as rounding goes by decimals for each row.
    """
    once = noisy_or(F.lit(p), F.lit(1))
    return edges.withColumn("w", F.when(F.col("c") == 1, once).otherwise(noisy_or(F.lit(p), F.col("c"))))


def weigh_uniform(edges: DataFrame, a: float, b: float | None = None, seed: int = 42) -> DataFrame:
    """A probability between a and b (half of a if not given) for each edge, from its hash."""
    b = a / 2 if b is None else b
    p = F.lit(a) + F.lit(b - a) * F.col("_unit")
    return with_unit_hash(edges, "_unit", seed).withColumn("w", noisy_or(F.greatest(F.lit(min(a, b)), F.least(F.lit(max(a, b)), p)), F.col("c"))).drop("_unit")


def weigh_normal(edges: DataFrame, mean: float, deviation: float | None = None, seed: int = 42) -> DataFrame:
    """A normal probability within [0, 1] for each edge: two hashes by the Box-Muller rule."""
    deviation = mean / 2 if deviation is None else deviation
    z = F.sqrt(-2.0 * F.log(1.0 - F.col("_one"))) * F.cos(2.0 * F.pi() * F.col("_two"))
    both = with_unit_hash(with_unit_hash(edges, "_one", seed), "_two", seed + 1)
    return both.withColumn("w", noisy_or(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(mean) + F.lit(deviation) * z)), F.col("c"))).drop("_one", "_two")


def csr_offsets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree, first): where each vertex's edges start if they are sorted by (s, t); no edges, degree 0.

    Ids are dense, so a bucket's total and a running sum inside each bucket give offsets without one task for all.
    """
    degree = vertices.join(edges.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.floor(F.col("id") / 65536).alias("bucket"))
    totals = degree.groupBy("bucket").agg(F.sum("degree").alias("total"))
    base = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))  # a row for each 65,536 vertices
    inside = F.sum("degree").over(Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("degree")
    return degree.withColumn("inside", inside).join(base, "bucket").select("id", "degree", (F.col("base") + F.col("inside")).alias("first"))


def count(lines: DataFrame, is_undirected: bool = False, fix_ids: bool = False, skip: int = 0) -> DataFrame:
    """Raw lines to (s, t, c): cleaned, with new ids or both directions if asked for, each edge once."""
    pairs = clean(lines, skip)
    if fix_ids:
        pairs = spool(pairs)
        pairs = relabel(pairs, dense_ids(pairs))
    else:
        pairs = pairs.select("line", F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))
    return both_ways(unordered(pairs)) if is_undirected else multiplicity(pairs.select("s", "t"))


def weigh(edges: DataFrame, weighting: tuple) -> DataFrame:
    """(s, t, c, w).  weighting: ("p", p), ("U", a, b) or ("N", mean, deviation)."""
    kind, *numbers = weighting
    return {"p": weigh_constant, "U": weigh_uniform, "N": weigh_normal}[kind](edges, *numbers)


def prepare(lines: DataFrame, weighting: tuple, is_undirected: bool = False, fix_ids: bool = False, skip: int = 0) -> DataFrame:
    """Raw lines to (s, t, c, w), with one weighting."""
    return weigh(count(lines, is_undirected, fix_ids, skip), weighting)
