"""Cardinality registers: one leading-zero count for each vertex and simulation, and estimates from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions import hashing as H
from spreadlab.operators import packed
from spreadlab.operators.spread import fits, propagate
from spreadlab.session import spool

#: Values that one harmonic register is the mean of.
CHAIN = 4


def registers(vertices: DataFrame, sims: DataFrame, n_sims: int, offset: int = 0) -> DataFrame:
    """(x, r, val): leading zeros of the hash of ~(id * n_sims + r + n_sims + offset)."""
    rows = vertices.crossJoin(F.broadcast(sims.select("r")))  # a caller's number of simulations
    nonce = F.bitwise_not(F.col("id") * n_sims + F.col("r") + n_sims + offset)
    return H.with_fmix64(rows, "h", nonce).select(F.col("id").alias("x"), "r", H.leading_zeros(F.col("h")).cast("int").alias("val"))


def registers_harmonic(vertices: DataFrame, sims: DataFrame, n_sims: int, offset: int = 0) -> DataFrame:
    """The harmonic mean of CHAIN counts, each from the hash of the one before; 0 if one of them is 0."""
    rows = vertices.crossJoin(F.broadcast(sims.select("r")))
    nonce = F.bitwise_not(F.col("id") * n_sims + F.col("r") + n_sims + offset)

    rows = rows.select(F.col("id").alias("x"), "r", nonce.alias("h"), F.lit(0.0).alias("inverse"), F.lit(False).alias("zero"))
    for _ in range(CHAIN):
        rows = H.with_fmix64(rows, "h", F.col("h")).withColumn("z", H.leading_zeros(F.col("h")))
        rows = rows.withColumns({"inverse": F.col("inverse") + F.when(F.col("z") > 0, 1.0 / F.col("z")).otherwise(0.0), "zero": F.col("zero") | (F.col("z") == 0)})
    return rows.select("x", "r", F.when(F.col("zero"), 0.0).otherwise(CHAIN / F.col("inverse")).alias("val"))


def propagate_registers(reg: DataFrame, live: DataFrame, blocked: DataFrame | None = None, max_rounds: int | None = None, active_rate: float = 0.0, total: int | None = None, local: bool | None = None) -> DataFrame:
    """(x, r, val): the largest register among all that x reaches; blocked (v, r) are taken out of the graph."""
    if blocked is not None and blocked.isEmpty():
        blocked = None
    whole = dict(reg.dtypes)["val"] not in ("double", "float")
    if local is None:
        local = fits(reg, live)
    if not local and whole:
        state = packed.from_rows(reg, "max")
        if blocked is not None:
            state = packed.blocked(state, packed.pack(blocked, "v"))
        adj = packed.adjacency(spool(packed.pack(live, "u", "v"), "words"), "v", "u")
        return packed.to_rows(packed.propagate(state, adj, "max", max_rounds, active_rate, total), "max", dict(reg.dtypes)["val"])
    if blocked is not None:
        gone = blocked.select(F.col("v").alias("x"), "r")
        reg = reg.join(gone, ["x", "r"], "left_anti")
        for end in ("u", "v"):
            live = live.join(gone.withColumnRenamed("x", end), [end, "r"], "left_anti")
    return propagate(reg, live, "v", "u", "max", max_rounds, active_rate, total, local)


def estimates(reg: DataFrame, mask: dict[int, int], n_sims: int) -> DataFrame:
    """(u, total): over all simulations, the larger of u's register and the mask's; the estimate is 2 ** (total / n_sims).

    A missing register counts as below any mask.  mask has a value for each simulation at most.
    """
    spark = reg.sparkSession
    base = sum(mask.values())
    if not mask:
        return reg.groupBy(F.col("x").alias("u")).agg(F.sum("val").alias("total"))
    m = F.broadcast(spark.createDataFrame(list(mask.items()), "r int, low int"))
    gain = F.greatest(F.col("val") - F.coalesce("low", F.lit(0)), F.lit(0))
    return reg.join(m, "r", "left").groupBy(F.col("x").alias("u")).agg((F.sum(gain) + base).alias("total"))


def estimates_harmonic(reg: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(u, estimate): count / sum(1 / max(register, mask)) over registers of 0 or more; 0 where that sum is 0.

    A register of 0 makes the sum infinite and the estimate 0.
    """
    value = F.col("val") if mask is None else F.greatest("val", F.coalesce("low", F.lit(-1.0)))
    rows = reg if mask is None else reg.join(F.broadcast(mask), "r", "left")
    rows = rows.select(F.col("x").alias("u"), value.alias("m"))
    # what is below 0 is left out here, not by a filter: Spark moves a filter to below the hashes, and writes all of them out once for each use of another
    out = rows.groupBy("u").agg(F.count_if(F.col("m") >= 0).alias("n"), F.sum(F.when(F.col("m") > 0, 1.0 / F.col("m"))).alias("inverse"), F.max((F.col("m") == 0).cast("int")).alias("zero")).where("n > 0")
    return out.select("u", F.when((F.col("zero") == 1) | F.col("inverse").isNull(), 0.0).otherwise(F.col("n") / F.col("inverse")).alias("estimate"))


def argmax(scores: DataFrame, taken: list[int], value: str = "total", key: str = "u"):
    """The row with the largest value, of the least key among equals, that is not taken yet."""
    left = scores.where(~F.col(key).isin(taken)) if taken else scores
    return left.orderBy(F.desc(value), key).first()
