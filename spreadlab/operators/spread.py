"""Fixpoints over live edges: cascades, labels and registers, all simulations at once.

Simulations do not depend on each other.  Where a count shows that the rows of each of them fit a task (ROWS), one shuffle
brings each simulation together and a fixpoint is one job.  Where they do not, rounds are Spark jobs on packed state (see
``packed``); values of other kinds than registers and labels go by rounds of one row for each vertex and simulation.  Both give the same rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spreadlab.operators import packed
from spreadlab.session import shipped, spool

#: Rows of edges, values and visits (24 bytes each) of one simulation that a task may hold.
ROWS = 2_000_000
#: Tables of changes that are read one by one before they are made one.
DELTAS = 8
_KIND = {"min": np.minimum, "max": np.maximum}


def _tagged(tables: list[DataFrame]) -> DataFrame:
    """(r, kind, x, y) of tables with columns (r, x, y), kind being a table's place."""
    return reduce(DataFrame.unionByName, (t.select("r", F.lit(k).alias("kind"), F.col("x").cast("long").alias("x"), F.col("y")) for k, t in enumerate(tables)))


def fits(*tables: DataFrame, rows: int | None = None) -> bool:
    """No simulation has more than ``rows`` rows in all tables together."""
    every = reduce(DataFrame.unionByName, (t.select("r") for t in tables))
    most = every.groupBy("r").count().agg(F.max("count")).first()[0]
    return (most or 0) <= (ROWS if rows is None else rows)


def relax(src: np.ndarray, dst: np.ndarray, val: np.ndarray, best, worst, max_rounds: int | None) -> tuple[np.ndarray, list[int]]:
    """Values after rounds in which each edge offers its source's value to its target, and how many changed in each round."""
    changed, counts = val != worst, []
    while max_rounds is None or len(counts) < max_rounds:
        use = changed[src]
        new = val.copy()
        best.at(new, dst[use], val[src[use]])
        changed = new != val
        val = new
        counts.append(int(changed.sum()))
        if not counts[-1]:
            break
    return val, counts


def relaxed(table: pa.Table, best: str, whole: bool, max_rounds: int | None, report: bool) -> pa.Table:
    """For applyInArrow: a simulation's rows (kind 0 edges x to y, 1 values y of x) to its values, or to changes by round."""
    kind, x, y, r = (table[c].to_numpy() for c in ("kind", "x", "y", "r"))
    x = x.astype(np.int64)
    edge = kind == 0
    worst = (np.inf if best == "min" else -np.inf) if not whole else (np.iinfo(np.int64).max if best == "min" else np.iinfo(np.int64).min)
    ends = y[edge].astype(np.int64)
    ids, at = np.unique(np.concatenate([x, ends]), return_inverse=True)
    val = np.full(len(ids), worst, np.int64 if whole else np.float64)
    _KIND[best].at(val, at[: len(x)][~edge], y[~edge].astype(val.dtype))
    val, counts = relax(at[: len(x)][edge], at[len(x) :], val, _KIND[best], worst, max_rounds)
    if report:
        return pa.table({"r": pa.array(np.full(len(counts), r[0], np.int32)), "round": pa.array(np.arange(len(counts), dtype=np.int64)), "n": pa.array(np.array(counts, np.int64))})
    has = val != worst
    return pa.table({"x": ids[has], "r": pa.array(np.full(int(has.sum()), r[0], np.int32)), "val": val[has]})


def propagate(start: DataFrame, live: DataFrame, source: str, target: str, best: str, max_rounds: int | None = None, active_rate: float = 0.0, total: int | None = None, local: bool | None = None) -> DataFrame:
    """(x, r, val): start's values, carried along live edges from source to target, of which the ``best`` (min or max) stays.

    Stops when no value changes, after max_rounds, or when no more than active_rate of ``total`` values changed.
    local: simulations fit a task each; counted if not given.
    """
    kind = dict(start.dtypes)["val"]
    if local is None:
        local = fits(start, live)
    if not local:
        return _by_rounds(start, live, source, target, best, max_rounds, active_rate, total)
    whole = kind not in ("double", "float")
    rows = _tagged([live.select("r", F.col(source).alias("x"), F.col(target).cast("long" if whole else "double").alias("y")), start.select("r", "x", F.col("val").cast("long" if whole else "double").alias("y"))])
    if active_rate and total is not None:
        rows = spool(rows)
        counts = rows.groupBy("r").applyInArrow(shipped(relaxed, best, whole, max_rounds, True), "r int, round long, n long").groupBy("round").agg(F.sum("n").alias("n")).orderBy("round")
        few = counts.where(F.col("n") <= active_rate * total).first()
        max_rounds = few["round"] + 1 if few else max_rounds
    out = rows.groupBy("r").applyInArrow(shipped(relaxed, best, whole, max_rounds, False), f"x long, r int, val {'long' if whole else 'double'}")
    return spool(out.select("x", "r", F.col("val").cast(kind).alias("val")))


def _by_rounds(start: DataFrame, live: DataFrame, source: str, target: str, best: str, max_rounds: int | None, active_rate: float, total: int | None) -> DataFrame:
    agg = {"min": F.min, "max": F.max}[best]
    arcs = live.select(F.col(source).alias("x"), F.col(target).alias("y"), "r")
    base = changed = spool(start.select("x", "r", "val"))
    deltas: list[DataFrame] = []
    done = 0
    better = F.col("val") < F.col("old") if best == "min" else F.col("val") > F.col("old")
    while max_rounds is None or done < max_rounds:
        sent = changed.join(arcs, ["x", "r"]).groupBy(F.col("y").alias("x"), "r").agg(agg("val").alias("val"))
        for table in [base, *deltas]:
            sent = sent.join(table.select("x", "r", F.col("val").alias("old")), ["x", "r"], "left").where(F.col("old").isNull() | better).select("x", "r", "val")
        seen = Observation(f"changed-{uuid.uuid4().hex}")
        changed = spool(sent.observe(seen, F.count(F.lit(1)).alias("n")))
        deltas, done, n = [*deltas, changed], done + 1, seen.get["n"]
        if n == 0 or total is not None and n <= active_rate * total:
            break
        if len(deltas) > DELTAS:
            deltas = [spool(reduce(DataFrame.unionByName, deltas).groupBy("x", "r").agg(agg("val").alias("val")))]
    return spool(reduce(DataFrame.unionByName, [base, *deltas]).groupBy("x", "r").agg(agg("val").alias("val")))


def reach(src: np.ndarray, dst: np.ndarray, seen: np.ndarray, now: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """seen, with what the vertices ``now`` reach through vertices that were not seen."""
    seen, now, done = seen.copy(), now & ~seen, 0
    while now.any() and (max_rounds is None or done < max_rounds):
        seen |= now
        to = np.zeros_like(seen)
        to[dst[now[src]]] = True
        now, done = to & ~seen, done + 1
    return seen | now


def reached(table: pa.Table, max_rounds: int | None) -> pa.Table:
    """For applyInArrow: a simulation's rows (kind 0 edges x to y, 1 frontier x, 2 visited x) to all visited."""
    kind, x, y, r = (table[c].to_numpy() for c in ("kind", "x", "y", "r"))
    edge = kind == 0
    ids, at = np.unique(np.concatenate([x, y[edge]]), return_inverse=True)
    marks = np.zeros((2, len(ids)), bool)
    for k in (1, 2):
        marks[k - 1, at[: len(x)][kind == k]] = True
    out = reach(at[: len(x)][edge], at[len(x) :], marks[1], marks[0], max_rounds)
    return pa.table({"v": ids[out], "r": pa.array(np.full(int(out.sum()), r[0], np.int32))})


def cascade(live: DataFrame, frontier: DataFrame, visited: DataFrame | None = None, max_rounds: int | None = None, local: bool | None = None) -> DataFrame:
    """(v, r): visited before, and what the frontier (v, r) reaches along live edges, itself included."""
    tables = [live, frontier, *([] if visited is None else [visited])]
    if fits(*tables) if local is None else local:
        rows = _tagged([live.select("r", F.col("u").alias("x"), F.col("v").cast("long").alias("y")), *(t.select("r", F.col("v").alias("x"), F.lit(0).cast("long").alias("y")) for t in tables[1:])])
        return spool(rows.groupBy("r").applyInArrow(shipped(reached, max_rounds), "v long, r int"))
    adj = packed.adjacency(spool(packed.pack(live, "u", "v"), "words"))
    old = None if visited is None else spool(packed.pack(visited, "v"), "visited")
    return spool(packed.unpack(packed.cascade(adj, packed.pack(frontier, "v"), old, max_rounds), "v"))


def at_seeds(vertices: list[int], sims: DataFrame) -> DataFrame:
    """(v, r): the vertices in every simulation; a caller's list, with the simulations it asked for."""
    own = sims.sparkSession.createDataFrame([(int(v),) for v in vertices], "v long")
    return own.crossJoin(F.broadcast(sims.select("r")))


def spread(visited: DataFrame, n_sims: int) -> DataFrame:
    """One row: mean number of vertices reached."""
    return visited.agg((F.count("*") / F.lit(n_sims)).alias("spread"))


def min_labels(live: DataFrame, both_ways: bool = False, max_rounds: int | None = None, local: bool | None = None) -> DataFrame:
    """(v, r, label) of the vertices with a live edge: the least vertex that reaches each; all others are labelled themselves.

    both_ways: edges carry labels back, too, so that labels name weak components.
    """
    if local is False:
        return packed.min_labels(spool(packed.pack(live, "u", "v"), "words"), both_ways, max_rounds)
    if both_ways:
        live = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "r"))
    live = spool(live.distinct())
    ends = live.select(F.explode(F.array("u", "v")).alias("x"), "r").distinct().withColumn("val", F.col("x"))
    return propagate(ends, live, "u", "v", "min", max_rounds, local=local).select(F.col("x").alias("v"), "r", F.col("val").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """(r, label, cnt) of the labels given; a vertex without a row is a component of one."""
    return labels.groupBy("r", "label").agg(F.count("*").alias("cnt"))


def vertex_gains(labels: DataFrame, sizes: DataFrame, vertices: DataFrame, n_sims: int, covered: DataFrame | None = None) -> DataFrame:
    """(v, total): over all simulations, the size of v's component where it is not covered (r, label) yet.

    vertices (id); a vertex without a label in a simulation counts one there, unless (r, id) is covered.
    """
    joined = labels.join(sizes, ["r", "label"])
    held = labels.groupBy("v").agg(F.count("*").alias("held"))
    if covered is not None:
        joined = joined.join(covered, ["r", "label"], "left_anti")  # a row for each simulation and seed: Spark goes by its size
    got = joined.groupBy("v").agg(F.sum("cnt").alias("got"))
    out = vertices.select(F.col("id").alias("v")).join(held, "v", "left").join(got, "v", "left").select("v", (F.coalesce("got", F.lit(0)) + F.lit(n_sims) - F.coalesce("held", F.lit(0))).alias("total"))
    if covered is not None:
        single = covered.join(labels.select("r", F.col("v").alias("label"), F.lit(1).alias("has")).distinct(), ["r", "label"], "left").where("has is null").groupBy(F.col("label").alias("v")).agg(F.count("*").alias("own"))
        out = out.join(single, "v", "left").select("v", (F.col("total") - F.coalesce("own", F.lit(0))).alias("total"))
    return out
