"""Fixpoints by rounds of Spark jobs on packed state, for graphs of any size.

64 simulations are a group.  A row is a vertex and a group, with a BIGINT word (a bit for each simulation: visited, live) or with 64 lanes (a
byte array with a register or a label for each; where there are fewer simulations than that in all, rows have a lane for each of these).  A live arc is one row for each group, with the word of the simulations that have it.

Arcs and state are written in buckets of the key that rounds join on, so that a round moves messages alone: those of words are or-ed, those of lanes
reduced lane by lane, in each task before the shuffle and after it.  A vertex with more than HEAVY arcs in a group has them dealt over several
keys by a salt, and its value is copied to each; many arcs into one vertex are reduced before they travel.  Each round's changes are a
table of their own in the shared folder, so a lost executor loses no round, and lineage stays short.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.sampling import live_groups
from spreadlab.session import bucketed, shipped, spool

#: Simulations of a group.
LANES = 64
#: Arcs of one vertex in one group that one key holds.
HEAVY = 1 << 16
#: Heavy vertices (some 32 bytes each) that are broadcast at most; beyond that, joins shuffle.
FEW = 1 << 20
#: Tables of changes that are joined one by one before they are made one: each takes a sorter of a task's memory.
DELTAS = 2
#: Lanes: their type, the value that changes nothing, and how two are made one.
KINDS = {"max": (np.dtype("i1"), -1, np.maximum), "min": (np.dtype("<i8"), np.iinfo(np.int64).max, np.minimum)}
#: A register that takes no value and sends none.
BLOCKED = 127


def group_of(r: Column) -> Column:
    return F.floor(r / LANES).cast("int")


def bit_of(r: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (r % LANES).cast("int"))


def live_words(edges: DataFrame, sims: DataFrame) -> DataFrame:
    """(u, v, grp, word) of edges (u, v, thr, h): the simulations in which each is live, without a row for each of them."""
    return live_groups(edges, sims, group_of(F.col("r")), bit_of(F.col("r"))).select("u", "v", "grp", "word")


def pack(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, grp, word) of rows (keys, r)."""
    return rows.groupBy(*keys, group_of(F.col("r")).alias("grp")).agg(F.bit_or(bit_of(F.col("r"))).alias("word"))


def unpack(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, r) of rows (keys, grp, word)."""
    each = F.filter(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.call_function("getbit", F.col("word"), k) == 1)
    return words.select(*keys, "grp", F.explode(each).alias("k")).select(*keys, (F.col("grp") * LANES + F.col("k")).alias("r"))


def count(words: DataFrame) -> int:
    """Bits of all words: pairs of a vertex and a simulation."""
    return words.agg(F.sum(F.bit_count("word"))).first()[0] or 0


@dataclass
class Adjacency:
    """Arcs (x, y, grp, word, salt) in buckets, and the keys (x, grp, salts) that are dealt over several salts, if any."""

    arcs: DataFrame
    heavy: DataFrame | None


def adjacency(words: DataFrame, source: str = "u", target: str = "v", heavy: int | None = None) -> Adjacency:
    """What messages follow from source to target; words (u, v, grp, word) are a written table."""
    heavy = HEAVY if heavy is None else heavy
    arcs = words.select(F.col(source).cast("long").alias("x"), F.col(target).cast("long").alias("y"), "grp", "word")
    many = spool(arcs.groupBy("x", "grp").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("x", "grp", F.ceil(F.col("n") / heavy).cast("int").alias("salts")), "heavy")
    k = many.count()
    if not k:
        return Adjacency(bucketed(arcs, ["x", "grp"]), None)
    many = F.broadcast(many) if k <= FEW else many
    salted = arcs.join(many, ["x", "grp"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("y"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    return Adjacency(bucketed(salted, ["x", "grp", "salt"]), many)


def _sent(adj: Adjacency, changed: DataFrame) -> DataFrame:
    """changed (x, grp, ...) with each of its arcs (y, word): only changed is moved, and only if some of it is dealt over salts."""
    if adj.heavy is None:
        return changed.hint("shuffle_hash").join(adj.arcs, ["x", "grp"])
    own = changed.join(adj.heavy, ["x", "grp"], "left")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return own.hint("shuffle_hash").join(adj.arcs, ["x", "grp", "salt"])


# ---- words -----------------------------------------------------------------------------------


def cascade(adj: Adjacency, frontier: DataFrame, visited: DataFrame | None = None, max_rounds: int | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """(tags, v, grp, word): visited before, and what the frontier (tags, v, grp, word) reaches along arcs, itself included.

    tags keep cascades apart that run at once; then visited, without tags, blocks all of them and is not part of the result.
    """
    keys = [*tags, "v", "grp"]
    before = [] if visited is None else [(visited, ["v", "grp"])]
    parts: list[DataFrame] = [] if visited is None or tags else [visited]

    def fresh(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy(*keys).agg(F.bit_or("word").alias("word"))
        for table, on in before + [(p, keys) for p in parts if p is not visited]:
            rows = rows.join(table.select(*on, F.col("word").alias("seen")).hint("merge"), on, "left")  # in buckets: neither side moves
            rows = rows.withColumn("word", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))).drop("seen").where("word != 0")
        return bucketed(rows, keys)

    now, done = fresh(frontier), 0
    while not now.isEmpty():
        parts.append(now)
        if len(parts) > DELTAS:
            parts = [bucketed(_united(parts, keys), keys)]
            before = before if tags else []
        if max_rounds is not None and done >= max_rounds:
            break
        done += 1
        sent = _sent(adj, now.select(*tags, F.col("v").alias("x"), "grp", F.col("word").alias("own")))
        now = fresh(sent.select(*tags, F.col("y").alias("v"), "grp", F.col("word").bitwiseAND(F.col("own")).alias("word")).where("word != 0"))
    return bucketed(_united(parts, keys), keys) if parts else now


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _union(tables: list[DataFrame], *columns: str) -> DataFrame:
    """Rows of all tables, which are dealt out anew.

    Spark 4.1 takes the common buckets of a union's tables for its own, and then reads the tables without buckets; a coalesce, which moves nothing, keeps
    it from that.
    """
    return reduce(DataFrame.unionByName, (t.select(*columns).coalesce(_buckets(t)) for t in tables))


def _united(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    every = _union(parts, *keys, "word")
    return every.groupBy(*keys).agg(F.bit_or("word").alias("word"))


# ---- lanes -----------------------------------------------------------------------------------


def matrix(column: pa.Array, best: str, width: int | None = None) -> np.ndarray:
    """A row of values for each byte array, all of which have as many; nulls change nothing.  width: how many, where all may be null."""
    kind, worst, _ = KINDS[best]
    n = len(column)
    if not n:
        return np.full((0, width or LANES), worst, kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    width = width or int(np.diff(at).max()) // kind.itemsize or LANES
    out = np.full((n, width), worst, kind)
    out[np.diff(at) > 0] = data.view(kind).reshape(-1, width)
    return out


def _lanes(values: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def bits(words: np.ndarray, width: int = LANES) -> np.ndarray:
    """A row of booleans for each word, of its first ``width`` bits."""
    return (words.view(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) == 1


def _runs(x: np.ndarray, grp: np.ndarray) -> np.ndarray:
    """Where runs of equal (x, grp) start."""
    return np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (grp[1:] != grp[:-1])])) if len(x) else np.zeros(0, np.int64)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def messages(batches, best: str):
    """(x, grp, lanes): what arrives at y over arcs (y, grp, word, lanes), reduced within a batch."""
    kind, worst, join = KINDS[best]
    for batch in batches:
        lanes = matrix(_column(batch, "lanes"), best)
        use = bits(_numbers(batch, "word"), lanes.shape[1])
        if best == "max":
            use &= lanes != BLOCKED
        lanes[~use] = worst
        x, grp = _numbers(batch, "y"), _numbers(batch, "grp")
        order = np.lexsort((grp, x))
        order = order[(lanes[order] != worst).any(axis=1)]
        start = _runs(x[order], grp[order])
        if len(start):
            yield pa.record_batch({"x": pa.array(x[order][start]), "grp": pa.array(grp[order][start]), "lanes": _lanes(join.reduceat(lanes[order], start, axis=0))})


def reduced(batches, best: str, known: tuple[str, ...]):
    """(x, grp, lanes, n): messages of one (x, grp), which come next to each other, and what is known there, made one; n lanes changed.

    Without known columns every row stays.
    """
    kind, worst, join = KINDS[best]
    held = None

    def out(x, grp, lanes, old):
        new = join(lanes, old)
        n = (new != old).sum(axis=1)
        keep = n > 0 if known else np.ones(len(n), bool)
        return pa.record_batch({"x": pa.array(x[keep]), "grp": pa.array(grp[keep]), "lanes": _lanes(new[keep]), "n": pa.array(n[keep].astype(np.int64))})

    for batch in batches:
        if not batch.num_rows:
            continue
        x, grp = _numbers(batch, "x"), _numbers(batch, "grp")
        lanes = matrix(_column(batch, "lanes"), best)
        old = reduce(join, [matrix(_column(batch, c), best, lanes.shape[1]) for c in known]) if known else np.full(lanes.shape, worst, kind)
        start = _runs(x, grp)
        x, grp, lanes, old = x[start], grp[start], join.reduceat(lanes, start, axis=0), old[start]
        if held is not None:
            if (held[0][0], held[1][0]) == (x[0], grp[0]):
                lanes[0] = join(lanes[0], held[2][0])
            else:
                yield out(*held)
        yield out(x[:-1], grp[:-1], lanes[:-1], old[:-1])
        held = tuple(a[-1:].copy() for a in (x, grp, lanes, old))
    if held is not None:
        yield out(*held)


_STATE = "x long, grp int, lanes binary"


def propagate(start: DataFrame, adj: Adjacency, best: str, max_rounds: int | None = None, active_rate: float = 0.0, total: int | None = None, senders: DataFrame | None = None) -> DataFrame:
    """(x, grp, lanes): start's values, carried along arcs, of which the ``best`` (min or max) stays in each lane.

    Stops when no value changes, after max_rounds, or when no more than active_rate of ``total`` values changed.  senders (x, grp): those
    that send in the first round, where all others are known to have nothing new to say.
    """
    keys = ["x", "grp"]
    buckets = _buckets(start)
    base = changed = bucketed(start.select(*keys, "lanes"), keys)
    if senders is not None:
        changed = base.join(senders.select(*keys).distinct(), keys, "left_semi")
    deltas: list[DataFrame] = []
    done = 0
    while max_rounds is None or done < max_rounds:
        sent = _sent(adj, changed.select(*keys, "lanes")).select("y", "grp", "word", "lanes").mapInArrow(shipped(messages, best), _STATE)
        rows, known = sent.repartition(buckets, *keys), []
        for k, table in enumerate([base, *deltas]):
            known.append(f"old{k}")
            rows = rows.join(table.select(*keys, F.col("lanes").alias(known[-1])).hint("merge"), keys, "left")
        rows = rows.sortWithinPartitions(*keys).mapInArrow(shipped(reduced, best, tuple(known)), f"{_STATE}, n long")
        changed, done = bucketed(rows, keys, arranged=True), done + 1
        n = changed.agg(F.sum("n")).first()[0] or 0
        if n:
            deltas.append(changed.drop("n"))
        if not n or total is not None and n <= active_rate * total:
            break
        if len(deltas) > DELTAS:
            deltas = [bucketed(_reduced(deltas, best), keys, arranged=True)]
    return bucketed(_reduced([base, *deltas], best), keys, arranged=True) if deltas else base


def _reduced(tables: list[DataFrame], best: str) -> DataFrame:
    every = _union(tables, "x", "grp", "lanes")
    return every.repartition(_buckets(every), "x", "grp").sortWithinPartitions("x", "grp").mapInArrow(shipped(reduced, best, ()), f"{_STATE}, n long").drop("n")


def fmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of unsigned numbers."""
    from spreadlab.functions.hashing import FMIX

    for k in FMIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(k)
    return x ^ (x >> np.uint64(33))


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of unsigned 64-bit numbers, from the exact exponents of their halves."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 - np.frexp(high.astype(float))[1], 64 - np.frexp(low.astype(float))[1])


def first_registers(batches, n_sims: int, offset: int):
    """(x, grp, lanes) of vertices (id): each register is made where it is held."""
    for batch in batches:
        ids = _numbers(batch, "id").astype(np.int64)
        for g in range(-(-n_sims // LANES)):
            r = np.arange(g * LANES, g * LANES + min(n_sims, LANES))
            h = fmix64((~(ids[:, None] * n_sims + r + n_sims + offset)).view(np.uint64))
            lanes = leading_zeros(h).astype("i1")
            lanes[:, r >= n_sims] = -1
            yield pa.record_batch({"x": pa.array(ids), "grp": pa.array(np.full(len(ids), g, np.int32)), "lanes": _lanes(lanes)})


def registers(vertices: DataFrame, n_sims: int, offset: int = 0) -> DataFrame:
    """(x, grp, lanes): leading zeros of the hash of ~(id * n_sims + r + n_sims + offset) in each lane, as ``sketch.registers`` has them in rows."""
    return vertices.select(F.col("id").cast("long").alias("id")).mapInArrow(shipped(first_registers, n_sims, offset), _STATE)


def block(batches):
    """Registers whose word has their lane become BLOCKED."""
    for batch in batches:
        lanes = matrix(_column(batch, "lanes"), "max")
        lanes[bits(_column(batch, "word").fill_null(0).to_numpy(), lanes.shape[1])] = BLOCKED
        yield pa.record_batch({"x": _column(batch, "x"), "grp": _column(batch, "grp"), "lanes": _lanes(lanes)})


def blocked(reg: DataFrame, words: DataFrame) -> DataFrame:
    """reg, with those of words (v, grp, word) taken out of the graph."""
    own = words.select(F.col("v").alias("x"), "grp", "word")
    return reg.join(own, ["x", "grp"], "left").mapInArrow(shipped(block), _STATE)


def reset(batches):
    """Lanes that the word of ``affected`` has go back to the first register, those of ``word`` become BLOCKED."""
    for batch in batches:
        lanes, first = matrix(_column(batch, "lanes"), "max"), matrix(_column(batch, "first"), "max")
        width = lanes.shape[1]
        lanes = np.where(bits(_column(batch, "affected").fill_null(0).to_numpy(), width), first, lanes)
        lanes[bits(_column(batch, "word").fill_null(0).to_numpy(), width)] = BLOCKED
        yield pa.record_batch({"x": _column(batch, "x"), "grp": _column(batch, "grp"), "lanes": _lanes(lanes)})


def newly(visited: DataFrame, before: DataFrame | None) -> DataFrame:
    """What words visited (v, grp, word) have over those before."""
    if before is None:
        return visited
    both = visited.join(before.select("v", "grp", F.col("word").alias("old")), ["v", "grp"], "left")
    return both.select("v", "grp", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("word")).where("word != 0")


def rebuilt(reg: DataFrame, first: DataFrame, forward: Adjacency, back: Adjacency, gone: DataFrame, visited: DataFrame, **stop) -> tuple[DataFrame, DataFrame]:
    """Registers without the visited (v, grp, word), from registers reg that had only ``gone`` of them in addition; and the lanes made anew (v, grp, word).

    Only what reaches a vertex that is newly gone can change: these lanes go back to their first registers, and hear from the vertices
    that their arcs lead to; all others keep their values.  forward and back are the arcs' two directions.
    """
    affected = cascade(back, gone)
    own = affected.select(F.col("v").alias("x"), "grp", F.col("word").alias("affected"))
    out = reg.join(own, ["x", "grp"], "left").join(first.select("x", "grp", F.col("lanes").alias("first")), ["x", "grp"]).join(visited.select(F.col("v").alias("x"), "grp", "word"), ["x", "grp"], "left")
    near = _sent(forward, own).where(F.col("word").bitwiseAND(F.col("affected")) != 0).select(F.col("y").alias("x"), "grp")
    return propagate(out.mapInArrow(shipped(reset), _STATE), back, "max", senders=_union([own, near], "x", "grp"), **stop), affected


def rows_of(batches, best: str):
    """(x, r, val) of (x, grp, lanes)."""
    kind, worst, _ = KINDS[best]
    for batch in batches:
        lanes = matrix(_column(batch, "lanes"), best)
        has = lanes != worst
        if best == "max":
            has &= lanes != BLOCKED
        row, lane = np.nonzero(has)
        r = _numbers(batch, "grp")[row] * LANES + lane
        yield pa.record_batch({"x": pa.array(_numbers(batch, "x")[row]), "r": pa.array(r.astype(np.int32)), "val": pa.array(lanes[row, lane].astype(np.int64))})


def one_lane(batches, best: str):
    """(x, grp, lanes) of rows (x, r, val), reduced within a batch."""
    kind, worst, join = KINDS[best]
    for batch in batches:
        x, r, val = (_numbers(batch, c) for c in ("x", "r", "val"))
        grp, lane = r // LANES, r % LANES
        order = np.lexsort((grp, x))
        start = _runs(x[order], grp[order])
        lanes = np.full((len(start), LANES), worst, kind)
        join.at(lanes, (np.cumsum(np.isin(np.arange(len(order)), start)) - 1, lane[order]), val[order].astype(kind))
        yield pa.record_batch({"x": pa.array(x[order][start]), "grp": pa.array(grp[order][start].astype(np.int32)), "lanes": _lanes(lanes)})


def from_rows(rows: DataFrame, best: str) -> DataFrame:
    """(x, grp, lanes) of rows (x, r, val): the best value of each lane."""
    own = rows.select(F.col("x").cast("long").alias("x"), F.col("r").cast("int").alias("r"), F.col("val").cast("long").alias("val"))
    return _reduced([own.mapInArrow(shipped(one_lane, best), _STATE)], best)


def to_rows(state: DataFrame, best: str, kind: str) -> DataFrame:
    """(x, r, val), with val of the type ``kind``."""
    return state.mapInArrow(shipped(rows_of, best), "x long, r int, val long").select("x", "r", F.col("val").cast(kind).alias("val"))


def summed(batches, low: np.ndarray):
    """(u, total): over a row's lanes, what the larger of register and mask has over the mask."""
    for batch in batches:
        lanes = matrix(_column(batch, "lanes"), "max").astype(np.int64)
        lanes[lanes == BLOCKED] = -1
        own = low[_numbers(batch, "grp")][:, : lanes.shape[1]]
        yield pa.record_batch({"u": _column(batch, "x"), "total": pa.array(np.maximum(lanes - own, 0).sum(axis=1))})


def estimates(reg: DataFrame, mask: dict[int, int], n_sims: int) -> DataFrame:
    """(u, total), as ``sketch.estimates`` has it: sums over arrays, one row for each vertex and group."""
    low = np.zeros(-(-n_sims // LANES) * LANES, np.int64)
    for r, x in mask.items():
        low[r] = x
    own = reg.mapInArrow(shipped(summed, low.reshape(-1, LANES)), "u long, total long")
    return own.groupBy("u").agg((F.sum("total") + sum(mask.values())).alias("total"))


def first_labels(batches, width: int):
    """(x, grp, lanes): x itself in the lanes of its word, of which all are among the first ``width``."""
    worst = KINDS["min"][1]
    for batch in batches:
        x = _numbers(batch, "x")
        yield pa.record_batch({"x": _column(batch, "x"), "grp": _column(batch, "grp"), "lanes": _lanes(np.where(bits(_numbers(batch, "word"), width), x[:, None], worst))})


def min_labels(words: DataFrame, both_ways: bool = False, max_rounds: int | None = None) -> DataFrame:
    """(v, r, label) of the vertices with a live edge: the least vertex that reaches each; words (u, v, grp, word) are a written table."""
    if both_ways:
        back = words.select(F.col("v").alias("u"), F.col("u").alias("v"), "grp", "word")
        words = spool(_union([words, back], "u", "v", "grp", "word").groupBy("u", "v", "grp").agg(F.bit_or("word").alias("word")), "words")
    ends = words.select(F.explode(F.array("u", "v")).alias("x"), "grp", "word").groupBy("x", "grp").agg(F.bit_or("word").alias("word"))
    used = words.agg(F.max("grp").alias("grp"), F.bit_or("word").alias("word")).first()
    width = LANES if used.grp else max(1, ((used.word or 0) % 2**64).bit_length())
    start = ends.select(F.col("x").cast("long").alias("x"), "grp", "word").mapInArrow(shipped(first_labels, width), _STATE)
    out = propagate(start, adjacency(words), "min", max_rounds)
    return to_rows(out, "min", "long").select(F.col("x").alias("v"), "r", F.col("val").alias("label"))
