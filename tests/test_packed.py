"""Packed rounds, compiled hashes, prefix joins and star contraction against plain Python."""

import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_influence import N, graph, py_live, py_reach

from spreadlab.functions import hashing as H
from spreadlab.operators import contraction, packed, sampling, select, sketch
from spreadlab.operators import spread as S
from spreadlab.session import ROOT, bucketed, spool

SIMS = 70  # more than a word


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(8)
    edges = [(u, v, rng.choice([0.1, 0.4, 1.0])) for u, v in sorted({(rng.randrange(N), rng.randrange(N)) for _ in range(26)})]
    e, sims = spool(graph(spark, edges)), sampling.seeds(spark, SIMS)
    return e, sims, py_live(edges, SIMS), spool(packed.live_words(e, sims))


def test_compiled_hashes_are_the_same(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(2**31), rng.randrange(2**31), rng.randrange(-(2**63), 2**63)) for _ in range(300)] + [(0, 0, 0), (1, 2, -1)], "u long, v long, x long")
    u, v = F.col("u"), F.col("v")
    for compiled, plain in ((H.with_edge_hash, H.edge_hash), (H.with_edge_hash_undirected, H.edge_hash_undirected), (H.with_edge_hash_crc32c, H.edge_hash_crc32c)):
        assert compiled(rows, "h", u, v).where(F.col("h") != plain(u, v)).count() == 0
    assert H.with_fmix64(rows, "h", F.col("x")).where(F.col("h") != H.fmix64(F.col("x"))).count() == 0
    assert H.with_fmix64(rows, "x", F.col("x")).columns == ["u", "v", "x"]  # in place


def test_a_prefix_finds_every_live_simulation(spark):
    rng = random.Random(3)
    thr = [0, 1, 2, 3, 4, 5, 2**31 - 1, 2**31] + [2**k + d for k in range(1, 31) for d in (-1, 0, 1)] + [rng.randrange(2**31) for _ in range(200)]
    x = [rng.randrange(2**31) for _ in range(60)] + [0, 2**31 - 1]
    rows = [(k, 1, t, rng.choice([rng.choice(x) ^ rng.randrange(max(t, 1)) & (2**31 - 1), rng.randrange(2**31)])) for k, t in enumerate(thr)]
    sims, arcs = sampling.seeds_from(x, spark), spark.createDataFrame([*rows, (-1, 1, None, 5), (-2, 1, 2**31, None)], "u long, v long, thr long, h long")
    want = {(u, r) for u, _, t, h in rows for r, y in enumerate(x) if y ^ h < t}
    assert {(r.u, r.r) for r in sampling.live_edges(arcs, sims).collect()} == want
    words = sampling.live_groups(arcs, sims, F.floor(F.col("r") / 10), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("r") % 10).cast("int"))).collect()
    assert {(w.u, w.grp * 10 + k) for w in words for k in range(10) if w.word >> k & 1} == want
    assert len({(w.u, w.grp) for w in words}) == len(words)
    plan = sampling.live_edges(arcs, sims)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_words_and_back(some):
    _, _, live, words = some
    rows = packed.unpack(words, "u", "v")
    assert {(r.u, r.v, r.r) for r in rows.collect()} == live
    assert packed.count(words) == len(live)
    assert {tuple(r) for r in packed.pack(rows, "u", "v").collect()} == {tuple(r) for r in words.select("u", "v", "grp", "word").collect()}


@pytest.mark.parametrize("heavy", [1 << 16, 1])
def test_cascades_by_rounds(some, heavy):
    _, sims, live, words = some
    adj = packed.adjacency(words, heavy=heavy)
    assert (adj.heavy is None) == (heavy > 1)

    def walk(seeds, visited=None, **more):
        return packed.cascade(adj, packed.pack(S.at_seeds(seeds, sims), "v"), visited, **more)

    def reach(*seeds):
        return {(v, r) for r in range(SIMS) for v in py_reach(live, seeds, r)}

    one = walk([0])
    assert {(x.v, x.r) for x in packed.unpack(one, "v").collect()} == reach(0)
    assert {(x.v, x.r) for x in packed.unpack(walk([3], one), "v").collect()} == reach(0, 3)
    assert {(x.v, x.r) for x in packed.unpack(walk([0], max_rounds=1), "v").collect()} == {(0, r) for r in range(SIMS)} | {(v, r) for u, v, r in live if u == 0}
    start = packed.pack(S.at_seeds([1, 2], sims), "v").withColumn("seed", F.col("v"))
    both = packed.unpack(packed.cascade(adj, start, one, tags=("seed",)), "seed", "v").collect()
    assert {(x.seed, x.v, x.r) for x in both} == {(s, v, r) for s in (1, 2) for v, r in reach(s) - reach(0)}
    assert packed.count(walk([0, 3], walk([0, 3]))) == len(reach(0, 3))


def test_lanes_by_rounds(spark, some):
    heavy = 1  # every vertex of several arcs
    _, sims, live, words = some
    ids = spark.range(N).toDF("id")
    first = {(r.x, r.r): r.val for r in sketch.registers(ids, sims, SIMS).collect()}
    reg, back = packed.registers(ids, SIMS), packed.adjacency(words, "v", "u", heavy)
    assert {(r.x, r.r): r.val for r in packed.to_rows(reg, "max", "int").collect()} == first
    assert {(r.x, r.r): r.val for r in packed.to_rows(packed.from_rows(sketch.registers(ids, sims, SIMS), "max"), "max", "int").collect()} == first
    out = packed.propagate(reg, back, "max")
    want = {(i, r): max(first[j, r] for j in py_reach(live, [i], r)) for i in range(N) for r in range(SIMS)}
    assert {(r.x, r.r): r.val for r in packed.to_rows(out, "max", "int").collect()} == want
    mask = {0: 3, 5: 60, 69: 1}
    total = {u: sum(max(want[u, r], mask.get(r, 0)) for r in range(SIMS)) for u in range(N)}
    assert {r.u: r.total for r in packed.estimates(out, mask, SIMS).collect()} == total
    # registers made anew in two steps are those of a full rebuild
    forward, gone, reg1 = packed.adjacency(words, heavy=heavy), None, out
    for seed in (0, 3):
        before = gone
        gone = packed.cascade(forward, packed.pack(S.at_seeds([seed], sims), "v"), before)
        reg1, touched = packed.rebuilt(reg1, spool(reg), forward, back, packed.newly(gone, before), gone)
        out_of = {(x.v, x.r) for x in packed.unpack(gone, "v").collect()}
        kept = {(i, r): max(first[j, r] for j in py_reach(live, [i], r) if (j, r) not in out_of) for i in range(N) for r in range(SIMS) if (i, r) not in out_of}
        assert {(r.x, r.r): r.val for r in packed.to_rows(reg1, "max", "int").collect()} == kept
    assert packed.count(touched) < N * SIMS


def test_labels_by_rounds(some):
    e, sims, live, words = some
    ends = {(x, r) for u, v, r in live for x in (u, v)}
    assert {(x.v, x.r): x.label for x in packed.min_labels(words).collect()} == {(v, r): min(u for u in range(N) if v in py_reach(live, [u], r)) for v, r in ends}
    both = live | {(v, u, r) for u, v, r in live}
    weak = {(v, r): min(py_reach(both, [v], r)) for v, r in ends}
    assert {(x.v, x.r): x.label for x in packed.min_labels(words, True).collect()} == weak
    assert {(x.v, x.r): x.label for x in contraction.weak_labels(sampling.live_edges(e, sims)).collect()} == weak


def test_greedy_by_rounds(spark, some):
    e, _, _, _ = some
    ids, sims = spark.range(N).toDF("id"), sampling.seeds(spark, 8)

    def rows(method, **options):
        return [(r.step, r.seed, round(r.score, 6)) for r in method(e, ids, sims, 2, **options).collect()]

    for method, options in ((select.sketch_greedy, {"rebuild": "always", "parts": 2}), (select.mix_greedy, {}), (select.component_greedy, {})):
        assert rows(method, local=False, **options) == rows(method, local=True, **options)


def test_a_round_moves_no_arcs(spark, some):
    _, sims, _, words = some
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for heavy in (1 << 16, 1):
        adj = packed.adjacency(words, heavy=heavy)
        now = bucketed(packed.pack(S.at_seeds([0, 1], sims), "v").select(F.col("v").alias("x"), "grp", F.col("word").alias("own")), ["x", "grp"])
        plan = packed._sent(adj, now)._jdf.queryExecution().executedPlan().toString()
        arcs = plan[plan.rindex("+- Filter") :]  # the join's second side
        assert "Exchange" not in arcs and "Bucketed: true" in arcs
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == keep


def test_a_star_is_dealt_over_salts(spark):
    words = spool(spark.range(4_000).select(F.lit(0).cast("long").alias("u"), (F.col("id") + 1).alias("v"), F.lit(0).alias("grp"), F.lit(3).cast("long").alias("word")))
    adj = packed.adjacency(words, heavy=20)
    sizes = [r["count"] for r in adj.arcs.groupBy("x", "grp", "salt").count().collect()]
    assert len(sizes) == 200 and max(sizes) < 60
    out = packed.cascade(adj, spark.createDataFrame([(0, 0, 1)], "v long, grp int, word long"))
    assert packed.count(out) == 4_001
    back = packed.propagate(packed.registers(spark.range(4_001).toDF("id"), 2), packed.adjacency(words, "v", "u", 20), "max")  # many arcs into one vertex
    hub = packed.to_rows(back, "max", "int").where("x = 0").collect()
    best = sketch.registers(spark.range(4_001).toDF("id"), sampling.seeds(spark, 2), 2).groupBy("r").agg(F.max("val").alias("m")).collect()
    assert {r.r: r.val for r in hub} == {r.r: r.m for r in best}


def test_a_long_path_takes_few_rounds(spark):
    n = 5_000
    order = np.random.default_rng(0).permutation(n).tolist()
    path = spark.createDataFrame([(0, a, b) for a, b in zip(order, order[1:], strict=False)], "r int, u long, v long")
    found, rounds = contraction.stars(path)
    assert rounds < 25
    assert found.where("v = 0").count() == n - 1 == found.count()
    assert contraction.weak_labels(path.limit(0)).count() == 0


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        from spreadlab.operators import sampling, select
        arcs = sampling.graph(spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "s long, t long, w double"))
        ids = spark.range(3).toDF("id")
        for local in (True, False):
            print([r.seed for r in select.sketch_greedy(arcs, ids, sampling.seeds(spark, 4), 2, local=local).collect()])
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("[0, ") == 2, done.stderr[-3000:]


def test_an_index_of_components_gives_exact_gains(spark, some):
    e, _, _, _ = some
    ids, sims = spark.range(N).toDF("id"), sampling.seeds(spark, 8)
    want = [(r.step, r.seed, round(r.score, 6)) for r in select.component_greedy(e, ids, sims, N + 1).collect()]
    assert [(r.step, r.seed, round(r.score, 6)) for r in select.component_greedy_indexed(e, ids, sims, N + 1).collect()] == want
    assert len(want) == N
