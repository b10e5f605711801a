"""Cascades, labels, registers and seed selection on small graphs, against plain Python."""

import random
from collections import deque

import pytest

from spreadlab.functions import hashing as H
from spreadlab.operators import sampling, select, sketch
from spreadlab.operators import spread as S
from spreadlab.session import spool

N = 12


def py_hash(u, v):
    return H.py_fmix64((u << 32) | v) & H.MASK31


def graph(spark, edges):
    return sampling.graph(spark.createDataFrame(edges, "s long, t long, w double"))


def py_live(edges, n):
    x = [H.py_fmix64(r + 1) & H.MASK31 for r in range(n)]
    return {(u, v, r) for u, v, p in edges for r in range(n) if x[r] ^ py_hash(u, v) < min(int(p * 2**31), 2**31)}


def py_reach(live, starts, r):
    out, todo = set(starts), deque(starts)
    while todo:
        u = todo.popleft()
        for a, b, q in live:
            if a == u and q == r and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(N), rng.randrange(N)) for _ in range(30)})
    edges = [(u, v, rng.choice([0.25, 0.5, 1.0])) for u, v in edges]
    n = 6
    e = spool(graph(spark, edges))
    ids = spark.range(N).toDF("id")
    return edges, n, e, ids, sampling.seeds(spark, n), py_live(edges, n)


def test_live_edges(random_graph):
    _, _, e, _, sims, live = random_graph
    assert {(r.u, r.v, r.r) for r in sampling.live_edges(e, sims).collect()} == live


def test_extreme_probabilities(spark):
    e = graph(spark, [(0, 1, 0.0), (1, 2, 1.0)])
    sims = sampling.seeds(spark, 16)
    assert {(r.u, r.v) for r in sampling.live_edges(e, sims).collect()} == {(1, 2)}


def test_cascade_and_order_of_seeds(random_graph):
    _, n, e, _, sims, live = random_graph
    edges = spool(sampling.live_edges(e, sims))
    want = {(v, r) for r in range(n) for v in py_reach(live, [0, 3], r)}
    one = S.cascade(edges, S.at_seeds([0, 3], sims))
    assert {(r.v, r.r) for r in one.collect()} == want
    first = S.cascade(edges, S.at_seeds([3], sims))
    assert {(r.v, r.r) for r in S.cascade(edges, S.at_seeds([0], sims), first).collect()} == want
    assert select.oracle(e, sims, [0, 3]).first().spread == len(want) / n


def test_path_and_cycle(spark):
    sims = sampling.seeds(spark, 3)
    path = spool(sampling.live_edges(graph(spark, [(3, 4, 1.0), (0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]), sims))
    assert [S.cascade(path, S.at_seeds([v], sims)).count() // 3 for v in range(5)] == [5, 4, 3, 2, 1]
    assert S.cascade(path, S.at_seeds([0], sims), max_rounds=2).count() == 9
    ring = spool(sampling.live_edges(graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)]), sims))
    assert S.cascade(ring, S.at_seeds([2], sims)).count() == 12
    assert {r.label for r in S.min_labels(ring).collect()} == {0}


def test_labels(random_graph):
    _, n, e, _, sims, live = random_graph
    got = {(r.v, r.r): r.label for r in S.min_labels(sampling.live_edges(e, sims)).collect()}
    for r in range(n):
        reach = {s: py_reach(live, [s], r) for s in range(N)}
        for v in range(N):
            want = min(s for s in range(N) if v in reach[s])
            assert got.get((v, r), v) == want <= v


def py_registers(n):
    return {(i, r): 64 - H.py_fmix64(~(i * n + r + n)).bit_length() for i in range(N) for r in range(n)}


def test_registers_and_blocked(random_graph):
    _, n, e, ids, sims, live = random_graph
    edges, first = spool(sampling.live_edges(e, sims)), py_registers(n)
    reg = sketch.registers(ids, sims, n)
    assert {(r.x, r.r): r.val for r in reg.collect()} == first
    got = {(r.x, r.r): r.val for r in sketch.propagate_registers(reg, edges).collect()}
    assert got == {(i, r): max(first[j, r] for j in py_reach(live, [i], r)) for i in range(N) for r in range(n)}
    gone = S.cascade(edges, S.at_seeds([0], sims))
    left = {(r.x, r.r): r.val for r in sketch.propagate_registers(reg, edges, gone).collect()}
    hidden = {(r.v, r.r) for r in gone.collect()}
    assert left == {(i, r): max(first[j, r] for j in py_reach(live, [i], r) if (j, r) not in hidden) for i in range(N) for r in range(n) if (i, r) not in hidden}


def test_component_greedy_is_plain_greedy(random_graph):
    _, n, e, ids, sims, live = random_graph
    label = {}
    for r in range(n):
        reach = {s: py_reach(live, [s], r) for s in range(N)}
        for v in range(N):
            label[v, r] = min(s for s in range(N) if v in reach[s])
    size = {}
    for (_, r), k in label.items():
        size[r, k] = size.get((r, k), 0) + 1
    covered, want, score = set(), [], 0.0
    for _ in range(4):
        gain = {v: sum(size[r, label[v, r]] for r in range(n) if (r, label[v, r]) not in covered) for v in range(N) if v not in [w for w, _ in want]}
        v = min(gain, key=lambda v: (-gain[v], v))
        score += gain[v] / n
        covered |= {(r, label[v, r]) for r in range(n)}
        want.append((v, round(score, 6)))
    for options in ({}, {"batch": 2}, {"by_reset": True}):
        got = select.component_greedy(e, ids, sims, 4, **options).orderBy("step").collect()
        assert [(r.seed, round(r.score, 6)) for r in got] == want


def test_mix_greedy_is_plain_greedy(random_graph):
    _, n, e, ids, sims, live = random_graph
    seen, want = set(), []
    for _ in range(3):
        gain = {v: sum(len({(x, r) for x in py_reach(live, [v], r)} - seen) for r in range(n)) for v in range(N) if v not in [w for w, _ in want]}
        v = min(gain, key=lambda v: (-gain[v], v))
        seen |= {(x, r) for r in range(n) for x in py_reach(live, [v], r)}
        want.append((v, round(len(seen) / n, 6)))
    assert [(r.seed, round(r.score, 6)) for r in select.mix_greedy(e, ids, sims, 3).orderBy("step").collect()] == want


def test_partitions_change_nothing(random_graph):
    _, _, e, ids, sims, _ = random_graph
    whole = select.sketch_greedy(e, ids, sims, 3, rebuild="always", early_stop=1.001)
    parted = select.sketch_greedy(e, ids, sims, 3, rebuild="always", early_stop=1.001, parts=3)
    pick = ("seed", "score")
    assert whole.select(*pick).collect() == parted.select(*pick).collect()


def test_early_stop_repeats_the_score(spark):
    e, ids, sims = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]), spark.range(3).toDF("id"), sampling.seeds(spark, 4)
    got = select.sketch_greedy(e, ids, sims, 3, rebuild="always", early_stop=1.001).orderBy("step").collect()
    assert [r.score for r in got] == [3.0, 3.0, 3.0] and sorted(r.seed for r in got) == [0, 1, 2]


def test_prune_and_fill_rate(random_graph):
    edges, n, e, _, sims, live = random_graph
    got = {(r.part, r.u, r.v) for r in sampling.prune(e, sims, 3).collect()}
    assert got == {(r // 2, u, v) for u, v, r in live}
    groups = {(u, v) for u, v, _ in live}
    row = sampling.fill_rate(sampling.live_edges(e, sims)).first()
    assert (row.filled, row.taken) == (len(live), 32 * len(groups))
    empty = sampling.fill_rate(sampling.live_edges(e.limit(0), sims)).first()
    assert (empty.filled, empty.taken, empty.fill_rate) == (0, 0, None)


@pytest.mark.parametrize("rows", [0, 10**6])
def test_rounds_as_jobs_and_in_one_task_agree(random_graph, monkeypatch, rows):
    monkeypatch.setattr(S, "ROWS", rows)
    monkeypatch.setattr(S, "DELTAS", 1)
    _, n, e, ids, sims, live = random_graph
    edges, first = spool(sampling.live_edges(e, sims)), py_registers(n)
    assert S.fits(edges) == bool(rows)
    got = {(r.x, r.r): r.val for r in sketch.propagate_registers(sketch.registers(ids, sims, n), edges).collect()}
    assert got == {(i, r): max(first[j, r] for j in py_reach(live, [i], r)) for i in range(N) for r in range(n)}
    visited = S.cascade(edges, S.at_seeds([0], sims), S.cascade(edges, S.at_seeds([3], sims)))
    assert {(v.v, v.r) for v in visited.collect()} == {(v, r) for r in range(n) for v in py_reach(live, [0, 3], r)}
    some = select.marginal_gains(edges, sims, visited, [1, 2], n)
    old = {(v, r) for r in range(n) for v in py_reach(live, [0, 3], r)}
    assert some == {v: sum(len({(x, r) for x in py_reach(live, [v], r)} - old) for r in range(n)) / n for v in (1, 2)}
    assert S.cascade(edges.limit(0), S.at_seeds([5], sims)).count() == n
    for stop in ({"max_rounds": 1}, {"active_rate": 1.0, "total": N * n}):
        one = {(r.x, r.r): r.val for r in sketch.propagate_registers(sketch.registers(ids, sims, n), edges, None, **stop).collect()}
        assert one == {(i, r): max([first[i, r], *(first[v, r] for u, v, q in live if (u, q) == (i, r))]) for i in range(N) for r in range(n)}
    harmonic = {(r.x, r.r): r.val for r in sketch.registers_harmonic(ids, sims, n).collect()}
    spread = sketch.propagate_registers(sketch.registers_harmonic(ids, sims, n), edges).collect()
    assert {(r.x, r.r): r.val for r in spread} == {(i, r): max(harmonic[j, r] for j in py_reach(live, [i], r)) for i in range(N) for r in range(n)}


def lazily(spark, gains, k, ahead, monkeypatch, rescored=None):
    """What lazy_greedy chooses, and the sizes of what it collects."""
    sizes, collect = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: sizes.append(out := collect(self)) or out)
    table = spark.createDataFrame(sorted(gains.items()), "v long, gain double")
    got = [v for _, v, _, _ in select.lazy_greedy(table, k, lambda some, step: {v: (rescored or gains)[v] for v in some}, lambda v: None, batch=4, ahead=ahead, exact=rescored is None)]
    return got, [len(x) for x in sizes]


def test_lazy_selection_holds_few_candidates(spark, monkeypatch):
    got, sizes = lazily(spark, dict.fromkeys(range(20_000), 1.0), 2, 1024, monkeypatch)
    assert got == [0, 1] and max(sizes) <= 1025


def test_lazy_selection_looks_beyond_what_it_holds(spark, monkeypatch):
    rng = random.Random(1)
    bounds = {v: float(rng.randrange(50, 100)) for v in range(200)}
    real = {v: float(rng.randrange(int(g))) for v, g in bounds.items()}
    got, sizes = lazily(spark, bounds, 12, 8, monkeypatch, real)
    assert got == sorted(real, key=lambda v: (-real[v], v))[:12] and max(sizes) <= 9


def test_lazy_selection_ends_with_its_vertices(spark, monkeypatch):
    assert lazily(spark, {3: 1.0, 5: 2.0, 4: 2.0}, 9, 2, monkeypatch)[0] == [4, 5, 3]


def test_fill_rate_of_rounds(random_graph):
    _, n, e, ids, sims, live = random_graph
    reg, filled, taken, active = py_registers(n), 0, 0, set(range(N))
    for _ in range(20):
        use = [(u, v, r) for u, v, r in live if v in active]
        filled, taken = filled + len(use), taken + 32 * len({(u, v) for u, v, _ in use})
        after = {(i, r): max([reg[i, r], *(reg[v, r] for u, v, q in live if (u, q) == (i, r))]) for i, r in reg}
        active, reg = {i for i, r in reg if after[i, r] != reg[i, r]}, after
        if not active:
            break
    row = sampling.fill_rate_of_rounds(sketch.registers(ids, sims, n), sampling.live_edges(e, sims)).first()
    assert (row.filled, row.taken) == (filled, taken)
