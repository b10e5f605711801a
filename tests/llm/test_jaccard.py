"""The Jaccard join against all pairs, on texts that exercise light, heavy, frequent and mixed sets."""

import random
import re

import pytest

from spreadlab.llm import jaccard as J
from spreadlab.llm.components import connected


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(5000))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([1, 4, 6, 9, 12, 18, 20, 24, 40, 90]))]
        if rng.random() < 0.4:
            base += passage
        rows.append(base)
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy[rng.randrange(2) :] + [word()] * rng.randrange(2))
    chain = [word() for _ in range(60)]  # each is close to the next one only
    for _ in range(60):
        chain = [*chain[1:], word()]
        rows.append(list(chain))
    rng.shuffle(rows)
    return [(i, rng.choice([" ", "  ", "\n"]).join(x).replace("w1", rng.choice(["W1", "w1"]))) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 48), (2, 3)])
def test_components_match_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rows = [*texts(seed), (900, None), (901, ""), (902, "  \n "), (903, "One"), (904, "one"), (905, "x " * 3000)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def by_rows(rows):
    """(size, least id of the component) of each row; rows without id take part, but name no component."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def bridged(n, ids, rng):
    """Three texts of n words of which only neighbours are close."""
    words = ["b" + str(rng.randrange(10**6)) for _ in range(n)]
    k = max(1, round((n - 4) * 0.09))
    left, right = list(words), list(words)
    for j in range(k):
        left[j] = "l" + str(rng.randrange(10**6))
        right[n - 1 - j] = "r" + str(rng.randrange(10**6))
    return list(zip(ids, (" ".join(x) for x in (left, words, right)), strict=True))


@pytest.mark.parametrize("boundary", [None, 0, 16])
def test_sets_without_id_carry_links(spark, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *_: boundary)
    rng = random.Random(8)
    rows = bridged(15, (1, None, 2), rng) + bridged(16, (5, 6, 7), rng) + bridged(64, (11, None, 12), rng) + bridged(200, (None, None, 21), rng) + bridged(40, (None, None, None), rng)
    rows += [(None, rows[0][1]), (31, "x y"), (None, "x y"), (None, "  ")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_rows(rows), key=str)
    assert len({c for i, _, c in by_rows(rows) if i in (11, 12)}) == 1


def test_sets_that_share_a_name_are_told_apart(spark):
    rows = texts(3)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), name_bits=5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_a_list_of_very_many_members_and_an_outsider(spark):
    base = [f"w{i}" for i in range(60)]
    near = ["c0", "c1", "c2", "c3", "c4", *base[5:]]
    far = [*near[:55], "d0", "d1", "d2", "d3", "d4"]
    rows = [(i, " ".join([*base, f"u{i}"])) for i in range(2, 50_000)] + [(1, " ".join(near)), (0, " ".join(far)), (60_000, "alone " * 9)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.component_id, r["count"]) for r in got.groupBy("component_id").count().collect()} == {(0, 50_000), (60_000, 1)}


def test_rows_in_rows_out(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "x"), (None, None, None), (7, "q r s t u v", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, J.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (7, 2, 7)], key=str)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "None", "None"]
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_light_rows_grow_with_the_boundary():
    assert J.needed(10, 10, 80, 100) == 9 and J.prefix_size(10, 80, 100) == 3
    assert J.subset_rows(4, 80, 100, 16) == 2 and J.subset_rows(10, 80, 100, 10) == 22 - 2 or J.subset_rows(10, 80, 100, 10) > 0
    assert J.choose_boundary({}, 0.0, 80, 100) == 0
    assert J.choose_boundary({3: 1000}, 5.0, 80, 100) >= 3


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3), (7, 7), (5, 4)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
