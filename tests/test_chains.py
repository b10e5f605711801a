"""Directed labels by contraction of chains, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import chains


def labels_of(arcs):
    """{(v, r): label} by going over all arcs until nothing changes."""
    found = {(x, r): x for u, v, r in arcs for x in (u, v)}
    changed = True
    while changed:
        changed = False
        for u, v, r in arcs:
            if found[u, r] < found[v, r]:
                found[v, r], changed = found[u, r], True
    return found


def got(spark, arcs, report=None):
    rows = chains.directed_labels(spark.createDataFrame(arcs, "u long, v long, r int"), report).collect()
    assert len(rows) == len({(x.v, x.r) for x in rows})
    return {(x.v, x.r): x.label for x in rows}


def odd_shapes():
    """Each shape in a simulation of its own."""
    cycle = [(10, 11), (11, 12), (12, 10), (12, 13), (13, 3), (3, 14)]  # a cycle that nothing leads to, and its tail
    entered = [(10, 11), (11, 12), (12, 10), (2, 11), (12, 20)]
    ladder = [(19 - i, 19 - j) for j in range(1, 20) for i in (j - 1, j - 2) if i >= 0]
    star = [(50, x) for x in range(30)] + [(60, 50)]
    into = [(x, 90) for x in range(5, 25)] + [(90, 91), (91, 4), (4, 92)]
    loops = [(7, 7), (8, 8), (8, 9), (8, 9)]
    meeting = [(9, 8), (8, 5), (9, 7), (7, 5), (5, 6), (1, 7)]
    return [(u, v, r) for r, shape in enumerate((cycle, entered, ladder, star, into, loops, meeting)) for u, v in shape]


def test_odd_shapes(spark):
    arcs = odd_shapes()
    assert got(spark, arcs) == labels_of(arcs)


@pytest.mark.parametrize("degree", [0.9, 1.6])
def test_random_graphs(spark, degree):
    some = random.Random(int(degree * 10))
    arcs = [(some.randrange(60), some.randrange(60), r) for r in range(12) for _ in range(int(60 * degree))]
    assert got(spark, arcs) == labels_of(arcs)


def test_a_long_path_takes_few_rounds(spark):
    n, report = 100_000, []
    at = F.col("id") * 7919 % n  # ids in no order along the path
    path = spark.range(n - 1).select(at.alias("u"), ((F.col("id") + 1) * 7919 % n).alias("v"), F.lit(0).alias("r"))
    labels = chains.directed_labels(path, report)
    assert labels.where("label != 0").count() == 0 and labels.count() == n  # the path starts at 0
    assert sum(report) < 25


def test_no_arcs(spark):
    assert got(spark, []) == {}
