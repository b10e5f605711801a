"""Rows have lanes for the simulations there are."""

from pyspark.sql import functions as F

from spreadlab.operators import packed, sampling
from spreadlab.session import spool


def test_lanes_are_as_many_as_simulations(spark):
    ids = spark.range(40).toDF("id")
    assert {r.n for r in packed.registers(ids, 8).select(F.length("lanes").alias("n")).collect()} == {8}
    assert {(r.grp, r.n) for r in packed.registers(ids, 70).select("grp", F.length("lanes").alias("n")).collect()} == {(0, 64), (1, 64)}


def test_narrow_rounds_are_those_of_rows(spark):
    rows = [(u, v, 0.3) for u in range(12) for v in range(12) if (u * 7 + v * 5) % 4 == 0]
    for n in (1, 3, 8, 64, 65):
        e = sampling.graph(spark.createDataFrame(rows, "s long, t long, w double"))
        words = spool(packed.live_words(e, sampling.seeds(spark, n)), "words")
        want = {}
        for u, v, r in packed.unpack(words, "u", "v").collect():
            want.setdefault(r, set()).add((u, v))
        labels = {}
        for r, arcs in want.items():
            own = {x: x for a in arcs for x in a}
            while any(own[u] < own[v] for u, v in arcs):
                for u, v in arcs:
                    own[v] = min(own[u], own[v])
            labels |= {(v, r): x for v, x in own.items()}
        assert {(x.v, x.r): x.label for x in packed.min_labels(words).collect()} == labels
