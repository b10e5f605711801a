"""Compressed rows as a data source: parts, ranges, pushed-down bounds, odd tables."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.sources import csr
from spreadlab.sources import edges as E

COLUMNS = "u long, v long, thr long"


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def graph():
    """A hub of half of all edges, sources without edges between, equal rows."""
    rng = np.random.default_rng(7)
    rows = [(5000, int(x), 9) for x in rng.integers(0, 300, 1500)]
    rows += [(int(u), int(v), int(t)) for u, v, t in zip(rng.integers(0, 400, 1400), rng.integers(0, 90_000, 1400), rng.integers(0, 1 << 31, 1400), strict=True)]
    return [*rows, (0, 0, 1), (0, 0, 1), (80_000, 4_294_967_295, 2**31 - 1)]


def test_parts_hold_the_graph_and_ranges_read_less(spark, tmp_path):
    rows, folder = graph(), f"{tmp_path}/g"
    E.write_csr(table(spark, rows).repartition(3), folder)
    told = json.loads((tmp_path / "g" / csr.MANIFEST).read_text())
    assert told["n"] == 1 << 32 and told["m"] == len(rows)
    for block in (700, None):
        assert rows_of(E.read_csr(spark, folder, block)) == sorted(rows)
    for first, last in ((0, 0), (5000, 5000), (10, 300), (5001, 79_999), (None, 399), (400, None), (90_000, 99_999)):
        wanted = sorted(r for r in rows if (first is None or r[0] >= first) and (last is None or r[0] <= last))
        assert rows_of(E.read_csr(spark, folder, 100, first, last)) == wanted
        planned = csr.plan({"path": folder, "block": "100"}, first, last)
        assert sum(b - a for _, a, b in planned) == len(wanted)  # nothing else is read


def test_a_hub_spans_parts(spark, tmp_path):
    rows = [(7, v, 1) for v in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        E.write_csr(table(spark, rows), f"{tmp_path}/hub")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = json.loads((tmp_path / "hub" / csr.MANIFEST).read_text())["parts"]
    assert len(parts) == 2 and all(p[1] == 7 and p[3] < 3000 for p in parts)
    assert rows_of(E.read_csr(spark, f"{tmp_path}/hub", 64, 7, 7)) == rows


def test_filters_are_pushed_down(spark, tmp_path):
    rows, folder = graph(), f"{tmp_path}/g"
    E.write_csr(table(spark, rows), folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = E.read_csr(spark, folder, 50).where((F.col("u") > 20) & (F.col("u") <= 60) & (F.col("v") < 40_000))
        wanted = sorted(r for r in rows if 20 < r[0] <= 60 and r[1] < 40_000)
        assert rows_of(some) == wanted
        text = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert re.search(r"PushedFilters: .*u.* > 20.*u.* <= 60|PushedFilters: .*GreaterThan\(u,20\).*LessThanOrEqual\(u,60\)", text), text
        assert not re.search(r"Condition : .*u#\d+L >", text), text  # Spark filters by v alone
        assert some.rdd.getNumPartitions() <= 2 + sum(20 < r[0] <= 60 for r in rows) // 50
        assert rows_of(E.read_csr(spark, folder).where("u = 5000")) == sorted(r for r in rows if r[0] == 5000)
        assert E.read_csr(spark, folder).where("u in (0, 5000)").count() == sum(r[0] in (0, 5000) for r in rows)
        assert E.read_csr(spark, folder).where("u > 70000 and u < 70000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_append_overwrite_and_empty(spark, tmp_path):
    folder = f"{tmp_path}/g"
    E.write_csr(table(spark, []), folder)
    assert rows_of(E.read_csr(spark, folder)) == []
    E.write_csr(table(spark, [(1, 2, 3)]), folder)
    E.write_csr(table(spark, [(0, 9, 3)]), folder, mode="append")
    assert rows_of(E.read_csr(spark, folder)) == [(0, 9, 3), (1, 2, 3)]
    E.write_csr(table(spark, [(4, 4, 4)]).withColumn("U2", F.lit(1)), folder)
    assert rows_of(E.read_csr(spark, folder)) == [(4, 4, 4)]
    assert len(list((tmp_path / "g").glob("*.arcs"))) == 1  # parts that no manifest names are gone
    with pytest.raises(Exception, match="not.?found|FileNotFound|no-such"):
        E.read_csr(spark, f"{tmp_path}/no-such").count()


@pytest.mark.parametrize("bad", [(None, 1, 1), (1, 1, None), (-1, 0, 1), (0, 1 << 32, 1)])
def test_bad_edges_are_errors_and_leave_the_old_graph(spark, tmp_path, bad):
    folder = f"{tmp_path}/g"
    E.write_csr(table(spark, [(1, 2, 3)]), folder)
    with pytest.raises(Exception, match="null|32 bits"):
        E.write_csr(table(spark, [(0, 0, 1), bad]), folder)
    assert rows_of(E.read_csr(spark, folder)) == [(1, 2, 3)]


def test_long_runs_of_sources_without_edges(monkeypatch, tmp_path):
    import pyarrow as pa

    monkeypatch.setattr(csr, "WINDOW", 3)
    monkeypatch.setattr(csr, "BATCH", 2)
    rows = [(2, 1, 1), (2, 2, 1), (2, 3, 1), (30, 4, 2), (31, 5, 3), (90, 6, 4)]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], ["u", "v", "thr"]) for some in (rows[:2], rows[2:4], rows[4:])]
    csr.commit(str(tmp_path), [csr.write_part(batches, str(tmp_path))], True)
    options = {"path": str(tmp_path), "block": "4"}
    got = [r for x in csr.plan(options) for b in csr.read_range(options, *x) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == rows
    with pytest.raises(ValueError, match="order"):
        csr.write_part(batches[::-1], str(tmp_path))
