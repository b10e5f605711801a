"""Integer hashes, safe under ANSI arithmetic.

For whole tables, ``with_fmix64`` and its kin bind each intermediate value to a column of a projection of its own: these stay apart in the
plan, as each is used more than once, and are compiled into one stage.  The same hashes as Column expressions, for use where there is
no table to add columns to, bind values by lambdas, which Spark interprets row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK31 = 0x7FFFFFFF
M32 = 0xFFFFFFFF
# Multipliers of the 64-bit finalizer, and the reflected Castagnoli polynomial.
FMIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
CASTAGNOLI = 0x82F63B78


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def multiply(a: Column, constant: int) -> Column:
    """a * constant modulo 2**64, from 16-bit limbs of a and 32-bit halves of the constant."""
    high, low = constant >> 32, constant & M32

    def limb(q: Column, k: int) -> Column:
        return F.shiftrightunsigned(q, 16 * k).bitwiseAND(0xFFFF)

    def shifted(x: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(0xFFFF), 16)

    def joined(q: Column, cross: Column) -> Column:
        lower = limb(q, 0) * low + shifted(cross)
        rest = F.shiftrightunsigned(cross, 16) + limb(q, 0) * high + shifted(limb(q, 1) * high) + limb(q, 2) * low + shifted(limb(q, 3) * low)
        return let(lower, lambda lo: F.shiftleft((F.shiftrightunsigned(lo, 32) + rest).bitwiseAND(M32), 32).bitwiseOR(lo.bitwiseAND(M32)))

    return let(a, lambda q: let(limb(q, 1) * low, lambda cross: joined(q, cross)))


def fmix64(x: Column) -> Column:
    """The 64-bit finalizer as a signed BIGINT."""

    def fold(h: Column) -> Column:
        return h.bitwiseXOR(F.shiftrightunsigned(h, 33))

    first = let(x.cast("long"), fold)
    second = let(multiply(first, FMIX[0]), fold)
    return let(multiply(second, FMIX[1]), fold)


def with_fmix64(df: DataFrame, name: str, x: Column) -> DataFrame:
    """df with the 64-bit finalizer of x as the signed BIGINT column ``name``, compiled."""
    a, cross, low, rest = (f"_{name}_{part}" for part in ("a", "cross", "low", "rest"))
    q = F.col(a)

    def limb(k: int) -> Column:
        return F.shiftrightunsigned(q, 16 * k).bitwiseAND(0xFFFF)

    def shifted(y: Column) -> Column:
        return F.shiftleft(y.bitwiseAND(0xFFFF), 16)

    fold = q.bitwiseXOR(F.shiftrightunsigned(q, 33))
    df = df.withColumn(a, x.cast("long")).withColumn(a, fold)
    for k in FMIX:
        # q * k modulo 2**64, from 16-bit limbs of q and 32-bit halves of k, so that no product overflows
        top, bottom = k >> 32, k & M32
        df = df.withColumns({cross: limb(1) * bottom, low: limb(0) * bottom, rest: limb(0) * top + shifted(limb(1) * top) + limb(2) * bottom + shifted(limb(3) * bottom)})
        df = df.withColumns({low: F.col(low) + shifted(F.col(cross)), rest: F.col(rest) + F.shiftrightunsigned(F.col(cross), 16)})
        df = df.withColumn(a, F.shiftleft((F.shiftrightunsigned(F.col(low), 32) + F.col(rest)).bitwiseAND(M32), 32).bitwiseOR(F.col(low).bitwiseAND(M32)))
        df = df.withColumn(a, fold)
    return df.withColumn(name, q).drop(a, cross, low, rest)


def with_fmix31(df: DataFrame, name: str, x: Column) -> DataFrame:
    """df with the low 31 bits of that."""
    return with_fmix64(df, name, x).withColumn(name, F.col(name).bitwiseAND(MASK31))


def joined(u: Column, v: Column) -> Column:
    """A pair of 32-bit numbers as one of 64."""
    return F.shiftleft(u.cast("long"), 32).bitwiseOR(v.cast("long"))


def with_edge_hash(df: DataFrame, name: str, u: Column, v: Column) -> DataFrame:
    """df with edge_hash of (u, v), compiled."""
    return with_fmix31(df, name, joined(u, v))


def with_edge_hash_undirected(df: DataFrame, name: str, u: Column, v: Column) -> DataFrame:
    """df with edge_hash_undirected of (u, v), compiled."""
    return with_fmix31(df, name, joined(F.least(u, v), F.greatest(u, v)))


def with_edge_hash_crc32c(df: DataFrame, name: str, u: Column, v: Column) -> DataFrame:
    """df with edge_hash_crc32c of (u, v), which looks up a table eight times."""
    return df.withColumn(name, edge_hash_crc32c(u, v))


def fmix31(x: Column) -> Column:
    """Its low 31 bits."""
    return fmix64(x).bitwiseAND(MASK31)


def edge_hash(u: Column, v: Column) -> Column:
    """Hash of a directed edge between 32-bit vertices, 0 to 2**31 - 1."""
    return fmix31(joined(u, v))


def edge_hash_undirected(u: Column, v: Column) -> Column:
    """The same for both directions of an edge."""
    return edge_hash(F.least(u, v), F.greatest(u, v))


def crc32c_table() -> list[int]:
    """The table of the reflected Castagnoli CRC, from its rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


def crc32c_u32(crc: Column, value: Column) -> Column:
    """CRC-32C of four more bytes (little-endian), without the final inversions."""
    table = F.array(*(F.lit(x).cast("long") for x in crc32c_table()))

    def step(c: Column) -> Column:
        return F.element_at(table, c.bitwiseAND(0xFF).cast("int") + 1).bitwiseXOR(F.shiftrightunsigned(c, 8))

    c = crc.cast("long").bitwiseXOR(value.cast("long"))
    for _ in range(4):
        c = let(c, step)
    return c


def edge_hash_crc32c(u: Column, v: Column) -> Column:
    """The CRC variant of edge_hash."""
    return F.shiftrightunsigned(crc32c_u32(crc32c_u32(F.lit(0), u), v), 1)


def leading_zeros(x: Column) -> Column:
    """Leading zero bits of a BIGINT; 64 for zero."""
    return F.when(x == 0, F.lit(64)).when(x < 0, F.lit(0)).otherwise(F.lit(64) - F.length(F.bin(x)))


def py_fmix64(x: int) -> int:
    """fmix64 of a Python integer, unsigned: for the few values the driver needs."""
    x &= 2**64 - 1
    for k in FMIX:
        x = (x ^ (x >> 33)) * k % 2**64
    return x ^ (x >> 33)
