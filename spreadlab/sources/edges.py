"""Edge lists: raw and weighted text, and the binary layout of compressed rows."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spreadlab.session import shared_dir, spool
from spreadlab.sources import csr

WEIGHTED = "s long, t long, w float"
#: Blocks of input files (some 150 bytes each) that are broadcast at most; beyond that, joins shuffle.
BLOCKS = 200_000


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files: lines count from 0, by file name and then by place in the file, however the files are packed into tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")  # a row for each block of a file
    starts = spool(blocks.select("file", "block", (before - F.col("first")).alias("shift")))
    known = F.broadcast(starts) if starts.count() <= BLOCKS else starts
    return rows.join(known, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("line"), "value")


def read_weighted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, header): rows (s, t, w) of three tokens, and the (n, m) rows of two.

    Order does not matter, and vertices without edges are known from n.  A missing path raises.
    """
    x = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select(x.alias("x"))
    edges = rows.where(F.size("x") == 3).select(F.col("x")[0].cast("long").alias("s"), F.col("x")[1].cast("long").alias("t"), F.col("x")[2].cast("float").alias("w"))
    header = rows.where((F.size("x") == 2) & (F.col("x")[0] != "")).select(F.col("x")[0].cast("long").alias("n"), F.col("x")[1].cast("long").alias("m"))
    return edges, header


def write_weighted(edges: DataFrame, path: str, n: int | None = None) -> None:
    """``path`` gets tab rows sorted by (s, t) in part files, and ``path``/_header the n and m line."""
    spark, seen = edges.sparkSession, Observation(f"written-{uuid.uuid4().hex}")
    rows = edges.orderBy("s", "t").observe(seen, F.max("s").alias("s"), F.max("t").alias("t"), F.count(F.lit(1)).alias("m"))  # counted as they are written
    rows = rows.select(F.concat_ws("\t", F.col("s").cast("string"), F.col("t").cast("string"), F.col("w").cast("string")).alias("value"))
    rows.write.mode("overwrite").text(path)
    told = seen.get
    if n is None:
        n = max(told["s"], told["t"]) + 1 if told["m"] else 0
    spark.createDataFrame([(f"{n} {told['m']}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_weighted wrote: (edges, header)."""
    return read_weighted(spark, path)[0], read_weighted(spark, f"{path}/_header")[1]


def read_csr(spark: SparkSession, path: str, block: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(u, v, thr) of a folder of compressed rows or of one binary file; of the sources from ``first`` to ``last`` alone, if given.

    Tasks read ranges of ``block`` edges.  Where the session allows Python data sources to take filters, bounds of u are pushed down.
    """
    spark.dataSource.register(csr.csr_edges())
    options = {k: x for k, x in (("block", block), ("first", first), ("last", last)) if x is not None}
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("csr_edges").options(pushdown=pushdown, **options).load(path)


def write_csr(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(u, v, thr) to a folder of compressed rows: one shuffle by ranges of (u, v), then each task writes its part.

    mode: overwrite or append.  The driver writes a manifest of the parts' names and sizes, and no edges.
    """
    edges.sparkSession.dataSource.register(csr.csr_edges())
    rows = spool(edges.select(*(edges[c].cast("long").alias(c) for c in ("u", "v", "thr"))))  # ranges are sampled first: computed once
    rows.repartitionByRange("u", "v").sortWithinPartitions("u", "v").write.format("csr_edges").mode(mode).save(path)


def write_csr_file(edges: DataFrame, path: str) -> None:
    """(u, v, thr) to one binary file, for programs that want one; write_csr is the way for large graphs.

    Tasks pack ranges of offsets and of sorted edges into files of the shared folder; the driver strings their bytes together.
    """
    from spreadlab.operators.prep import csr_offsets
    from spreadlab.sources.files import open_binary

    spark = edges.sparkSession
    edges = spool(edges.select("u", "v", "thr"))
    n, m = edges.agg(F.coalesce(F.greatest(F.max("u"), F.max("v")) + 1, F.lit(0)), F.count("*")).first()
    first = csr_offsets(edges.select(F.col("u").alias("s"), F.col("v").alias("t")), spark.range(n).toDF("id"))
    folder = shared_dir(spark)

    def pack(kind: str, fields: list[tuple[str, str]]):
        def run(batches):
            import uuid

            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            part, out, name = TaskContext.get().partitionId(), None, ""
            for batch in batches:
                if out is None:
                    name = f"{folder}/{kind}-{part:06d}-{uuid.uuid4().hex}"  # of attempts, only the one that ends well is named
                    out = open_binary(name, "w")
                rows = np.zeros(batch.num_rows, fields)
                for c, t in fields:
                    x = batch.column(batch.schema.get_field_index(c)).to_numpy()
                    rows[c] = np.minimum(x, 2**31 - 1) if t == "<i4" else x
                out.write(rows.tobytes())
            if out is not None:
                out.close()
                yield pa.record_batch({"part": pa.array([part]), "name": pa.array([name])})

        return run

    def packed(table: DataFrame, kind: str, fields: list[tuple[str, str]], order: list[str]) -> list[str]:
        found = table.orderBy(*order).select(*(c for c, _ in fields)).mapInArrow(pack(kind, fields), "part long, name string").collect()  # a row for each task
        return [r.name for r in sorted(found, key=lambda r: r.part)]

    parts = packed(first, "offsets", [("first", "<u8")], ["id"]), packed(edges, "edges", [("v", "<u4"), ("thr", "<i4")], ["u", "v"])
    with open_binary(path, "w") as f:
        f.write(struct.pack("<QQ", n, m))
        for names, end in zip(parts, (struct.pack("<Q", m), b""), strict=True):
            for name in names:
                with open_binary(name) as part:
                    while data := part.read(1 << 24):
                        f.write(data)
            f.write(end)
