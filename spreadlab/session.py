"""Writing intermediate tables where driver and executors see them, and sending functions to workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that setting is absent a temporary folder stands in, but only if driver and executors are one process (tests):
    on a cluster each machine would see files of its own, so that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: an iteration's lineage ends here.

    Lost executors cost nothing, since no executor holds the only copy.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], arranged: bool = False) -> DataFrame:
    """df, written to the shared folder in spark.sql.shuffle.partitions buckets of the keys: joins and aggregations on these move no row of it.

    arranged: each task has the rows of one bucket already.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"rounds_{uuid.uuid4().hex}"
    rows = df if arranged else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).format("parquet").option("path", f"{shared_dir(spark)}/buckets").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog alone forgets it: files of a path that was given stay
    return table


def shipped(fn: Callable, *args, **kw) -> Callable:
    """A function for workers that calls the module-level ``fn(rows, *args, **kw)``.

    The closure goes by value and imports the module by name, so that executors need the package only on their path or at ROOT.
    """
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(rows):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(rows, *args, **kw)

    return run
