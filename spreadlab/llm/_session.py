"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spreadlab.session import shared_dir, spool  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])


def shipped(fn: Callable, **kw) -> Callable:
    """A mapInArrow function that calls the module-level ``fn(batches, **kw)`` on the executor.

    The closure goes by value and imports the module by name, so that module-level caches live
    as long as the Python worker, and executors need the package only on their path or at ROOT.
    At a task's end the worker, which waits for the next one, gives its free memory back.
    """
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        own = importlib.import_module("spreadlab.llm._session")
        own.plain_memory()
        try:
            yield from getattr(importlib.import_module(module), name)(batches, **kw)
        finally:
            own.release()

    return run


def plain_memory() -> None:
    """Arrow takes its memory from the C library, which can give it back."""
    pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Free pages of this process go back to the machine."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions_of(df: DataFrame, per_partition: int = 1) -> int:
    """A partition count that follows the input's own splits and the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions() * per_partition)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, renamed, so that further or clashing columns of df do no harm."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as set them apart from all columns of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on rows of this session travel to Python workers in batches of about that size at most.

    Several stages in one session then leave little behind in the executors' memory; a longer text is a batch of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
